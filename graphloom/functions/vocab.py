"""Closed vocabularies of the lexical graph. Values marked fixed must equal the data's for right results."""

from __future__ import annotations

# Namespaces.
ONTOLEX = "http://www.w3.org/ns/lemon/ontolex#"
LEXINFO = "http://www.lexinfo.net/ontology/3.0/lexinfo#"
LEXICOG = "http://www.w3.org/ns/lemon/lexicog#"
DECOMP = "http://www.w3.org/ns/lemon/decomp#"
VARTRANS = "http://www.w3.org/ns/lemon/vartrans#"
LIME = "http://www.w3.org/ns/lemon/lime#"
FRAC = "http://www.w3.org/ns/lemon/frac#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"

#: Placeholder of the data's own host; callers pass theirs.
HOSTS = ("https://www.lex.example/", "https://lex.example/")

# Predicate -> (role, key). Every other predicate is dropped by the scan.
FEATURES = ("vform", "person", "case", "number", "gender", "degree", "definiteness")
UNIT_FEATURES = ("aspect", "clitic")
PREDICATES = {
    ONTOLEX + "canonicalForm": ("edge", "canon"),
    ONTOLEX + "otherForm": ("edge", "other"),
    ONTOLEX + "sense": ("edge", "sense"),
    LEXINFO + "synonym": ("edge", "syn"),
    LEXINFO + "antonym": ("edge", "ant"),
    LEXICOG + "usageExample": ("edge", "usage"),
    DECOMP + "constituent": ("edge", "constit"),
    DECOMP + "correspondsTo": ("edge", "corr"),
    VARTRANS + "source": ("edge", "tsrc"),
    RDFS + "member": ("edge", "member"),
    LEXINFO + "partOfSpeech": ("pos", "pos"),
    ONTOLEX + "writtenRep": ("literal", "written"),
    SKOS + "definition": ("literal", "definition"),
    RDF + "value": ("literal", "value"),
}
PREDICATES |= {LEXINFO + f: ("feature", f) for f in FEATURES}
PREDICATES |= {LEXINFO + f: ("unit", f) for f in UNIT_FEATURES}

# The first-generation typed graph's predicates and labels.
TYPED_PREDICATES = {
    ONTOLEX + "canonicalForm": (1, "canonical form"),
    ONTOLEX + "otherForm": (2, "other form"),
    ONTOLEX + "sense": (3, "sense"),
    ONTOLEX + "isSenseOf": (3, "sense"),
    LEXINFO + "synonym": (4, "synonym"),
    LEXINFO + "antonym": (5, "antonym"),
    LEXICOG + "usageExample": (6, "usage example"),
    DECOMP + "constituent": (7, "constituent"),
    DECOMP + "correspondsTo": (8, "corresponds to"),
    VARTRANS + "source": (9, "translation source"),
    VARTRANS + "target": (10, "translation target"),
    FRAC + "head": (11, "head"),
}
DECOMPOSITION = (DECOMP + "constituent", DECOMP + "correspondsTo")

# Node types, in the high byte of a node code.
TYPES = {
    "lexical-unit": 1,
    "lexical-unit-part": 2,
    "word-form": 3,
    "form-lexical-unit": 4,
    "sense": 5,
    "sense-translation": 6,
    "translation-form": 7,
    "example": 8,
    "resource": 9,
    "lexical-entry-translation": 10,
}
T_COLLOCATION, T_OTHER = 11, 12
TYPE_NAMES = {v: k for k, v in TYPES.items()} | {T_COLLOCATION: "collocation", T_OTHER: "other"}
TYPE_SHIFT = 56
HALF_BITS = 28

# Kinds of node text.
ANCHOR, FORM, SENSE, EXAMPLE, TRANSLATION, COLLOCATION, SYNONYM, ANTONYM, OTHER = range(9)
TAGS = {
    ANCHOR: "iztočnica: ",
    FORM: "oblika: ",
    SENSE: "pomen: ",
    EXAMPLE: "zgled: ",
    COLLOCATION: "kolokacija: ",
    SYNONYM: "sopomenka: ",
    ANTONYM: "protipomenka: ",
}

# Labels of feature values; ambiguous values carry their property.
LABELS = {
    "nominative": "imenovalnik",
    "genitive": "rodilnik",
    "dative": "dajalnik",
    "accusative": "tožilnik",
    "locative": "mestnik",
    "instrumental": "orodnik",
    "singular": "ednina",
    "dual": "dvojina",
    "plural": "množina",
    "masculine": "moški spol",
    "feminine": "ženski spol",
    "neuter": "srednji spol",
    "first": "1. oseba",
    "second": "2. oseba",
    "third": "3. oseba",
    "present": "sedanjik",
    "future": "prihodnjik",
    "conditional": "pogojnik",
    "imperative": "velelnik",
    "participle": "deležnik na -l",
    "infinitive": "nedoločnik",
    "supine": "namenilnik",
    "positive": "osnovnik",
    "comparative": "primernik",
    "superlative": "presežnik",
    "definiteness:yes": "določna oblika",
    "definiteness:no": "nedoločna oblika",
    "perfective": "dovršni",
    "progressive": "nedovršni",
    "biaspectual": "dvovidski",
    "clitic:bound": "naslonska oblika",
    "clitic:yes": "naslonska oblika",
}
AMBIGUOUS = ("definiteness", "clitic")
POS_LABELS = {
    "noun": "samostalnik",
    "verb": "glagol",
    "adjective": "pridevnik",
    "adverb": "prislov",
    "pronoun": "zaimek",
    "numeral": "števnik",
    "preposition": "predlog",
    "adposition": "predlog",
    "conjunction": "veznik",
    "particle": "členek",
    "interjection": "medmet",
    "determiner": "določilnik",
    "properNoun": "lastno ime",
    "abbreviation": "okrajšava",
}
LANGUAGE_LABELS = {"hun": "madžarsko", "en": "angleško", "de": "nemško", "it": "italijansko"}

# Prefixes of shortened names, after the hosts, which shorten to nothing.
CURIES = (
    (LEXINFO, "lexinfo:"),
    (ONTOLEX, "ontolex:"),
    (DECOMP, "decomp:"),
    (VARTRANS, "vartrans:"),
    (LIME, "lime:"),
    (FRAC, "frac:"),
    (RDF, "rdf:"),
    (RDFS, "rdfs:"),
    (SKOS, "skos:"),
)

# Names by which lookups choose kinds.
KIND_NAMES = {
    "iztocnica": ANCHOR,
    "iztočnica": ANCHOR,
    "headword": ANCHOR,
    "oblika": FORM,
    "form": FORM,
    "pomen": SENSE,
    "sense": SENSE,
    "senses": SENSE,
    "zgled": EXAMPLE,
    "example": EXAMPLE,
    "examples": EXAMPLE,
    "prevod": TRANSLATION,
    "translation": TRANSLATION,
    "kolokacija": COLLOCATION,
    "collocation": COLLOCATION,
    "kolokacije": COLLOCATION,
    "collocations": COLLOCATION,
    "sopomenka": SYNONYM,
    "synonym": SYNONYM,
    "sopomenke": SYNONYM,
    "protipomenka": ANTONYM,
    "antonym": ANTONYM,
    "drugo": OTHER,
    "other": OTHER,
}
# Fixed value: Slovene alphabet of the collation key.
ALPHABET = "abcčdefghijklmnoprsštuvzž"

# Relation labels of the second-generation graph, by edge key; both translation directions share one.
RELATIONS = {
    "other": (1, "oblika"),
    "sense": (2, "pomen"),
    "syn": (3, "sopomenka"),
    "ant": (4, "protipomenka"),
    "usage": (5, "zgled"),
    "constituent": (6, "sestavina"),
    "translation": (7, "prevod"),
    "head": (8, "glava"),
}

# Predicates of the second generation and the relation each stands for.
SECOND_PREDICATES = {
    ONTOLEX + "otherForm": "other",
    ONTOLEX + "sense": "sense",
    LEXINFO + "synonym": "syn",
    LEXINFO + "antonym": "ant",
    LEXICOG + "usageExample": "usage",
    DECOMP + "constituent": "constituent",
    DECOMP + "correspondsTo": "corresponds",
    VARTRANS + "source": "translation",
    VARTRANS + "target": "translation back",
    FRAC + "head": "head",
}
