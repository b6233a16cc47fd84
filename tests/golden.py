"""The hand-made micro-graph and the node texts that follow from it."""

from graphloom.functions import vocab as v

C = v.HOSTS[0]
_P = {"ontolex": v.ONTOLEX, "lexinfo": v.LEXINFO, "lexicog": v.LEXICOG, "decomp": v.DECOMP, "vartrans": v.VARTRANS, "skos": v.SKOS, "rdf": v.RDF, "rdfs": v.RDFS}

_TABLE = r'''
lexical-unit-1 lexinfo:partOfSpeech lexinfo:noun
lexical-unit-1 ontolex:canonicalForm word-form-10
word-form-10 ontolex:writtenRep """BOJ"""@sl
word-form-10 ontolex:writtenRep """boj"""@sl
word-form-10 lexinfo:case lexinfo:nominative
word-form-10 lexinfo:number lexinfo:singular
lexical-unit-1 ontolex:otherForm word-form-11
word-form-11 ontolex:writtenRep """boja"""@sl
word-form-11 lexinfo:case lexinfo:genitive
word-form-11 lexinfo:number lexinfo:singular
lexical-unit-1 ontolex:sense sense-1
lexical-unit-1 ontolex:sense sense-200
sense-200 skos:definition """oborožen spopad"""@sl
sense-1 lexicog:usageExample example-7
sense-1 lexicog:usageExample example-5
example-5 rdf:value """Rekel je: \"Boj traja.\" In šel."""@sl
example-7 rdf:value """Drugi zgled."""@sl
lexical-unit-2 lexinfo:partOfSpeech lexinfo:noun
lexical-unit-2 ontolex:canonicalForm word-form-20
word-form-20 ontolex:writtenRep """kriminaliteta"""@sl
lexical-unit-2 ontolex:sense sense-2
sense-1 lexinfo:synonym sense-2
sense-2 lexinfo:synonym sense-1
sense-200 lexinfo:antonym sense-2
lexical-unit-9 ontolex:canonicalForm form-lexical-unit-9
form-lexical-unit-9 ontolex:writtenRep """boj proti kriminaliteti"""@sl
lexical-unit-9 ontolex:sense sense-300
lexical-unit-9 decomp:constituent lexical-unit-part-90
lexical-unit-part-90 decomp:correspondsTo lexical-unit-1
lexical-unit-9 decomp:constituent lexical-unit-part-91
lexical-unit-part-91 decomp:correspondsTo lexical-unit-2
lexical-unit-9 decomp:constituent lexical-unit-part-92
dependent-sense-300-lexical-unit-1 rdfs:member sense-1
dependent-sense-300-lexical-unit-1 rdfs:member sense-2
dependent-sense-300-lexical-unit-2 rdfs:member sense-1
dependent-sense-300-lexical-unit-2 rdfs:member sense-2
dependent-sense-301-lexical-unit-1 rdfs:member sense-1
translation-form-4 ontolex:writtenRep """harc"""@hun
translation-form-4 vartrans:source sense-1
lexical-entry-translation-4 ontolex:sense sense-translation-4
lexical-entry-translation-4 ontolex:canonicalForm translation-form-4
lexical-unit-1 rdf:type ontolex:LexicalEntry
sense-1 skos:definition """battle"""@en
lexical-unit-3 lexinfo:partOfSpeech lexinfo:verb
lexical-unit-3 lexinfo:aspect lexinfo:perfective
lexical-unit-3 ontolex:canonicalForm word-form-30
word-form-30 ontolex:writtenRep """popraskati"""@sl
word-form-30 lexinfo:vform lexinfo:infinitive
lexical-unit-3 ontolex:otherForm word-form-31
word-form-31 ontolex:writtenRep """popraskam"""@sl
word-form-31 lexinfo:vform lexinfo:present
word-form-31 lexinfo:person lexinfo:first
word-form-31 lexinfo:number lexinfo:singular
'''


def _name(token: str) -> str:
    prefix, _, rest = token.partition(":")
    return f"<{_P[prefix]}{rest}>" if prefix in _P else f"<{C}{token}>"


def lines() -> list[str]:
    out = []
    for row in _TABLE.strip().splitlines():
        s, p, o = row.split(" ", 2)
        out.append(f"{_name(s)} {_name(p)} {o if o.startswith(chr(34)) else _name(o)} .")
    return [*out, "# a comment", "<broken", f'<{C}sense-2> <{v.SKOS}definition> """open', f"<{C}lexical-unit-1> <{v.ONTOLEX}sense> <http://elsewhere/x> ."]


def code(name: str) -> str:
    stem, _, number = name.rpartition("-")
    return f"c:{(v.TYPES[stem] << 56) | int(number)}"


S = 5 << 56
TEXTS = {
    code("lexical-unit-1"): (0, "iztočnica: boj (samostalnik, imenovalnik, ednina)"),
    code("word-form-11"): (1, "oblika: boja (rodilnik, ednina)"),
    code("sense-1"): (2, 'pomen 1: boj (zgled: Rekel je: "Boj traja." In šel.)'),
    code("sense-200"): (2, "pomen 2: oborožen spopad"),
    code("sense-2"): (2, "pomen: kriminaliteta"),
    code("sense-300"): (2, "pomen: boj proti kriminaliteti"),
    code("example-5"): (3, 'zgled: Rekel je: "Boj traja." In šel.'),
    code("example-7"): (3, "zgled: Drugi zgled."),
    code("lexical-unit-2"): (0, "iztočnica: kriminaliteta (samostalnik)"),
    code("lexical-unit-9"): (0, "iztočnica: boj proti kriminaliteti"),
    code("translation-form-4"): (4, "prevod (madžarsko): harc"),
    code("lexical-unit-3"): (0, "iztočnica: popraskati (glagol, dovršni, nedoločnik)"),
    code("word-form-31"): (1, "oblika: popraskam (sedanjik, 1. oseba, ednina)"),
    f"6:{S | 1}:{S | 2}": (6, "sopomenka: boj ~ kriminaliteta"),
    f"7:{S | 2}:{S | 200}": (7, "protipomenka: kriminaliteta ~ boj"),
    f"5:{S | 1}:{S | 2}": (5, "kolokacija: boj proti kriminaliteti"),
}
