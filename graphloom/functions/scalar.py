"""Scalar functions of the lexical graph as Column -> Column expressions (Python only for NFC)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab



def any_of(test: Column, *more: Column) -> Column:
    for m in more:
        test = test | m
    return test


def mapped(value: Column, table: Mapping[str, str]) -> Column:
    """table[value], or null; a literal map, bounded by the closed vocabulary it holds."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), value)


def host_path(iri: Column, hosts: Sequence[str] = vocab.HOSTS) -> Column:
    """What follows the data's own host; null for other names."""
    out = F.lit(None).cast("string")
    for host in reversed(hosts):
        out = F.when(iri.startswith(host), F.substring(iri.cast("binary"), len(host.encode()) + 1, 1 << 30).cast("string")).otherwise(out)
    return out


def hash56(text: Column) -> Column:
    """56 bits of a text's md5; stands in for hash functions Spark lacks, and DuckDB computes it alike."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 14), 16, 10).cast("long")


def _tagged(type_id, payload: Column) -> Column:
    kind = F.lit(type_id) if isinstance(type_id, int) else type_id
    return F.shiftleft(kind.cast("long"), vocab.TYPE_SHIFT).bitwiseOR(payload)


def node_code(iri: Column, hosts: Sequence[str] = vocab.HOSTS) -> Column:
    """64-bit code of a name under the hosts (type in the high byte, number or hash below); null elsewhere.

    No name under the hosts is dropped: one without known prefix and number is hashed into type 12.
    """
    return path_code(host_path(iri, hosts))


def path_code(path: Column, digits: Column | None = None, number: Column | None = None) -> Column:
    """The code of what follows the host, null for null; `digits` (behind the last dash) and their `number` may be given.

    Names of a known prefix and a number written plainly, and names of collocations, need no pattern. All others go
    through a lambda, which keeps the code generated for a row below the size that the JVM still compiles.
    """
    digits = F.substring_index(path, "-", -1) if digits is None else digits
    number = digits.try_cast("long") if number is None else number
    stem = F.substring(path.cast("binary"), 1, F.octet_length(path) - F.octet_length(digits) - 1).cast("string")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in vocab.TYPES.items() for x in pair]), stem)
    plain = kind.isNotNull() & (F.length(digits) <= 16) & (number.cast("string") == digits)
    half = F.lit(1 << vocab.HALF_BITS)
    sense = F.substring_index(F.substring_index(path, "-", 3), "-", -1).try_cast("long")
    named = F.concat(F.lit("dependent-sense-"), sense.cast("string"), F.lit("-lexical-unit-"), number.cast("string")) == path
    return (
        F.when(path.isNull(), F.lit(None).cast("long"))
        .when(plain, _tagged(kind, number))
        .when(path.startswith("dependent-sense-") & named & (sense < half) & (number < half), _tagged(vocab.T_COLLOCATION, F.shiftleft(sense, vocab.HALF_BITS).bitwiseOR(number)))
        .otherwise(F.get(F.transform(F.array(path), _any_code), F.lit(0)))
    )


def _any_code(path: Column) -> Column:
    """The code of any path by patterns."""
    d = F.regexp_extract(path, r"^dependent-sense-(\d+)-lexical-unit-(\d+)$", 1)
    h = F.regexp_extract(path, r"^dependent-sense-(\d+)-lexical-unit-(\d+)$", 2)
    half = F.lit(1 << vocab.HALF_BITS)
    d_num, h_num = F.try_to_number(d, F.lit("9" * 18)), F.try_to_number(h, F.lit("9" * 18))
    fits = (F.length(d) <= 18) & (F.length(h) <= 18) & (d_num < half) & (h_num < half)
    packed = F.shiftleft(d_num.cast("long"), vocab.HALF_BITS).bitwiseOR(h_num.cast("long"))
    stem = F.regexp_extract(path, r"^(.*)-(\d+)$", 1)
    digits = F.regexp_extract(path, r"^(.*)-(\d+)$", 2)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in vocab.TYPES.items() for x in pair]), stem)
    number = F.when(F.length(digits) <= 16, F.try_to_number(digits, F.lit("9" * 16)).cast("long"))
    small = number < F.lit(1 << vocab.TYPE_SHIFT)
    return (
        F.when(d != "", F.when(F.coalesce(fits, F.lit(False)), _tagged(vocab.T_COLLOCATION, packed)).otherwise(_tagged(vocab.T_COLLOCATION, hash56(path))))
        .when(kind.isNotNull() & F.coalesce(small, F.lit(False)), _tagged(kind, number))
        .otherwise(_tagged(vocab.T_OTHER, hash56(path)))
    )


def legacy_code(iri: Column, hosts: Sequence[str] = vocab.HOSTS) -> Column:
    """First- and second-generation code: prefix id * 10**9 + number; unknown prefixes share 400 ids by crc32."""
    path = host_path(iri, hosts)
    stem, digits = (F.regexp_extract(path, r"^(.*)-(\d+)$", k) for k in (1, 2))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in vocab.TYPES.items() for x in pair]), stem)
    prefix = F.coalesce(kind.cast("long"), F.lit(500) + F.crc32(F.encode(stem, "UTF-8")) % 400)
    return F.when(path.isNotNull() & (digits != ""), prefix * 1_000_000_000 + digits.cast("long"))


def type_of(code: Column) -> Column:
    return F.shiftright(code, vocab.TYPE_SHIFT).cast("int")


def payload(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << vocab.TYPE_SHIFT) - 1))


def local_name(iri: Column) -> Column:
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


# One-letter escapes of literals.
_PLAIN = {'"': '"', "n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "/": "/", "'": "'"}
#: Code points written out: four digits, or eight below 0x110000; no surrogates.
_POINT = r"^(?:u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|U(?!0000[dD][89a-fA-F])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})"


def _points(text: Column) -> Column:
    """Written-out code points of a text in which no two backslashes stand together."""

    def one(part: Column, i: Column) -> Column:
        digits = F.when(part.startswith("u"), 4).otherwise(8)
        point = F.decode(F.unhex(F.lpad(F.substr(part, F.lit(2), digits), 8, "0")), "UTF-32")
        known = F.concat(point, F.substr(part, digits + 2))
        return F.when(i == 0, part).when(part.rlike(_POINT), known).otherwise(F.concat(F.lit("\\"), part))

    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(F.split(text, r"\\", -1), one), ""))


def unescape(text: Column) -> Column:
    """Literal escapes resolved in one pass from the left; unknown ones stay.

    Doubled backslashes are the only escapes in which two stand together, so the text is cut at them first; no
    replacement inside a piece can then begin another escape, if code points come last.
    """

    def piece(part: Column) -> Column:
        for letter, meant in _PLAIN.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(meant))
        return part

    whole = F.array_join(F.transform(F.transform(F.split(text, r"\\\\", -1), piece), _points), "\\")
    return F.when(F.instr(text, "\\") == 0, text).otherwise(whole)


def is_slovene(tail: Column) -> Column:
    """Whether a literal's tail carries the tag; a longer tag that begins alike passes too."""
    return F.instr(tail, "@sl") > 0


def language(tail: Column) -> Column:
    return F.nullif(F.regexp_extract(tail, r"@([A-Za-z0-9-]+)", 1), F.lit(""))


def feature_label(prop: str, value: Column) -> Column:
    key = F.concat(F.lit(f"{prop}:"), value) if prop in vocab.AMBIGUOUS else value
    return mapped(key, vocab.LABELS)


def feature_text(pos: Column, units: Mapping[str, Column], forms: Mapping[str, Column]) -> Column:
    """' (pos, unit features, form features)' in fixed order without what has no label; '' if nothing is left."""
    parts = [mapped(pos, vocab.POS_LABELS)]
    parts += [feature_label(p, units[p]) for p in vocab.UNIT_FEATURES if p in units]
    parts += [feature_label(p, forms[p]) for p in vocab.FEATURES if p in forms]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined != "", F.concat(F.lit(" ("), joined, F.lit(")"))).otherwise("")


def snippet(text: Column, limit: int = 60) -> Column:
    """At most `limit` characters, cut at the last space if that lies beyond half of it, then ' ...'."""
    if limit <= 0:
        return F.lit("")
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    head = F.substring(flat, 1, limit)
    cut = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    kept = F.when(cut > limit // 2, F.substr(flat, F.lit(1), cut)).otherwise(head)
    short = F.concat(F.rtrim(kept, F.lit(" ,;:.!?-")), F.lit(" ..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(short)


def token_proxy(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 without text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(0)


def uppercase(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))


def shorten(token: Column, hosts: Sequence[str] = vocab.HOSTS) -> Column:
    """<name> as prefix:rest by the first prefix that fits; other tokens stay."""
    iri = F.when(token.startswith("<") & token.endswith(">"), F.substr(token, F.lit(2), F.length(token) - 2))
    out = iri
    for long, short in reversed([*((h, "") for h in hosts), *vocab.CURIES]):
        out = F.when(iri.startswith(long), F.concat(F.lit(short), F.substring(iri, len(long) + 1, 1 << 30))).otherwise(out)
    return F.coalesce(out, token)


def node_label(code: Column, minted: Column) -> Column:
    """<type name>-<number>, or minted-<key> for nodes without a code."""
    names = F.create_map(*[F.lit(x) for pair in vocab.TYPE_NAMES.items() for x in pair])
    real = F.concat(F.try_element_at(names, type_of(code)), F.lit("-"), payload(code).cast("string"))
    return F.coalesce(real, F.concat(F.lit("minted-"), minted))


def names_of(text: Column, kind: Column) -> Column:
    """Names a node answers to: what precedes the first ' (' of anchors and forms, both halves of pairs, whole phrases."""
    tag = {k: vocab.TAGS[k] for k in vocab.TAGS}
    out = F.array().cast("array<string>")
    for k in (vocab.ANCHOR, vocab.FORM):
        out = F.when(kind == k, F.array(F.regexp_extract(text, f"^{tag[k]}(.+?)(?: \\(|$)", 1))).otherwise(out)
    for k, joiner in ((vocab.COLLOCATION, "\\+"), (vocab.SYNONYM, "~"), (vocab.ANTONYM, "~")):
        pattern = f"^{tag[k]}(.+?) {joiner} (.+)$"
        halves = F.array(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
        if k == vocab.COLLOCATION:
            halves = F.when(text.rlike(pattern), halves).otherwise(F.array(F.regexp_extract(text, f"^{tag[k]}(.+)$", 1)))
        out = F.when(kind == k, halves).otherwise(out)
    return F.filter(out, lambda x: x != "")


def tier(text: Column, kind: Column, query: str) -> Column:
    """0: the query is one of the node's names, 1: a whole word of its text, 2: part of it."""
    low = query.lower()
    quoted = re.sub(r"([^\w\s])", r"\\\1", query)
    whole = text.rlike(rf"(?iuU)(?<!\w){quoted}(?!\w)")
    return F.when(F.exists(names_of(text, kind), lambda n: F.lower(n) == low), 0).when(whole, 1).otherwise(2)


def case_variants(query: str) -> list[str]:
    return list(dict.fromkeys((query, query.lower(), query.upper(), query.capitalize(), query.title())))


def paren_split(text: Column) -> tuple[Column, Column]:
    """Surface and items of a trailing ' (a, b)'; the text itself and no items without one."""
    pattern = r"(?s)^(.*) \((.*)\)$"
    has = text.rlike(pattern)
    items = F.split(F.regexp_extract(text, pattern, 2), ", ")
    return (
        F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(text),
        F.when(has, items).otherwise(F.array().cast("array<string>")),
    )


def is_subsequence(small: Column, big: Column) -> Column:
    """Whether the items of `small` occur in `big` in their order."""
    def step(at: Column, x: Column) -> Column:
        place = F.array_position(F.slice(big, at + 1, F.size(big)), x).cast("int")
        return F.when((at < 0) | (place == 0), -1).otherwise(at + place)

    return F.aggregate(small, F.lit(0), step) >= 0


def letters(text: Column) -> Column:
    """Lower-case letter runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def stems_meet(a: Column, b: Column, n: int = 4) -> Column:
    """Whether some pair of tokens has one's first n letters at the other's start."""
    return F.exists(
        a,
        lambda x: F.exists(
            b, lambda y: y.startswith(F.substring(x, 1, n)) | x.startswith(F.substring(y, 1, n))
        ),
    )


def slovene_key(text: Column) -> Column:
    """Sort key: places in the alphabet; other characters follow by code point."""
    ranks = F.create_map(*[x for i, c in enumerate(vocab.ALPHABET) for x in (F.lit(c), F.lit(i))])
    n = len(vocab.ALPHABET)
    return F.transform(
        F.filter(F.split(F.lower(text), ""), lambda c: c != ""),
        lambda c: F.coalesce(F.try_element_at(ranks, c), F.lit(n) + F.ascii(c)),
    )


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normal(text: Column) -> Column:
    """NFC, white space to one space, trimmed, without trailing periods, folded. Python gets null for ASCII texts."""
    plain = F.length(text) == F.octet_length(text)
    composed = F.when(plain, text).otherwise(_nfc(F.when(~plain, text)))
    flat = F.trim(F.regexp_replace(composed, r"(?U)\s+", " "))
    return F.replace(F.lower(F.rtrim(flat, F.lit("."))), F.lit("ß"), F.lit("ss"))


def parse_answer(answer: Column, separator: str | None) -> Column:
    """Normalised items of the first line that begins with ODGOVOR:, null without one; one item if separator is None."""
    line = F.regexp_extract(answer, r"(?m)^ODGOVOR:(.*)$", 1)
    items = F.array(line) if separator is None else F.split(line, re.escape(separator))
    flat = F.transform(items, lambda x: F.replace(F.lower(F.rtrim(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit("."))), F.lit("ß"), F.lit("ss")))
    return F.when(answer.rlike(r"(?m)^ODGOVOR:"), flat)


def counted_senses(n: Column) -> Column:
    """Number agreement of '<n> senses are recorded', by n modulo 100."""
    rest = n % 100
    text = n.cast("string")
    return (
        F.when(rest == 1, F.concat(F.lit("v bazi je zabeležen "), text, F.lit(" pomen")))
        .when(rest == 2, F.concat(F.lit("v bazi sta zabeležena "), text, F.lit(" pomena")))
        .when(rest.isin(3, 4), F.concat(F.lit("v bazi so zabeleženi "), text, F.lit(" pomeni")))
        .otherwise(F.concat(F.lit("v bazi je zabeleženih "), text, F.lit(" pomenov")))
    )


#: Upper bounds of the frequency bands 0..5; above: band 6.
BAND_TOPS = (0, 4, 16, 64, 256, 1024)


def band(proxy: Column) -> Column:
    out = F.lit(len(BAND_TOPS))
    for k in range(len(BAND_TOPS) - 1, -1, -1):
        out = F.when(proxy <= BAND_TOPS[k], k).otherwise(out)
    return out


def sample_weight(proxy: Column) -> Column:
    return F.log1p(proxy)


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """A share as text, such as 12.5 %; empty if there is nothing to share."""
    return F.when(whole > 0, F.concat(F.format_number(100 * part / whole, places), F.lit(" %"))).otherwise("")


def elapsed(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    whole = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(whole / 3600).cast("string"), two(F.floor(whole / 60) % 60), two(whole % 60))
