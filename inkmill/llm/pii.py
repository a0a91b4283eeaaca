r"""Personal data: regular expressions propose spans, checksums confirm them, context words move their
score.  Built-in SQL functions only.

The patterns select exactly the leftmost, non-overlapping matches of these, of which failing ones are
dropped without a retry:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)        each part at most 255
    card   [0-9]([\x20-]?[0-9])+                       16 to 19 digits that pass Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                  8 to 15 digits

but are written with possessive repeats and look-behinds, so that a long run of digits or letters costs
linear time and no recursion.  A kind of our own is added: ``iban``, of the length of its country (of
one that is not on the list: the longest there is) and confirmed by mod-97.  It is tried at every place
where one may begin, so that a failing one hides no other.

``split`` gives the text between matches and ``regexp_extract_all`` the matches; their lengths, added
up along the text, are the positions (code points, end exclusive).

Edge cases: a null text counts as empty and has no spans; texts are searched whole; repeated rows are
treated alike; extra columns are ignored by ``find`` and kept by ``redact``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "iban")

#: Length of an IBAN by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_LISTED = "|".join(" ".join(IBAN_LENGTHS.values()).split())

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){7,14}+(?![ ().-]*+[0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_BY_LENGTH}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])))",
}
#: A text without this can hold no match of the kind: a cheap test before the pattern.
NEEDS = {"email": "contains({t}, '@')", "ip": r"{t} rlike '[0-9]\\.[0-9]'", "card": "{t} rlike '[0-9]'", "phone": "contains({t}, '+')", "iban": "{t} rlike '[A-Z][A-Z][0-9][0-9]'"}
BASE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\\bip\\b|server|host|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobil|fax|numero",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
#: How far before a span a context word counts, and by how much.
REACH, BONUS = 40, 0.15


def _luhn(m: str) -> str:
    digits = f"split(reverse(regexp_replace({m}, '[^0-9]', '')), '')"
    doubled = "aggregate(transform({d}, (c, i) -> if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0))), 0, (s, x) -> s + x) % 10 = 0"
    return doubled.format(d=digits)


def _mod97(m: str) -> str:
    plain = f"replace({m}, ' ', '')"
    turned = f"split(concat(substring({plain}, 5), substring({plain}, 1, 4)), '')"
    return f"aggregate({turned}, 0, (r, c) -> if(c between '0' and '9', (r * 10 + int(c)) % 97, (r * 100 + ascii(c) - 55) % 97)) = 1"


CONFIRM = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> int(right(p, 9)) <= 255 and (length(p) <= 9 or p rlike '^0*[0-9]{1,3}$'))",
    "card": _luhn("m"),
    "phone": "true",
    "iban": _mod97("m"),
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(kind: str, text: str) -> str:
    """SQL for an array along the text: length of what precedes a match, of the match, and its score
    (null: not confirmed); the last has what follows all matches.  The pattern of iban takes nothing
    (group 1 has the match), and a blank is put before the text, as no split is made at its begin."""
    p, group = _quoted(PATTERNS[kind]), 0
    if kind == "iban":
        text, group = f"concat(' ', {text})", 1
    score = f"least(1.0D, {BASE[kind]}D + if(lower(right(g, {REACH})) rlike '{CONTEXT[kind]}', {BONUS}D, 0D))"
    return f"zip_with(regexp_extract_all({text}, {p}, {group}), split({text}, {p}, -1), (m, g) -> named_struct('g', length(g), 'n', length(coalesce(m, '')), 's', if(m is not null and {CONFIRM[kind]}, {score}, null)))"


def spans(kind: str, text: str) -> Column:
    """Confirmed spans of one kind: array of (start, end, score)."""
    none = "cast(array() as array<struct<start: int, end: int, score: double>>)"
    begin, taken = ("-1", "0") if kind == "iban" else ("0", "x.n")
    walk = (
        f"aggregate({_parts(kind, text)}, named_struct('at', {begin}, 'out', {none}), "
        f"(a, x) -> named_struct('at', a.at + x.g + {taken}, 'out', if(x.s is null, a.out, array_append(a.out, named_struct('start', a.at + x.g, 'end', a.at + x.g + x.n, 'score', x.s)))), "
        "a -> a.out)"
    )
    return F.expr(f"if({NEEDS[kind].format(t=text)}, {walk}, {none})")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of spans of each base kind, ``base_sha256``, ``spans`` and ``scores``
    (both comma-joined, in the same order)."""
    out = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') as __text")
    out = out.select("doc_id", *[spans(k, "__text").alias(k) for k in ALL_KINDS])
    as_text = {k: f"transform({k}, x -> concat('{k}:', x.start, ':', x.end))" for k in ALL_KINDS}
    base, every = (f"array_join(concat({', '.join(as_text[k] for k in kinds)}), ',')" for kinds in (KINDS, ALL_KINDS))
    scores = f"array_join(concat({', '.join(f'transform({k}, x -> cast(round(x.score, 2) as string))' for k in ALL_KINDS)}), ',')"
    return out.selectExpr("doc_id", *[f"cast(size({k}) as long) as n_{k}" for k in KINDS], f"sha2({base}, 256) as base_sha256", f"{every} as spans", f"{scores} as scores")


#: Code points of the blocks from which ``redact`` cuts its pieces: a piece costs its own length and two blocks.
BLOCK = 4096


def redact(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The same rows and columns, with each confirmed span of at least this score replaced by its kind
    in square brackets; a row without one keeps its text (null too) as it is.

    Spans of all kinds are those of ``find``, on the text as it was.  Overlapping ones are replaced as
    one, by the kind of the longest (ties: the first in the order email, iban, card, ip, phone)."""
    order = ("email", "iban", "card", "ip", "phone")
    held = "__spans"
    while held in {c.lower() for c in docs.columns}:
        held += "_"
    every = ", ".join(f"transform(filter({held}.{k}, x -> x.score >= {least_score}D), x -> named_struct('start', x.start, 'end', x.end, 'n', x.end - x.start, 'kind', {i}))" for i, k in enumerate(order))
    better = "x.n > a.n or x.n = a.n and x.kind < a.kind"
    open_one = "named_struct('start', a.start, 'end', a.end, 'kind', a.kind)"
    none = "cast(array() as array<struct<start: int, end: int, kind: int>>)"
    merged = (
        f"aggregate(array_sort(concat({every})), named_struct('start', -1, 'end', -1, 'n', 0, 'kind', 0, 'out', {none}), "
        f"(a, x) -> if(x.start < a.end, named_struct('start', a.start, 'end', greatest(a.end, x.end), 'n', if({better}, x.n, a.n), 'kind', if({better}, x.kind, a.kind), 'out', a.out), "
        f"named_struct('start', x.start, 'end', x.end, 'n', x.n, 'kind', x.kind, 'out', if(a.end < 0, a.out, array_append(a.out, {open_one})))), "
        f"a -> if(a.end < 0, a.out, array_append(a.out, {open_one})))"
    )

    def cut(start: str, end: str) -> str:
        first = f"cast({start} div {BLOCK} as int)"
        return f"substring(array_join(slice(b, {first} + 1, cast({end} div {BLOCK} as int) - {first} + 1), ''), {start} % {BLOCK} + 1, {end} - {start})"

    names = f"array({', '.join(f"'[{k.upper()}]'" for k in order)})"
    pieces = f"transform(s, (x, i) -> concat({cut('if(i = 0, 0, s[i - 1].end)', 'x.start')}, {names}[x.kind]))"
    joined = f"concat(array_join({pieces}, ''), {cut('s[size(s) - 1].end', 'length(text)')})"
    blocks = f"regexp_extract_all(text, {_quoted(f'(?s).{{1,{BLOCK}}}+')}, 0)"
    masked = f"transform(array({merged}), s -> if(size(s) = 0, text, transform(array({blocks}), b -> {joined})[0]))[0]"
    found = docs.select("*", F.struct(*[spans(k, "coalesce(text, '')").alias(k) for k in order]).alias(held))
    return found.withColumn("text", F.expr(masked)).select(docs.columns)
