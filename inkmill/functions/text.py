"""Scalar text functions as Column expressions: strip, sentence split, ids, JSON recovery, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode strings know it (fixed values).
SPACE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
#: The same but for the line feed, as a class to be used within a line.
BLANK = r"[\x09\x0B-\x0D\x1C-\x20\x85\p{Z}]"
#: The same as characters of an SQL literal.
SPACE_CODES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACES = "".join(rf"\u{c:04X}" for c in SPACE_CODES)
#: Chapter headings (fixed values; digits and spaces of any script, any case).
CHAPTER = rf"(?iu)第[一二三四五六七八九十百千\p{{Nd}}]+[章篇]|chapter{SPACE}+\p{{Nd}}+"


def sql(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once although lambdas in ``body`` read it repeatedly."""
    return f"transform(array({value}), {name} -> {body})[0]"


def strip_sql(x: str) -> str:
    """Both ends without white space; only the ends are looked at."""
    return f"btrim({x}, '{SPACES}')"


def strip(c: str) -> Column:
    return F.expr(strip_sql(c))


def sentences_sql(text: str, enders: str = "。！？；\n") -> str:
    """Stripped, non-blank sentences; a sentence ends with one of ``enders``."""
    kept = f"filter(transform(split({text}, {sql(f'(?<=[{enders}])')}), s -> {strip_sql('s')}), s -> s <> '')"
    return kept


def paragraphs_sql(text: str) -> str:
    blank_line = rf"\n{SPACE}*\n"
    return f"filter(transform(split({text}, {sql(blank_line)}), s -> {strip_sql('s')}), s -> s <> '')"


def node_id(textbook: str, name: str) -> Column:
    return F.expr(f"concat('node_', substring(md5(concat({textbook}, ':', {name})), 1, 8))")


def extension(filename: str) -> Column:
    return F.expr(f"if(contains({filename}, '.'), lower(substring_index({filename}, '.', -1)), '')")


def title_from_filename(filename: str) -> Column:
    return F.expr(rf"regexp_replace({filename}, {sql('(?<=.)[.][^.]*$')}, '')")


def or_default(c: str, value: str) -> Column:
    """``value`` where null or empty."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))


def file_size(size: str) -> Column:
    """Bytes as '0 B', '1.50 KB', ...: two decimals, ties to even, GB the largest unit."""
    unit = f"case when {size} < 1024 then 0 when {size} < 1048576 then 1 when {size} < 1073741824 then 2 else 3 end"
    cents = f"cast(bround(cast({size} as decimal(30, 0)) * 100 / cast(pow(1024, {unit}) as decimal(20, 0)), 0) as bigint)"
    return F.expr(f"if({size} = 0, '0 B', concat(({cents}) div 100, '.', lpad(({cents}) % 100, 2, '0'), ' ', element_at(array('B', 'KB', 'MB', 'GB'), {unit} + 1)))")


def model_json(response: str) -> Column:
    """The JSON text in a model's answer, or null: without a code fence if it is valid so, else from the
    first brace to the last."""
    bare = strip_sql(response)
    for fence in ("^```json", "^```", "```$"):
        bare = f"regexp_replace({bare}, '{fence}', '')"
    bare = strip_sql(bare)
    inner = f"regexp_extract({bare}, {sql('(?s)[{].*[}]')}, 0)"
    valid = "{0} <> '' and try_parse_json({0}) is not null"
    return F.expr(let("b", bare, f"case when {valid.format('b')} then b else {let('i', inner.replace(bare, 'b'), f'case when {valid.format("i")} then i end')} end"))


def flat_json(response: str) -> Column:
    """The first brace-delimited text without inner braces, or null: equivalence answers."""
    found = f"regexp_extract({response}, {sql('[{][^{}]*[}]')}, 0)"
    return F.expr(let("f", found, "case when f <> '' and try_parse_json(f) is not null then f end"))


def fenced_json(response: str) -> Column:
    """The answer without a code fence if that is valid JSON, or null: reason answers."""
    bare = strip_sql(response)
    for fence in ("^```json", "^```", "```$"):
        bare = f"regexp_replace({bare}, '{fence}', '')"
    return F.expr(let("f", strip_sql(bare), "case when f <> '' and try_parse_json(f) is not null then f end"))


def symbol_size(frequency: str) -> Column:
    return F.expr(f"greatest(20, least(60, 20 + 10 * coalesce(nullif({frequency}, 0), 1)))")


#: Suggestions by keyword of the user's message (fixed values).
SUGGESTIONS = (
    (("决策", "整合"), ("查看所有整合决策", "修改这个决策")),
    (("知识点",), ("查看知识点详情", "查看相关知识点")),
)
DEFAULT_SUGGESTIONS = ("查看整合统计", "开始新的整合")


def suggestions(message: str, rules=SUGGESTIONS, default=DEFAULT_SUGGESTIONS, most: int = 3) -> Column:
    """Suggestions of every rule with a keyword in the message, or the default; at most ``most``."""
    parts = [F.when(F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(message), w)), F.lit(False)), F.array(*map(F.lit, says))).otherwise(F.array().cast("array<string>")) for words, says in rules]
    found = F.concat(*parts)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default))), 1, most)
