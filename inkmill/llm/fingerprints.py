"""Document fingerprints from closed syncmers.  Built-in SQL functions only.

Tokens are words (runs of characters other than white space); ideographs, kana, hangul and Thai letters
are tokens of their own.  Of every ``K`` consecutive words, those are anchors whose least inner pair of
words (by hash) lies at an edge.  Whether a window is one depends on nothing outside it, so an edit
disturbs only the anchors that it touches and the others keep their distance from the edit.  A text of
1 to K - 1 words has its whole sequence as its one anchor; a text without words has none.

A fingerprint holds all anchors of the whole text in order, each as its 32-bit hash in 8 hex digits and
the distance in words from the anchor before (from the text's begin: 0 for the first word) in one, as it
is at most 3.  Likeness is that of two fingerprints and positional: of the anchors that both texts hold
(each at its first place), the most that stand in the same order in both, as a share of all distinct
anchors of the two.  A shared passage counts wherever it stands, a moved one does not.  Where nothing
moved this costs a sort; otherwise time grows with the square of the shared anchors.

Edge cases: null counts as empty; two texts without words are alike (1.0); equal texts have equal
fingerprints; ties and repeated doc_ids are ordered by text; a null doc_id comes last; one document is
its own next; an empty table gives an empty result.  Very long texts are read and kept whole; columns other
than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Bits of an anchor's position (in words) below its hash; no string has more words.
PLACE = 30
_MASK = f"{(1 << PLACE) - 1}L"
_OWN_TOKEN = r"[\\u2E80-\\u9FFF\\uAC00-\\uD7AF\\u0E00-\\u0E7F\\uF900-\\uFAFF]"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once for ``body``, though lambdas in it read it again and again."""
    return f"transform(array({value}), {name} -> {body})[0]"


def placed(text: str) -> Column:
    """The text's anchors, in text order: each one's hash above its position."""
    spaced = f"if({text} rlike '{_OWN_TOKEN}', regexp_replace({text}, '({_OWN_TOKEN})', ' $1 '), {text})"
    words = rf"filter(split({spaced}, '[ \\t-\\r]+'), w -> w <> '')"
    inner = "least(p[i + 1], p[i + 2])"
    window = f"if(least(p[i], p[i + 3]) <= {inner}, shiftleft(xxhash64(p[i], p[i + 2], h[i + 4]) & 4294967295L, {PLACE}) | i, null)"
    many = _let("p", "zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (a, b) -> xxhash64(a, b))", f"filter(transform(sequence(0, size(h) - {K}), i -> {window}), x -> x is not null)")
    few = f"if(size(h) = 0, cast(array() as array<bigint>), array(shiftleft(xxhash64(h) & 4294967295L, {PLACE})))"
    return F.expr(_let("h", f"transform({words}, w -> xxhash64(w))", f"if(size(h) < {K}, {few}, {many})"))


def anchors(text: str) -> Column:
    """Hashes of the text's anchors, in text order."""
    return F.transform(placed(text), lambda x: F.shiftrightunsigned(x, PLACE))


def placed_hex(column: str) -> str:
    """SQL for all placed anchors as hex: hash and distance from the one before."""
    return f"array_join(transform({column}, (x, i) -> concat(lower(lpad(hex(shiftrightunsigned(x, {PLACE})), 8, '0')), hex((x & {_MASK}) - if(i = 0, 0L, {column}[i - 1] & {_MASK})))), '')"


def likeness(a: str, b: str) -> str:
    """SQL for the likeness (0 to 1) of two texts' placed anchors."""

    def firsts(column: str) -> str:
        return _let("s", f"sort_array({column})", f"filter(s, (x, i) -> i = 0 or shiftrightunsigned(s[i - 1], {PLACE}) <> shiftrightunsigned(x, {PLACE}))")

    here, before = (f"(shiftrightunsigned({x}, 1) & {_MASK})" for x in ("x", "m[i - 1]"))
    both = "sort_array(concat(transform(fa, x -> x * 2L), transform(fb, x -> x * 2L + 1L)))"
    pair = f"if(i > 0 and shiftrightunsigned(m[i - 1], {PLACE + 1}) = shiftrightunsigned(x, {PLACE + 1}), if((x & 1L) = 1L, shiftleft({before}, {PLACE}) | {here}, shiftleft({here}, {PLACE}) | {before}), null)"
    # places in b of the shared anchors, in a's order
    places = _let("m", both, f"transform(sort_array(filter(transform(m, (x, i) -> {pair}), x -> x is not null)), x -> x & {_MASK})")
    # t: of each length, the least place at which an ascending choice can end
    replaced = _let("k", "size(filter(t, y -> y < x))", "concat(slice(t, 1, k), array(x), slice(t, k + 2, size(t)))")
    longest = f"aggregate(o, cast(array() as array<bigint>), (t, x) -> if(size(t) = 0 or x > t[greatest(size(t), 1) - 1], array_append(t, x), {replaced}), t -> size(t))"
    agreeing = f"if(exists(transform(o, (x, i) -> i > 0 and o[greatest(i, 1) - 1] > x), x -> x), {longest}, size(o))"
    share = _let("o", places, _let("n", agreeing, "cast(n as double) / (size(fa) + size(fb) - n)"))
    return f"if(size({a}) = 0 and size({b}) = 0, 1.0D, " + _let("fa", firsts(a), _let("fb", firsts(b), share)) + ")"


def with_next(docs: DataFrame, columns: list[str], prepare=lambda df: df, rows_each: int = 2000) -> DataFrame:
    """Add ``next_<column>``: each column of the row that follows by descending doc_id (after the last:
    the first).

    Rows are dealt into ranges of doc_id of about ``rows_each`` rows, by quantiles and evenly between
    two of them, and ordered within a range; the first row of the range below is added as its end.
    ``prepare`` is applied to all rows once they are dealt out; ``columns`` may name what it adds.
    """
    ids = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("most")).first()
    if ids["most"] is None:
        bounds = []
    else:
        cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / 64 for i in range(64)], 0.002)))
        bounds = [int(c) for c in cuts]
    parts = max(1, -(-int(ids["n"]) // (rows_each * max(1, len(bounds)))))
    if bounds:
        marks = f"array({', '.join(f'{b}L' for b in bounds)}, {ids['most'] + 1}L)"
        q = f"size(filter({marks}, b -> b <= doc_id))"
        inside = f"cast(floor((doc_id - {marks}[greatest({q}, 1) - 1]) / cast(greatest(1L, {marks}[least(greatest({q}, 1), {len(bounds)})] - {marks}[greatest({q}, 1) - 1]) as double) * {parts}) as bigint)"
        bucket = f"coalesce(cast({q} as bigint) * {parts} + greatest(0L, least({inside}, {parts - 1}L)), -1L)"
    else:
        bucket = "-1L"
    own = docs.withColumn("__range", F.expr(bucket)).withColumn("__end", F.lit(0))
    tops = docs.select("doc_id", F.expr(bucket).alias("__range")).groupBy("__range").agg(F.max("doc_id").alias("__top"))
    order = Window.orderBy(F.desc("__range"))
    heads = (
        tops.withColumn("__before", F.lag("__range").over(order))
        .withColumn("__last", F.min("__range").over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("__top", F.col("__range").alias("__of"), F.coalesce("__before", "__last").alias("__to"))
    )
    n_ranges = len(bounds) * parts + 1
    if n_ranges <= 100_000:  # 24 bytes a row: a bound on what is broadcast
        heads = F.broadcast(heads)
    copied = own.join(heads, (F.col("__of") == F.col("__range")) & F.col("doc_id").eqNullSafe(F.col("__top")))
    first = copied.withColumn("__range", F.col("__to")).withColumn("__end", F.lit(1)).select(own.columns)
    w = Window.partitionBy("__range").orderBy("__end", F.desc_nulls_last("doc_id"), "text")
    # of several rows with a range's greatest doc_id all are added; the first of them follows
    both = prepare(own.unionByName(first))
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("__end = 0").drop("__range", "__end")


def compare(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the second half replaced by the beginning of the
    next document) and the likeness of its own to that and to the next document's."""
    own = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') as text")
    pairs = with_next(own, ["text", "fp"], lambda df: df.withColumn("fp", placed("text"))).withColumn("half", F.expr("cast(floor(length(text) / 2) as int)"))
    pairs = pairs.withColumn("edited", F.expr("concat(substring(text, 1, length(text) - half), substring(next_text, 1, half))"))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", placed("edited").alias("edited_fp"))
    return pairs.selectExpr(
        "doc_id", "n_chars", "edited_sha256", f"{placed_hex('fp')} as fingerprint", f"{placed_hex('edited_fp')} as edited_fingerprint",
        f"{likeness('fp', 'edited_fp')} as near_edited", f"{likeness('fp', 'next_fp')} as near_next",
    )
