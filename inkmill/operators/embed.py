"""TF-IDF vectors: words of two or more letters and pairs of neighbouring words, sublinear counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions import vectors as V
from inkmill.functions.text import let


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\\\p{{L}}\\\\p{{N}}_]{{2,}}', 0)"


def _among(x: str, terms: list[str]) -> str:
    """SQL: whether x is one of the terms (of letters, digits, _ and blanks; one look-up in a hash set)."""
    return f"{x} in ({', '.join(map(repr, terms))})" if terms else "false"


#: Texts whose words a task holds at a time, and counts after which it adds those up that are of one term.
TEXTS, COUNTS = 1024, 1 << 20


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts in lower case, one after the other, and each one's row: runs of two or more letters, digits and _."""
    split = pc.split_pattern_regex(texts, r"[^\pL\pN_]+")
    row, word = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(split), 0).to_numpy()), split.flatten()
    long = pc.greater(pc.utf8_length(word), 1)
    return row[long.to_numpy(zero_copy_only=False)], word.filter(long)


def _keys(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all occurrences of k known words, by their places, and of pairs a, b of neighbours among these, as k + a * k + b."""
    row, word = words_in(texts)
    code, k = pc.fill_null(pc.index_in(word, value_set=known), -1).to_numpy().astype(np.int64), len(known)
    one, two = code >= 0, (code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:])
    return np.concatenate([row[one], row[:-1][two]]), np.concatenate([code[one], k + code[:-1][two] * k + code[1:][two]])


def few(texts: DataFrame) -> DataFrame:
    """``texts``, which go to a task few at a time, as they may be long."""
    conf = texts.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2 * TEXTS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * TEXTS))
    return texts


def lowered(texts: DataFrame, *others: str) -> DataFrame:
    """``texts`` for a task that reads their words, in lower case."""
    return few(texts).select(*others, F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, TEXTS):
            yield batch.slice(begin, TEXTS)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(term, tf) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            counted = pc.value_counts(words_in(piece["text"])[1])
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["term", "n"])

    return lowered(texts).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("tf"))


def _term_counts(texts: DataFrame, often: list[str]) -> DataFrame:
    """(term, tf, df) of these words and of pairs of neighbours among them, summed in the tasks first."""
    k = len(often)

    def added(held: list[np.ndarray]) -> np.ndarray:
        whole = np.concatenate(held, axis=1)
        key, at = np.unique(whole[0], return_inverse=True)
        return np.stack([key, *(np.bincount(at, x, minlength=len(key)).astype(np.int64) for x in whole[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(often, pa.string())
        held: list[np.ndarray] = [np.zeros((3, 0), np.int64)]

        def told(counts: np.ndarray) -> pa.RecordBatch:
            key, (first, second) = counts[0], np.divmod(counts[0] - k, k)
            one = key < k
            term = pc.binary_join_element_wise(known.take(pa.array(np.where(one, 0, first))), known.take(pa.array(np.where(one, 0, second))), " ")
            term = pc.if_else(pa.array(one), known.take(pa.array(np.where(one, key, 0))), term)
            return pa.RecordBatch.from_arrays([term, pa.array(counts[1]), pa.array(counts[2])], names=["term", "tf", "df"])

        for piece in pieces(batches):
            row, key = _keys(piece["text"], known)
            each, n = np.unique(row * (k + k * k) + key, return_counts=True)
            held.append(added([np.stack([each % (k + k * k), n, np.ones_like(n)])]))
            if sum(h.shape[1] for h in held) > COUNTS:
                held = [added(held)]
                if held[0].shape[1] > COUNTS // 2:
                    yield told(held.pop())
                    held = [np.zeros((3, 0), np.int64)]
        yield told(added(held))

    counted = lowered(texts).mapInArrow(run, "term string, tf long, df long") if k else texts.sparkSession.createDataFrame([], "term string, tf long, df long")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _most(counts: DataFrame, k: int) -> list[tuple[str, int]]:
    return [tuple(r) for r in counts.orderBy(F.desc("tf"), "term").limit(k).collect()]


def spread(texts: DataFrame) -> DataFrame:
    """Texts on all cores: an input of so few partitions that half of the cores would be idle is dealt out anew; larger
    inputs stay as they are, as dealing moves whole texts."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(2 * cores) if 2 * texts.rdd.getNumPartitions() <= cores else texts


def tfidf_fit(texts: DataFrame, features: int = 384, share_words: int = 4096) -> DataFrame:
    """The vocabulary (term, tf, df, idf): the ``features`` most frequent terms, ties by term.

    A pair of words is no more frequent than either word, so only pairs of words that reach the count of
    the ``features``-th word are counted: within the text by look-up while these words are at most ``share_words``
    (there may be many of one low count), and otherwise by joins.  All counts are summed
    before the shuffle; documents are counted for the terms chosen only.  The result has at most ``features`` rows."""
    spark, n = texts.sparkSession, texts.count()
    texts = spread(texts.select("text"))
    words = _word_counts(texts)
    first = _most(words, max(features, share_words) + 1)
    top = first[:features]
    least = top[-1][1] if len(top) == features else 1
    often = [t for t, tf in first if tf >= least]
    if len(often) < len(first) or len(first) <= max(features, share_words):
        counts = _term_counts(texts, often)
    else:
        known = words.where(F.col("tf") >= least).select("term")
        pairs = texts.withColumn("row", F.monotonically_increasing_id()).select("row", F.inline(F.expr(let("u", words_sql("text"), "arrays_zip(slice(u, 1, greatest(size(u) - 1, 0)), slice(u, 2, greatest(size(u) - 1, 0)))"))).alias("a", "b"))
        for end in ("a", "b"):
            pairs = pairs.join(known.withColumnRenamed("term", end), end, "left_semi")
        each = pairs.groupBy("row", F.concat("a", F.lit(" "), "b").alias("term")).agg(F.count("*").alias("n")).drop("row")
        each = each.unionByName(texts.select(F.inline(F.expr(counted_sql(f"filter({words_sql('text')}, w -> {_among('w', [t for t, _ in top])})"))).alias("term", "n")))
        counts = each.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    rows = counts.orderBy(F.desc("tf"), "term").limit(features).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    return spark.createDataFrame(rows.collect(), "term string, tf long, df long, idf double")


def counted_sql(terms: str) -> str:
    """SQL: (term, n) of the distinct items of an array of terms, ordered, and how often each occurs."""
    begins = "filter(transform(f, (x, i) -> if(i = 0 or x <> f[i - 1], i, null)), i -> i is not null)"
    each = "zip_with(b, concat(slice(b, 2, greatest(size(b) - 1, 0)), array(size(f))), (i, e) -> struct(f[i] as term, e - i as n))"
    return let("f", f"array_sort({terms})", let("b", begins, f"if(size(b) = 0, cast(array() as array<struct<term: string, n: int>>), {each})"))


def tfidf_counts(texts: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, list[float]]:
    """``texts`` with ``at`` and ``n`` in place of ``text``: places in the vocabulary (ordered by term) that the text has,
    ascending, and how often; and the places' idf.  A text's weights are (1 + ln n) * idf, of unit length.  The
    vocabulary is bounded by its feature count; each text is counted within its row, so nothing is shuffled."""
    known = sorted((r["term"], r["idf"]) for r in vocabulary.select("term", "idf").collect())
    terms = [t for t, _ in known]
    others = [c for c in texts.columns if c != "text"]
    if not terms:
        return texts.select(*others, F.expr("cast(array() as array<int>)").alias("at"), F.expr("cast(array() as array<int>)").alias("n")), []
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted({w for t in terms for w in t.split(" ")})
        at, k = {w: i for i, w in enumerate(known)}, len(known)
        key = np.array([at[t] if t in at else k + at[t.split(" ")[0]] * k + at[t.split(" ")[1]] for t in terms])
        order = np.argsort(key)
        for piece in pieces(batches):
            row, found = _keys(piece["text"], pa.array(known, pa.string()))
            near = np.minimum(np.searchsorted(key[order], found), len(terms) - 1)
            own = key[order][near] == found
            each, n = np.unique(row[own] * len(terms) + order[near[own]], return_counts=True)
            row, place = np.divmod(each, len(terms))
            ends = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (place, n)]
            yield pa.RecordBatch.from_arrays([*(piece[c] for c in others), *lists], names=[*others, "at", "n"])

    return lowered(spread(texts), *others).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "at array<int>, n array<int>"])), [float(x) for _, x in known]


def tfidf_sparse(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``tfidf_counts`` with the weights, ``weight``, in place of ``n``."""
    rows, idf = tfidf_counts(texts, vocabulary)
    return rows.withColumn("weight", V.tfidf_weights("at", "n", idf)).drop("n")


def tfidf_transform(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term, weight) with unit length by id, of texts (id, text)."""
    terms = sorted(r["term"] for r in vocabulary.select("term").collect())
    if not terms:
        return texts.select("id", F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    rows = tfidf_sparse(texts.select("id", "text"), vocabulary).select("id", F.inline(F.arrays_zip("at", "weight")))
    return rows.select("id", F.expr(f"array({', '.join(map(repr, terms))})[at]").alias("term"), "weight")


def dense(sparse: DataFrame, features: int = 384) -> DataFrame:
    """``sparse`` (at, weight, ...) with ``vector`` in place of both: weights by place, zero-padded."""
    n = "size(at)"
    gap = f"if(i = {n}, {features}, at[i]) - if(i = 0, 0, at[i - 1] + 1)"
    whole = f"flatten(transform(sequence(0, {n}), i -> if(i = {n}, array_repeat(0D, {gap}), array_append(array_repeat(0D, {gap}), weight[i]))))"
    return sparse.withColumn("vector", F.expr(whole)).drop("at", "weight")


def cache_misses(texts: DataFrame, cache: DataFrame, model: str = "tfidf") -> DataFrame:
    """Texts whose (model, md5) the cache (model, key) does not hold."""
    keyed = texts.withColumn("key", F.md5(F.col("text").cast("binary")))
    return keyed.join(cache.where(F.col("model") == model).select("key").distinct(), "key", "left_anti")


Encoder = Callable[[DataFrame], DataFrame]


def tfidf_encoder(vocabulary: DataFrame, features: int = 384) -> Encoder:
    """An encoder of texts (id, text) as (id, vector): unit TF-IDF vectors, of zeros where no term is known."""

    def encode(texts: DataFrame) -> DataFrame:
        return dense(tfidf_sparse(texts.select("id", "text"), vocabulary), features)

    return encode


def fresh_vectors(texts: DataFrame, cache: DataFrame, encode: Encoder, model: str = "tfidf") -> DataFrame:
    """Rows for the cache (model, key, vector): each distinct text that it lacks is encoded once."""
    missing = cache_misses(texts, cache, model).groupBy("key").agg(F.first("text").alias("text"))
    return encode(missing.select(F.col("key").alias("id"), "text")).select(F.lit(model).alias("model"), F.col("id").alias("key"), "vector")


def encode_cached(texts: DataFrame, cache: DataFrame, fresh: DataFrame, model: str = "tfidf") -> DataFrame:
    """``texts`` with their ``vector``, from the cache where it holds one and else from ``fresh``."""
    known = cache.where(F.col("model") == model).groupBy("key").agg(F.first("vector").alias("vector"))
    new = fresh.join(known, "key", "left_anti").select("key", "vector")
    keyed = texts.withColumn("__key", F.md5(F.col("text").cast("binary")))
    return keyed.join(known.unionByName(new).withColumnRenamed("key", "__key"), "__key").drop("__key")
