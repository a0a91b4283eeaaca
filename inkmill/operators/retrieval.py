"""Keyword retrieval by BM25, fusion of ranked lists, and their evaluation, with DataFrames only.

A postings table (term, id, tf, n) holds how often a text has a term and the text's length in words; it
may be stored and read back.  Scores:

    idf = ln(1 + (N - df + 0.5) / (df + 0.5))        score = sum of idf * tf (k1 + 1) / (tf + k1 (1 - b + b n / mean n))

over a question's words, repeats included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.embed import few, lowered, pieces, spread, words_in, words_sql
from inkmill.sources.scratch import settled

#: Scores count to this many places, so that sums of one set of numbers in another order tie.
PLACES = 9
#: Postings in a part of the texts; words of all questions that are broadcast.
PART, SMALL = 500_000, 100_000


def postings(texts: DataFrame, among: list[str] | None = None) -> DataFrame:
    """(term, id, tf, n) of texts (id, text), of these terms if they are told: within the task, nothing is shuffled.  Null
    texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if among is None else pa.array(among, pa.string())
        for piece in pieces(batches):
            row, word = words_in(piece["text"])
            n = np.bincount(row, minlength=piece.num_rows)
            if known is None:
                coded = word.dictionary_encode()
                terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            else:
                terms, code = known, pc.fill_null(pc.index_in(word, value_set=known), -1).to_numpy().astype(np.int64)
                row, code = row[code >= 0], code[code >= 0]
            each, tf = np.unique(row * max(1, len(terms)) + code, return_counts=True)
            row, code = np.divmod(each, max(1, len(terms)))
            yield pa.RecordBatch.from_pydict({"term": terms.take(pa.array(code)), "id": piece["id"].take(pa.array(row)), "tf": pa.array(tf), "n": pa.array(n[row])})

    return lowered(spread(texts.select("id", "text")), "id").mapInArrow(run, f"term string, id {dict(texts.dtypes)['id']}, tf long, n long")


def terms_asked(questions: DataFrame) -> list[str] | None:
    """The words of all questions (question_id, question), or None if they are more than may be shared with tasks."""
    words = questions.select(F.explode(F.expr(words_sql("question"))).alias("term")).distinct().limit(SMALL + 1).collect()
    return sorted(r["term"] for r in words) if len(words) <= SMALL else None


def collection(texts: DataFrame) -> DataFrame:
    """One row (n_texts, mean_words) of texts that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            n = np.bincount(words_in(piece["text"])[0], minlength=piece.num_rows)
            yield pa.RecordBatch.from_pydict({"texts": pa.array([int((n > 0).sum())]), "words": pa.array([int(n.sum())])})

    counted = lowered(texts.select("text")).mapInArrow(run, "texts long, words long").agg(F.coalesce(F.sum("texts"), F.lit(0).cast("long")).alias("n_texts"), F.sum("words").alias("words"))
    return counted.select("n_texts", F.when(F.col("n_texts") > 0, F.col("words") / F.col("n_texts")).alias("mean_words"))


def holding(texts: DataFrame, runs: list[str], size: int, blank: str) -> DataFrame:
    """(id, run) of texts (id, text) that have a run in a row: ``size`` words, joined by a space, or all words of a text that
    has fewer.  Words are parted by ``blank``, a pattern.  The runs, which differ, are shared with the tasks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted({w for r in runs for w in r.split(" ")})
        at, other, none = {w: i for i, w in enumerate(known)}, len(known), len(known) + 1
        wanted = np.full((len(runs), size), none)
        for i, r in enumerate(runs):
            own = [at[w] for w in r.split(" ")]
            wanted[i, : len(own)] = own
        may = np.zeros((size, len(known) + 2), bool)
        may[np.arange(size), wanted] = True
        named = {w.tobytes(): i for i, w in enumerate(wanted)}
        value_set, told = pa.array(known, pa.string()), pa.array(runs, pa.string())
        for piece in pieces(batches):
            split = pc.split_pattern_regex(piece["text"], blank)
            row, word = np.repeat(np.arange(piece.num_rows), pc.fill_null(pc.list_value_length(split), 0).to_numpy()), split.flatten()
            some = pc.greater(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(word, value_set=value_set), other).to_numpy().astype(np.int64)[some]
            row = row[some]
            n = np.bincount(row, minlength=piece.num_rows)
            first = np.cumsum(n) - n
            place, own = np.arange(len(row)), n[row]
            # a run begins where the text has as many words left, or with all words of a short text
            begin = np.flatnonzero((place - first[row] <= np.maximum(own - size, 0)) & may[0, code])
            for k in range(1, size):
                begin = begin[may[k, np.where(begin + k < first[row[begin]] + own[begin], code[np.minimum(begin + k, len(code) - 1)], none)]]
            window = np.full((len(begin), size), none)
            for k in range(size):
                inside = begin + k < first[row[begin]] + own[begin]
                window[inside, k] = code[begin[inside] + k]
            found = sorted({(int(row[b]), named[w.tobytes()]) for b, w in zip(begin, window) if w.tobytes() in named})
            yield pa.RecordBatch.from_pydict({"id": piece["id"].take(pa.array([r for r, _ in found], pa.int64())), "run": told.take(pa.array([i for _, i in found], pa.int64()))})

    return few(spread(texts.select("id", "text"))).mapInArrow(look, f"id {dict(texts.dtypes)['id']}, run string")


def bm25(index: DataFrame, sizes: DataFrame, questions: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, lead: int = 3) -> DataFrame:
    """(question_id, rank, id, score): the k best texts with a positive score for each question (question_id,
    question), ties to the smaller id; exact.  ``index``: postings; ``sizes``: their ``collection``.

    Each term of a question has an upper bound, the greatest score that it gives any text.  The texts' scores by
    the ``lead`` terms of greatest bound give a threshold, the k-th best of them.  Terms whose bounds, the smallest
    together, stay below it (common words, mostly) cannot bring in a text: a text without any other term goes, and
    so does one that they could not lift to the threshold.  Scores are summed where a text's postings are, dealt by
    text in parts of bounded size, and each part hands on its k best: while the questions' terms fit a broadcast no
    pair of question and text is shuffled, however common a word is."""
    words = questions.select("question_id", F.explode(F.expr(words_sql("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    wanted = index.join(words.select("term").distinct(), "term", "left_semi")
    part = F.expr(f"tf * {k1 + 1!r}D / (tf + {k1!r}D * ({1 - b!r}D + {b!r}D * n / mean_words))")
    weighed = settled(wanted.join(F.broadcast(sizes)).select("term", "id", part.alias("part"), "n_texts"))
    df = F.count("*")
    terms = weighed.groupBy("term").agg(F.log(1 + (F.max("n_texts") - df + 0.5) / (df + 0.5)).alias("idf"), F.max("part").alias("most"))
    asked = words.join(terms, "term").select("question_id", "term", (F.col("times") * F.col("idf")).alias("weight"), (F.col("times") * F.col("idf") * F.col("most")).alias("bound"))
    # a question's own words: as many as it is long
    down = Window.partitionBy("question_id").orderBy(F.desc("bound"), "term")
    up = Window.partitionBy("question_id").orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    asked = settled(asked.select("*", F.row_number().over(down).alias("place"), F.sum("bound").over(up).alias("below")))

    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    total = lambda of: F.sum(F.col("weight") * F.when(of, F.col("part")))
    near = F.broadcast if asked.count() <= SMALL else lambda of: of
    by_text = weighed.select("term", "id", "part").repartition(max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weighed.count() // PART)), "id")

    def summed(of: DataFrame, *totals: Column) -> DataFrame:
        return by_text.join(near(of), "term").groupBy("question_id", "id").agg(*totals)

    leading = asked.where(F.col("place") <= lead).select("question_id", "term", "weight")
    first = summed(leading, total(F.lit(True)).alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    edge = first.where(F.col("r") == k).select("question_id", (F.col("score") - 1e-6).alias("edge"))
    asked = settled(asked.join(edge, "question_id", "left").withColumn("small", F.coalesce(F.col("below") < F.col("edge"), F.lit(False))))
    rest = asked.groupBy("question_id").agg(F.sum(F.when(F.col("small"), F.col("bound"))).alias("rest"), F.first("edge").alias("edge"))
    pairs = summed(asked.select("question_id", "term", "weight", "small"), total(~F.col("small")).alias("main"), total(F.col("small")).alias("more")).where("main is not null")
    held = pairs.join(near(rest), "question_id").where("rest is null or main + rest >= edge")
    whole = held.select("question_id", "id", F.round(F.col("main") + F.coalesce("more", F.lit(0.0)), PLACES).alias("score"))
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("question_id", "rank", "id", "score")


def fuse(lists: list[DataFrame], k: int = 5, c: int = 60) -> DataFrame:
    """(question_id, rank, id, score) of several ranked lists (question_id, rank, id): a text's score is the sum of
    1 / (c + rank) over the lists that have it, ties to the smaller id; the k best of each question."""
    parts = [x.select("question_id", "id", (1.0 / (c + F.col("rank"))).alias("part")) for x in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    scored = whole.groupBy("question_id", "id").agg(F.round(F.sum("part"), PLACES).alias("score"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("question_id", "rank", "id", "score")


def _gain(rank: Column, gain: Column) -> Column:
    return (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1.0)


def evaluate(ranked: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """(config, questions, recall, mrr, ndcg) of ranked lists (config, question_id, rank, id) against judgements
    (question_id, id, gain), gain 0 or less meaning irrelevant; means over all questions with a relevant text, those
    without hits included as zeros.  Recall and gains are of the first k places; without a hit mrr counts 0."""
    relevant = judged.where("gain > 0").groupBy("question_id", "id").agg(F.max("gain").alias("gain"))
    best = Window.partitionBy("question_id").orderBy(F.desc("gain"), "id")
    ideal = relevant.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    ideal = ideal.groupBy("question_id").agg(F.sum(_gain(F.col("r"), F.col("gain"))).alias("ideal"))
    asked = relevant.groupBy("question_id").agg(F.count("*").alias("relevant")).join(ideal, "question_id")
    hits = ranked.where(F.col("rank") <= k).select("config", "question_id", "rank", "id").join(relevant, ["question_id", "id"])
    each = hits.groupBy("config", "question_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(_gain(F.col("rank"), F.col("gain"))).alias("gained"))
    configs = ranked.select("config").distinct()
    whole = asked.join(F.broadcast(configs)).join(each, ["config", "question_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.groupBy("config").agg(
        F.count("*").alias("questions"), F.avg(zero(F.col("found") / F.col("relevant"))).alias("recall"), F.avg(zero(1.0 / F.col("first"))).alias("mrr"), F.avg(zero(F.col("gained") / F.col("ideal"))).alias("ndcg"),
    )
