"""Ranked lexical search: whole-number BM25 by variable block-max WAND.

Terms are maximal runs of bytes that are ASCII letters or digits or belong to other characters, A-Z in
lower case.  With N texts that have terms, L terms in all of them, n terms of a text, df texts that hold
a term and tf its occurrences in a text,

    w = floor(1000 ln((2N + 2) / (2 df + 1)))       m = 100 - 25 + (25 n N div L)
    score = sum over an item's terms, repeats included, of w * ((1000000000 tf) div (1000 tf + 12 m))

1. One pass over whole texts keeps of each text its length and the items' terms with their counts, packed;
   the items' terms are shared with the tasks.  N, L and df are sums over that table, partial sums first.
2. Each task reads its part of the table, shard by shard (at most ``shard_postings`` postings and
   ``shard_docs`` texts), and builds inverted lists.  A dynamic program cuts every list into blocks of
   variable size that minimise the bound error, the sum over postings of (block's greatest impact - own
   impact), plus a fixed price for each block.  Boundaries lie between runs of ``GRAIN`` postings; all
   lists of a shard advance together, one numpy step for each run.
3. An item is searched in each shard.  Every text has an upper bound: its impacts in the item's short lists
   (which hold at most one text in ``SHORT``) and the greatest impacts of the blocks about it in the others.
   The texts of greatest bound are scored first; then only texts, in descending order of bound, whose
   blocks' bounds still reach the k-th best score, which is carried on to the task's next shards.  A bound
   equal to that score is looked at too, so ties are exact.  Each task returns at most k rows an item.

Items come in blocks of at most ``item_block``, each with its own pass.  Terms are told apart by 64-bit
tabulation hashes.

Edge cases: null and empty texts, and texts without terms, have no terms, count nowhere and are not found;
items without terms find nothing; rows without doc_id or item_id take no part; each of several rows of one
doc_id is a text of its own and each of several rows of one item_id has k results of its own; other columns
are not looked at; empty tables give empty results; ties go to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.session import discard, small_batches, stored
from inkmill.llm.textkit import U64, slices, span_hash

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
GRAIN = 8  # postings in a run; block boundaries lie between runs
WINDOW = 48  # runs in a block at most
SHORT = 16
PRICE = 24  # a block costs as much as this many postings of the list's mean deviation

RESULT = "item_id long, rank int, doc_id long, score long"


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, in order, and where each text's begin (one more at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    buf = _LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    flips = np.flatnonzero(np.diff(np.concatenate(([False], _TERM[buf])).view(np.int8)))
    start, end = flips[0::2], flips[1::2]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
    return span_hash(buf, start, end), np.concatenate(([0], np.searchsorted(start, ends)))


@dataclass
class Items:
    """A block of items: ``vocabulary`` holds the sorted hashes of their terms, ``terms[i]`` and ``times[i]``
    the places in it of item i's terms and how often it has them."""

    ids: list[int]
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Items:
        hashed, first = term_hashes([text for _, text in rows])
        vocabulary = np.unique(hashed)
        each = [np.unique(np.searchsorted(vocabulary, hashed[a:b]), return_counts=True) for a, b in zip(first[:-1], first[1:])]
        return Items([i for i, _ in rows], vocabulary, [t for t, _ in each], [n for _, n in each])


def counted(texts: list[str | None], vocabulary: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text the number of its terms, which of the vocabulary it has, and how often."""
    hashed, first = term_hashes(texts)
    some = np.flatnonzero(marks[hashed & U64(len(marks) - 1)])
    at = np.searchsorted(vocabulary, hashed[some])
    known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashed[some] if len(vocabulary) else np.zeros(0, bool)
    text = np.searchsorted(first, some[known], side="right") - 1
    key, tf = np.unique(text * len(vocabulary) + at[known], return_counts=True)
    edge = np.searchsorted(key, np.arange(len(texts) + 1) * len(vocabulary))
    term = key % len(vocabulary) if len(vocabulary) else key
    return np.diff(first), [term[a:b] for a, b in zip(edge[:-1], edge[1:])], [tf[a:b] for a, b in zip(edge[:-1], edge[1:])]


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, m, term, tf) of each text with a term: its length, how many terms of the vocabulary it has, those, packed."""
    small_batches(docs.sparkSession)
    marks = np.zeros(1 << 20, dtype=bool)
    marks[vocabulary & U64(len(marks) - 1)] = True
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marked = shared.value
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in slices([len(t or "") for t in texts]):
                n, term, tf = counted(texts[a:b], known, marked)
                packed = [pa.array([x.astype("<u4").tobytes() for x in c], pa.binary()) for c in (term, tf)]
                whole = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array([len(t) for t in term], pa.int64()), *packed], names=["doc_id", "n", "m", "term", "tf"])
                yield whole.filter(pa.array(n > 0))

    own = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return own.mapInArrow(run, "doc_id long, n long, m long, term binary, tf binary")


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """df of each term of the vocabulary; one row a task and term is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4"), minlength=size)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(df[own])], names=["t", "df"])

    found = np.zeros(size, dtype=np.int64)
    for r in table.select("term").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        found[r["t"]] = r["df"]
    return found


def cut(impact: np.ndarray, first: np.ndarray, price: float = PRICE) -> np.ndarray:
    """Where the blocks of several lists begin (list i is first[i]:first[i + 1] of ``impact``), in order.

    The least, for each list, of bound error plus price of blocks, by dynamic programming over its runs:
    f(j) = min over b of f(j - b) + error of the block of the last b runs + price."""
    size = np.diff(first)
    n_runs = -(-size // GRAIN)
    offset = np.concatenate(([0], np.cumsum(n_runs)))
    run = np.repeat(first[:-1] - offset[:-1] * GRAIN, n_runs) + np.arange(offset[-1]) * GRAIN
    if not len(run):
        return run
    value = impact.astype(np.float64)
    most, total = np.maximum.reduceat(value, run), np.add.reduceat(value, run)
    count = np.diff(np.append(run, len(impact))).astype(np.float64)
    mean = np.add.reduceat(value, first[:-1][size > 0]) / size[size > 0]
    spread = np.zeros(len(size))
    spread[size > 0] = np.add.reduceat(np.abs(value - np.repeat(mean, size[size > 0])), first[:-1][size > 0]) / size[size > 0]
    order = np.argsort(-n_runs, kind="stable")
    offset, n_runs, cost = offset[:-1][order], n_runs[order], price * spread[order]
    # sums before a run, from the list's begin; f of list i at place j is best[offset[i] + i + j]
    sums, counts = (np.concatenate(([0.0], np.cumsum(x))) for x in (total, count))
    width = min(WINDOW, int(n_runs[0]))
    best = np.full((len(order), width), np.inf)  # f(j - b), b = 1 ...
    best[:, 0] = 0.0
    greatest = np.zeros((len(order), width))
    back = np.arange(1, width + 1)
    chosen = np.zeros(len(run), dtype=np.int64)
    for j in range(1, int(n_runs[0]) + 1):
        live = int(np.searchsorted(-n_runs, -j, side="right"))
        at = offset[:live] + j  # past the run that ends the block
        greatest[:live, 1:] = greatest[:live, :-1]
        greatest[:live, 0] = 0.0
        np.maximum(greatest[:live], most[at - 1][:, None], out=greatest[:live])
        begin = np.maximum(at[:, None] - back, 0)
        error = (counts[at][:, None] - counts[begin]) * greatest[:live] - (sums[at][:, None] - sums[begin])
        whole = best[:live] + error
        pick = np.argmin(whole, axis=1)
        chosen[at - 1] = pick + 1
        f = whole[np.arange(live), pick] + cost[:live]
        best[:live, 1:] = best[:live, :-1]
        best[:live, 0] = f
    starts = np.zeros(len(run), dtype=bool)
    at = offset + n_runs
    open_ = np.flatnonzero(n_runs > 0)
    while len(open_):  # from each list's end backwards, one block at a time
        at[open_] -= chosen[at[open_] - 1]
        starts[at[open_]] = True
        open_ = open_[at[open_] > offset[open_]]
    return run[starts]


class Shard:
    """Inverted lists of one shard in blocks of variable size; texts are numbered in order of doc_id."""

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, texts: np.ndarray, term: np.ndarray, tf: np.ndarray, size: int, all_texts: int, all_terms: int):
        order = np.argsort(doc_ids, kind="stable")
        self.doc_ids = doc_ids[order]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        by = np.lexsort((number[texts], term))
        self.doc = number[texts][by]
        m = 75 + (25 * n.astype(np.int64) * all_texts) // all_terms
        tf = tf.astype(np.int64)[by]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[texts[by]])
        self.first = np.searchsorted(term[by], np.arange(size + 1))
        begin = cut(self.impact, self.first)
        self.from_doc = self.doc[begin]
        self.to_doc = self.doc[np.append(begin, len(self.doc))[1:] - 1] + 1 if len(begin) else begin
        self.most = np.maximum.reduceat(self.impact, begin) if len(begin) else begin
        self.block = np.searchsorted(begin, self.first)

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """An upper bound of each text's score."""
        n = len(self.doc_ids)
        step, short = np.zeros(n + 1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for t, w in zip(term.tolist(), weight.tolist()):
            a, b = self.first[t], self.first[t + 1]
            if (b - a) * SHORT <= n:
                short[self.doc[a:b]] += w * self.impact[a:b]
            else:  # blocks of one list do not overlap
                own = slice(self.block[t], self.block[t + 1])
                step[self.from_doc[own]] += w * self.most[own]
                step[self.to_doc[own]] -= w * self.most[own]
        return np.cumsum(step[:-1]) + short

    def scores(self, texts: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of some texts (numbers in order)."""
        total = np.zeros(len(texts), dtype=np.int64)
        place = None
        for t, w in zip(term.tolist(), weight.tolist()):
            a, b = self.first[t], self.first[t + 1]
            if b - a > 16 * len(texts):
                at = a + np.searchsorted(self.doc[a:b], texts)
                hit = np.flatnonzero((at < b) & (self.doc[np.minimum(at, b - 1)] == texts))
                total[hit] += w * self.impact[at[hit]]
            else:
                if place is None:
                    place = np.full(len(self.doc_ids), -1, dtype=np.int64)
                    place[texts] = np.arange(len(texts))
                own = place[self.doc[a:b]]
                hit = np.flatnonzero(own >= 0)
                total[own[hit]] += w * self.impact[a + hit]
        return total

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, least: int, chunk: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """(doc_ids, scores, texts scored): the k best of positive score that reach ``least``, ties to smaller doc_ids."""
        bound = self.bounds(term, weight)
        able = np.flatnonzero(bound >= max(least, 1))
        able = able[np.argsort(-bound[able], kind="stable")]
        found, score, done, looked = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        while done < len(able):
            part = able[done : done + chunk]
            floor = max(least, int(score[-1]) if len(score) == k else 1)
            part = np.sort(part[bound[part] >= floor])
            if not len(part):
                break  # no bound of those that follow reaches it either
            own, looked = self.scores(part, term, weight), looked + len(part)
            keep = own >= floor
            found, score = np.concatenate((found, part[keep])), np.concatenate((score, own[keep]))
            best = np.lexsort((found, -score))[:k]
            found, score, done, chunk = found[best], score[best], done + chunk, chunk * 4
        return self.doc_ids[found], score, looked


def _search_block(docs: DataFrame, items: Items, k: int, shard_docs: int, shard_postings: int) -> DataFrame | None:
    """(item, item_id, doc_id, score): at most k rows a task and item."""
    table = stored(postings(docs, items.vocabulary), "postings")
    totals = table.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    all_texts, all_terms = totals["N"], totals["L"]
    if not all_texts:
        return None
    size = len(items.vocabulary)
    df = frequencies(table, size)
    w = np.array([math.floor(1000 * math.log((2 * all_texts + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    weights = [w[t] * n for t, n in zip(items.terms, items.times)]
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(own.ids)

        def look(held: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(held)
            ids, n, m = (whole.column(c).to_numpy() for c in ("doc_id", "n", "m"))
            term, tf = (np.frombuffer(b"".join(whole.column(c).to_pylist()), dtype="<u4") for c in ("term", "tf"))
            shard = Shard(ids, n, np.repeat(np.arange(len(ids)), m), term.astype(np.int64), tf, size, all_texts, all_terms)
            for i, (t, v) in enumerate(zip(own.terms, weight)):
                doc, score = best[i]
                found, gained, _ = shard.search(t, v, k, int(score[-1]) if len(score) == k else 1)
                doc, score = np.concatenate((doc, found)), np.concatenate((score, gained))
                order = np.lexsort((doc, -score))[:k]
                best[i] = doc[order], score[order]

        held, n_docs, n_postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            n_docs, n_postings = n_docs + batch.num_rows, n_postings + int(np.sum(batch.column(2).to_numpy()))
            if n_docs >= shard_docs or n_postings >= shard_postings:
                look(held)
                held, n_docs, n_postings = [], 0, 0
        if n_docs:
            look(held)
        item = np.repeat(np.arange(len(best)), [len(d) for d, _ in best])
        doc, score = (np.concatenate([b[c] for b in best]) if best else none for c in (0, 1))
        ids = np.array(own.ids, dtype=np.int64)[item] if len(item) else none
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, ids, doc, score)], names=["item", "item_id", "doc_id", "score"])

    hits = stored(table.mapInArrow(run, "item long, item_id long, doc_id long, score long"), "hits")
    discard(table)
    return hits


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard_docs: int = 32_768, shard_postings: int = 4_000_000, item_block: int = 16_384) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best texts of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.where("item_id is not null").selectExpr("cast(item_id as long) item_id", "cast(text as string) text")
    parts = max(1, -(-asked.count() // item_block))
    found = None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text")
        hits = _search_block(docs, Items.of([(r["item_id"], r["text"]) for r in mine.collect()]), k, shard_docs, shard_postings)
        if hits is None:
            break
        hits = hits.withColumn("part", F.lit(part))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], RESULT)
    w = Window.partitionBy("part", "item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
