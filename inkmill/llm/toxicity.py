"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Fitting takes a bounded, uniform sample of labelled rows (``sample``).  Terms are words and the byte
5-grams in them (a blank at either end), hashed.  Most terms of a text say nothing about the label and
would drown a cosine, so the vocabulary is those terms whose examples are toxic at three times the
overall rate (or half-way from it to 1) and by a likelihood-ratio statistic beyond what chance gives for as many terms
tried.  All such terms are taken; the sample bounds how many there can be.  Examples are weighted (1 + ln tf) * idf over it, with unit length.

The index keeps each term's postings in blocks of example numbers with the greatest weight in each.  A
text's blocks are read in order of their upper bound until no block can hold a better neighbour, so
the k nearest are exact (ties to the smaller example number).  Each votes with its label, weighted by
distance; a fixed weight of the overall rate keeps few votes modest.  The raw score is calibrated by
isotonic regression on the sample's leave-one-out scores.  The neighbours are returned as evidence.

Edge cases: null and empty texts, and texts without any term of the vocabulary, have no neighbours and
get the calibrated rate of such examples; whole texts are read; equal texts score alike; rows with a
null label are not learned from; with no label at all every score is 0; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.session import discard, small_batches, stored
from inkmill.llm.textkit import U64, mix, slices, span_hash

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[48:58] = np.arange(48, 58)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
GRAM = 5
BLOCK = 256


def terms(texts: list[str | None], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts with repeats, and where each text's begin (one more at the end).
    With ``kept``, a table over the low bits of hashes, only terms that it marks."""
    raw = [b" " + (t or "").encode("utf-8", "surrogatepass") + b"      " for t in texts]
    buf = _LETTER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    edge = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    blank = buf == 32
    wide = buf.astype(np.uint64)
    size = max(0, len(buf) - GRAM + 1)
    gram = np.full(size, 5, dtype=np.uint64)
    for j in range(GRAM):
        gram = gram * U64(0x100000001B3) + wide[j : j + size]
    at = np.flatnonzero(~(blank[1 : size + 1] | blank[2 : size + 2] | blank[3 : size + 3])) if size else np.zeros(0, np.int64)
    gram = mix(gram[at])
    flips = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    start, word = flips[0::2], span_hash(buf, flips[0::2], flips[1::2])
    if kept is not None:
        some = kept[gram & U64(len(kept) - 1)]
        at, gram = at[some], gram[some]
        some = kept[word & U64(len(kept) - 1)]
        start, word = start[some], word[some]
    # both are in text order: each text's grams, then its words
    g, w = np.searchsorted(at, edge), np.searchsorted(start, edge)
    out, first = np.empty(len(gram) + len(word), dtype=np.uint64), g + w
    for a, b, c, d, e in zip(g[:-1].tolist(), g[1:].tolist(), w[:-1].tolist(), w[1:].tolist(), first.tolist()):
        out[e : e + b - a] = gram[a:b]
        out[e + b - a : e + b - a + d - c] = word[c:d]
    return out, first


class BlockMax:
    """Inverted lists of unit vectors, in blocks of BLOCK examples with each block's greatest weight."""

    def __init__(self, n_terms: int, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.size = len(vectors)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        key = term[order] * (self.size // BLOCK + 1) + self.example // BLOCK
        self.key, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_first = np.searchsorted(self.key, np.arange(n_terms + 1) * (self.size // BLOCK + 1))
        self.block = self.key % (self.size // BLOCK + 1)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest with a positive cosine; ``leave`` is passed over."""
        bound = np.zeros(self.size // BLOCK + 1)
        parts: dict[int, list[tuple[int, float]]] = {}
        for t, w in zip(term.tolist(), weight.tolist()):
            a, b = self.term_first[t], self.term_first[t + 1]
            bound[self.block[a:b]] += w * self.most[a:b]
            for i in range(a, b):
                parts.setdefault(int(self.block[i]), []).append((i, w))
        bound = np.round(bound + 1e-12, 9)  # cosines count to nine places; no bound is below its block's
        order = np.argsort(-bound, kind="stable")
        found, score = np.zeros(0, np.int64), np.zeros(0)
        for block in order.tolist():
            if bound[block] <= 0 or (len(score) == k and bound[block] < score[-1]):
                break
            if len(score) == k and bound[block] == score[-1] and block * BLOCK > found[-1]:
                continue  # at best a tie with a greater number
            total = np.zeros(BLOCK)
            for i, w in parts[block]:
                a, b = self.first[i], self.first[i + 1]
                total[self.example[a:b] - block * BLOCK] += w * self.weight[a:b]
            total = np.round(total, 9)
            own = np.flatnonzero(total > 0)
            own = own[own + block * BLOCK != leave]
            found, score = np.concatenate((found, own + block * BLOCK)), np.concatenate((score, total[own]))
            best = np.lexsort((found, -score))[:k]
            found, score = found[best], score[best]
        return found, score


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    doc_ids: np.ndarray
    labels: np.ndarray
    index: BlockMax
    rate: float
    k: int = 15
    prior: float = 1.0
    width: float = 0.35
    steps: np.ndarray = field(default_factory=lambda: np.array([0.0]))  # raw scores of the calibration
    values: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def vector(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.vocabulary, hashed)
        at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashed] if len(self.vocabulary) else at[:0]
        return self._weigh(*np.unique(at, return_counts=True))

    def _weigh(self, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(np.maximum(tf, 1))) * self.idf[term]
        norm = np.sqrt((w * w).sum())
        return term, w / norm if norm else w

    def raw(self, vector: tuple[np.ndarray, np.ndarray], leave: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        found, score = self.index.nearest(*vector, self.k, leave) if len(vector[0]) else (np.zeros(0, np.int64), np.zeros(0))
        vote = np.exp(-(1 - np.minimum(score, 1)) / self.width)
        return float((vote @ self.labels[found] + self.prior * self.rate) / (vote.sum() + self.prior)), found, score

    def scores(self, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """Calibrated score and neighbours (example number, cosine) of each text."""
        nothing = self.calibrated(self.raw((np.zeros(0, np.int64), np.zeros(0)))[0])
        scores, near, known = [], [], {}
        kept = np.zeros(1 << 20, dtype=bool)
        kept[self.vocabulary & U64(len(kept) - 1)] = True
        for a, b in slices([len(t or "") for t in texts]):
            hashed, first = terms(texts[a:b], kept)
            for x, y in zip(first[:-1], first[1:]):
                vector = self.vector(hashed[x:y])
                key = vector[0].tobytes() + vector[1].tobytes()
                if key not in known:  # copies are looked up once
                    raw, found, cosine = self.raw(vector) if len(vector[0]) else (None, (), ())
                    known[key] = nothing if raw is None else self.calibrated(raw), list(zip(found, cosine))
                scores.append(known[key][0])
                near.append(known[key][1])
        return scores, near

    def calibrated(self, raw: float) -> float:
        return float(np.clip(np.interp(raw, self.steps, self.values), 0, 1))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of blocks in order of x, at the blocks' mean x."""
    blocks: list[list[float]] = []
    for a in np.unique(x):
        own = y[x == a]
        blocks.append([float(own.sum()), float(len(own)), float(a) * len(own)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> ToxicityModel:
    """Learn from at most ``sample`` rows of ``labels`` (doc_id, toxic), drawn evenly by a hash of
    doc_id, and the texts of ``docs`` (doc_id, text).  What is broadcast and kept has that bound."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.where("toxic is not null and doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic")
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.withColumn("draw", draw).where(F.col("draw") < min(1.0, 1.1 * sample / max(n, 1))).orderBy("draw", "doc_id", "toxic").limit(sample).select("doc_id", "toxic")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    drawn = stored(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    positive, size = (x or 0 for x in drawn.agg(F.sum(F.when(F.col("toxic") == 1, 1)), F.count("*")).first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, first = terms(batch.column(1).to_pylist())
            toxic = batch.column(2).to_numpy() == 1
            each = [np.unique(hashed[a:b]) for a, b in zip(first[:-1], first[1:])]
            kinds, inverse = np.unique(np.concatenate(each), return_inverse=True)
            label = np.repeat(toxic, [len(e) for e in each])
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(kinds))), pa.array(np.bincount(inverse, label, minlength=len(kinds)).astype(np.int64))], names=["term", "df", "df_toxic"])

    counts = drawn.mapInArrow(count, "term long, df long, df_toxic long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("df_toxic").alias("dt")).where("df >= 3")
    rate = positive / size if size else 0.0

    def part(seen: str, all_: str) -> str:  # k ln(k / expected)
        return f"if({seen} > 0, {seen} * ln({seen} * {float(size)}D / ({all_})), 0D)"

    g2 = f"2 * ({part('dt', f'df * {float(positive)}D')} + {part('(df - dt)', f'df * {float(size - positive)}D')} + {part(f'({positive}L - dt)', f'({size}L - df) * {float(positive)}D')} + {part(f'({size - positive}L - df + dt)', f'({size}L - df) * {float(size - positive)}D')})"
    tried, rows = 0, []
    if 0 < positive < size:
        scored = counts.withColumn("g2", F.expr(g2))
        top = scored.where(f"g2 > 15 and dt / df > {min(3 * rate, (1 + rate) / 2)}D").select("term", "df", "g2").collect()
        tried = max(2, counts.count())
        rows = [r for r in top if r["g2"] > 2 * np.log(tried)]
    order = np.argsort(np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)) if rows else []
    known = np.array([rows[i]["term"] for i in order], dtype=np.int64).view(np.uint64)
    idf = np.array([np.log((1 + size) / (1 + rows[i]["df"])) + 1 for i in order])
    shared = spark.sparkContext.broadcast(known)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, first = terms(batch.column(1).to_pylist())
            ids, tfs = [], []
            for a, b in zip(first[:-1], first[1:]):
                at = np.searchsorted(shared.value, hashed[a:b])
                at = at[shared.value[np.minimum(at, len(shared.value) - 1)] == hashed[a:b]] if len(shared.value) else at[:0]
                term, tf = np.unique(at, return_counts=True)
                ids.append(term.astype("<u4").tobytes())
                tfs.append(tf.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "toxic", "term", "tf"])

    examples = sorted(drawn.mapInArrow(features, "doc_id long, toxic int, term binary, tf binary").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["term"]))
    discard(drawn)
    labels = np.array([float(r["toxic"] == 1) for r in examples])
    model = ToxicityModel(known, idf, np.array([-1 if r["doc_id"] is None else r["doc_id"] for r in examples], dtype=np.int64), labels, BlockMax(0, []), rate)
    vectors = [model._weigh(np.frombuffer(r["term"], "<u4").astype(np.int64), np.frombuffer(r["tf"], "<u4")) for r in examples]
    model.index = BlockMax(len(known), vectors)
    if examples:
        raw = np.array([model.raw(v, leave=i)[0] for i, v in enumerate(vectors)])
        model.steps, model.values = isotonic(raw, labels)
    return model


def score(docs: DataFrame, model: ToxicityModel, evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, evidence) of each row of (doc_id, text); evidence: the nearest
    examples' doc_id, cosine and label."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, near = m.scores(batch.column(1).to_pylist())
            why = [[{"doc_id": int(m.doc_ids[e]), "cosine": float(c), "toxic": int(m.labels[e])} for e, c in n[:evidence]] for n in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(why, kind)], names=["doc_id", "score", "predicted", "evidence"])

    ddl = "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)


def keep(docs: DataFrame, model: ToxicityModel, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores less than ``below``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < below for s in shared.value.scores(batch.column(at).to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
