"""Language identification: averaged hashed subword embeddings and a linear softmax, trained here by
stochastic gradient descent in numpy, with a temperature and a rejection threshold fitted on rows
kept back from training.

A text's subwords are the byte 3-grams and 5-grams inside its words (ASCII letters in lower case, a
blank at either end).  Averaging and the linear layer commute, so prediction needs one table of
bucket x language scores: every whole text costs a few numpy passes.

The classifier learns from a bounded sample: about ``sample`` labelled rows, evenly over languages.

Edge cases: a null text or one without a letter is ``und`` with score 0 and is not accepted; texts of
any length are read whole; repeated rows are predicted alike; rows with null lang are never learned
from; with no labelled row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.session import small_batches
from inkmill.llm.textkit import U64, slices

BUCKETS = 1 << 16
_SUBWORD_BYTE = np.full(256, 32, dtype=np.uint8)
_SUBWORD_BYTE[97:123] = np.arange(97, 123)
_SUBWORD_BYTE[65:91] = np.arange(97, 123)
_SUBWORD_BYTE[128:] = np.arange(128, 256)


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, where each text's begin (one more at the end), and ASCII letters of each text."""
    raw = [b" " + (t or "").encode("utf-8", "surrogatepass") + b"    " for t in texts]
    buf = _SUBWORD_BYTE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    edge = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    blank = buf == 32
    wide = buf.astype(np.uint64)
    found, where = [], []
    for n in (3, 5):
        size = len(buf) - n + 1
        if size <= 0:
            continue
        inner = blank[1 : size + 1].copy()
        for j in range(2, n - 1):
            inner |= blank[j : j + size]
        at = np.flatnonzero(~inner)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * U64(0x100000001B3) + wide[at + j]
        found.append(((h * U64(0x9E3779B97F4A7C15)) >> U64(48)).astype(np.int64))
        where.append(at)
    bucket, place = np.concatenate(found), np.concatenate(where)
    owner = np.searchsorted(edge, place, side="right")
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(1, len(texts) + 2))
    letters = np.concatenate(([0], np.cumsum((buf >= 97) & (buf < 123))))
    return bucket[order], first, letters[edge[1:]] - letters[edge[:-1]]


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    least: float  # predictions below this score are rejected

    def logits(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(first), 1)
        out = np.empty((len(first) - 1, len(self.labels)))
        for k in range(len(self.labels)):
            total = np.concatenate(([0.0], np.cumsum(self.table[:, k][bucket], dtype=np.float64)))
            out[:, k] = (total[first[1:]] - total[first[:-1]]) / n + self.bias[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.labels:
            for a, b in slices([len(t or "") for t in texts]):
                bucket, first, letters = subwords(texts[a:b])
                p = softmax(self.logits(bucket, first) / self.temperature)
                best = p.argmax(axis=1)
                for i in range(b - a):
                    t = texts[a + i]
                    if t and (letters[i] or any(c.isalpha() for c in t)):
                        names[a + i], scores[a + i] = self.labels[best[i]], float(min(1.0, p[i, best[i]]))
        return names, scores, [n != "und" and s >= self.least for n, s in zip(names, scores)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 0.6, most_wrong: float = 0.01) -> LanguageModel:
    """Train on (lang, buckets, counts) rows; every fifth is kept back for calibration."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(7)
    known = {name: i for i, name in enumerate(labels)}
    embed, linear, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(labels))), np.zeros(len(labels))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    kept, train = (rows[::5], [r for i, r in enumerate(rows) if i % 5]) if len(rows) >= 50 else (rows, rows)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            lang, bucket, count = train[i]
            if len(bucket):
                share = count / count.sum()
                x = share @ embed[bucket]
                z = x @ linear + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[known[lang]] -= 1
                step = rate * (1 - done / steps)
                back = linear @ p
                linear -= step * np.outer(x, p)
                bias -= 0.1 * step * p
                embed[bucket] -= step * len(bucket) ** 0.5 * np.outer(share, back)
            done += 1
    model = LanguageModel(labels, (embed @ linear).astype(np.float32), bias, 1.0, 0.0)
    z = np.array([(c / max(c.sum(), 1)) @ model.table[b] + bias for _, b, c in kept])
    truth = np.array([known[r[0]] for r in kept])
    grid = np.geomspace(0.05, 5, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).sum()))
    p = softmax(z / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    model.least = float(score[order][np.flatnonzero(wrong <= most_wrong)[-1]]) if (wrong <= most_wrong).any() else 1.0
    return model


def train(labelled: DataFrame, sample: int = 6000) -> LanguageModel:
    """Learn from (text, lang, draw): about ``sample`` rows with non-null lang, by the lowest ``draw``
    (a uniform hash in 0..1) of each language."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null")
    count = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # as many rows as languages
    if not count:
        return fit([])
    each = sample / len(count)
    share = F.create_map([F.lit(v) for lang, n in count.items() for v in (lang, min(1.0, each / n))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            bucket, first, _ = subwords(batch.column(0).to_pylist())
            for lang, a, b in zip(batch.column(1).to_pylist(), first[:-1], first[1:]):
                kinds, n = np.unique(bucket[a:b], return_counts=True)
                for column, v in zip(out, (lang, kinds.astype("<u2").tobytes(), n.astype("<u4").tobytes())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["lang", "bucket", "n"])

    drawn = labelled.where(F.col("draw") < share[F.col("lang")]).select("text", "lang", "draw").orderBy("draw", "lang").limit(2 * sample)
    rows = drawn.select("text", "lang").mapInArrow(features, "lang string, bucket binary, n binary").collect()
    return fit([(r["lang"], np.frombuffer(r["bucket"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(float)) for r in rows])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of each row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, accepted = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
