"""Nearest neighbours by multi-index hashing over learned, rotated binary codes.

1. A rotation is learned in numpy from a bounded sample (``sample`` vectors): principal directions,
   then iterative quantisation, several times from different random starts.  The signs of the rotated
   coordinates are a vector's code of ``bits`` bits.
2. Codes are cut into byte substrings, each indexed: a table lists the vectors of each byte value.  If
   two codes differ in at most r bits, then by the pigeonhole principle they differ in at most
   floor(r / substrings) bits in one substring at least, so probing all byte values that near in every
   table retrieves every code within the Hamming radius.
3. What is retrieved is filtered by its full Hamming distance and reranked by the exact cosine of the
   original vectors in double precision.  The radius grows, from a
   first guess, until at least ``enough`` codes
   lie within it (or all do), so sparse regions search further.

Vectors are indexed in blocks, one task each; queries are shared with the tasks in blocks of at most
``query_block``, and each task returns k rows a query.  The radius is settled per block of vectors, so
every block contributes its own nearest and a merge takes the k best of all.

Vectors that are null, zero, or hold null or non-finite components take no part; those of another
length than the commonest (of equally common ones the shortest) take none either.  Ties go to the
smaller id.  A query passes over its own row only: other rows of its id, be their vectors equal or not,
are candidates, and each of several query rows of one id has k results of its own.  Rows without
vec_id take no part; columns but vec_id, embedding and those the condition reads are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS_OF = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: byte values in order of their distance to 0; those nearest to b are b ^ these
_NEAR = np.argsort(_BITS_OF, kind="stable").astype(np.uint8)
_WITHIN = np.searchsorted(_BITS_OF[_NEAR], np.arange(9), side="right")


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 20) -> np.ndarray:
    """dims x bits: blocks of orthogonal directions that quantise the sample's principal coordinates well."""
    rng = np.random.default_rng(11)
    dims = sample.shape[1]
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(x.T @ x)
    blocks = []
    for _ in range(-(-bits // dims)):
        rotation, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
        projected = x @ axes.T
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(projected @ rotation).T @ projected)
            rotation = vt.T @ u.T
        blocks.append(axes.T @ rotation)
    return np.concatenate(blocks, axis=1)[:, :bits]


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(vectors @ rotation > 0, axis=1)


class MultiIndex:
    """Tables of one block of codes: for each substring, its vectors in order of their byte value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.begin = [np.concatenate(([0], np.cumsum(np.bincount(codes[:, j], minlength=256)))) for j in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All vectors whose code differs from ``code`` in at most ``radius`` bits."""
        m = len(code)
        seen = np.zeros(len(self.codes), dtype=bool)
        # r = q m + s: some substring differs in at most q - 1 bits, or one of the first s + 1 in at most q
        q, s = divmod(radius, m)
        for j in range(m):
            near = min(8, q if j <= s else q - 1)
            if near < 0:
                continue
            values = code[j] ^ _NEAR[: _WITHIN[near]]
            if len(values) > 16:  # most of the table: one look-up a row costs less than the lists
                probed = np.zeros(256, dtype=bool)
                probed[values] = True
                seen |= probed[self.codes[:, j]]
                continue
            rows, begin = self.rows[j], self.begin[j]
            for value in values.tolist():
                seen[rows[begin[value] : begin[value + 1]]] = True
        found = np.flatnonzero(seen)
        return found[_BITS_OF[self.codes[found] ^ code].sum(axis=1) <= radius]

    def search(self, code: np.ndarray, enough: int, step: int) -> np.ndarray:
        bits, enough = 8 * len(code), min(enough, len(self.codes))
        some = np.sort(_BITS_OF[self.codes[:512] ^ code].sum(axis=1))  # where to begin: less than the radius looked for, mostly
        radius = max(0, int(some[min(len(some) - 1, enough * len(some) // (2 * len(self.codes)))]) - step)
        while True:
            found = self.within(code, radius)
            if len(found) >= enough or radius >= bits:
                return found
            radius = min(bits, radius + step)


@dataclass
class Shared:
    rotation: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """Rows (vec_id, embedding as array<double>) that take part."""
    v = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    v = v.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    return v if dims is None else v.where(F.size("embedding") == dims)


def nearest(vectors: DataFrame, is_query: str, k: int = 5, bits: int = 256, sample: int = 4096, enough: int = 400, step: int = 8, block_rows: int = 8192, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which the SQL condition holds."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    first = usable(vectors).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return spark.createDataFrame([], empty)
    v = usable(vectors, first["n"])
    drawn = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    rotation = learn_rotations(np.array(drawn["embedding"].tolist(), dtype=np.float64), bits)
    total = first["count"]
    n_queries = v.where(is_query).count()
    blocks = max(1, -(-total // block_rows))
    parts = max(1, -(-n_queries // query_block))
    dealt = v.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)))
    found = None
    for part in range(parts):
        mine = v.where(is_query).where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)) == part).toPandas()
        if not len(mine):
            continue
        matrix = np.array(mine["embedding"].tolist(), dtype=np.float64)
        shared = spark.sparkContext.broadcast(Shared(rotation, mine["vec_id"].to_numpy(), matrix))

        def search(pdf: pd.DataFrame, *, shared: Broadcast = shared, number: int = part) -> pd.DataFrame:
            s = shared.value
            ids, x = pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), dtype=np.float64)
            unit = np.linalg.norm(x, axis=1)
            index, codes = MultiIndex(encode(x, s.rotation)), encode(s.vectors, s.rotation)
            norms = np.linalg.norm(s.vectors, axis=1)
            out = []
            for i, (query, code) in enumerate(zip(s.ids.tolist(), codes)):
                rows = index.search(code, enough + 1, step)
                same = np.flatnonzero(ids[rows] == query)
                own = same[(x[rows[same]] == s.vectors[i]).all(axis=1)][:1]  # equal rows are in one block
                rows = np.delete(rows, own)
                score = (x[rows] @ s.vectors[i]) / (unit[rows] * norms[i])
                best = np.lexsort((ids[rows], -score))[:k]
                out.append(pd.DataFrame({"part": number, "row": i, "query_id": query, "vec_id": ids[rows[best]], "score": score[best]}))
            return pd.concat(out) if out else pd.DataFrame({"part": [], "row": [], "query_id": [], "vec_id": [], "score": []})

        hits = dealt.groupBy("block").applyInPandas(search, "part int, row int, query_id long, vec_id long, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], empty)
    w = Window.partitionBy("part", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
