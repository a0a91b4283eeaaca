"""Exact vector search and exact similarity joins.

Search and the join of dense vectors are matrix products: vectors are dealt into blocks of bounded size; a task
multiplies two blocks with numpy and returns only what is asked for (the k best, or pairs over the threshold).
Sparse vectors are joined through inverted lists of the part of each vector that a partner must touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import vectors as V
from inkmill.functions.vectors import cosine
from inkmill.sources.scratch import settled


def top_k(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(id, similarity) of the k nearest to one query, ties by id: a scan and a bounded sort."""
    q = f"array({', '.join(f'{float(x)!r}D' for x in query)})"
    scored = vectors.withColumn("similarity", cosine("vector", q))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


#: Similarities that a search holds at a time, and hits before they are cut to the k best of each query.
CELLS, HITS = 1 << 20, 1 << 18


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, skip_self: bool = True, places: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest vectors (id, vector) of each query (query_id,
    vector), with ``skip_self`` but for the one of its own id; ties to the smaller id.  Both may be sparse and of unit
    length instead (at, weight).  Queries are shared with the tasks ``block`` at a time; a task multiplies them with so many
    vectors at a time that their similarities are at most ``CELLS``, and keeps the k best of each query.
    With ``places`` similarities are rounded to so many before they are compared."""
    spark = vectors.sparkSession
    query_kind, kind = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    held = ["vector"] if "vector" in vectors.columns else ["at", "weight"]
    slack = 0.0 if places is None else 2 * 10.0**-places
    n = queries.count()
    parts = max(1, -(-n // block))
    found = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        if not len(mine):
            continue
        if held == ["vector"]:
            asked = _unit(np.array(mine["vector"].tolist(), dtype=np.float64))
        else:
            asked = np.zeros((len(mine), 1 + max((max(p) for p in mine["at"] if len(p)), default=0)))
            for row, (p, x) in enumerate(zip(mine["at"], mine["weight"])):
                asked[row, np.asarray(p, dtype=np.int64)] = x
        shared = spark.sparkContext.broadcast((mine["query_id"].to_numpy(), asked))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            step = max(1, CELLS // len(ids))
            edge = np.full(len(ids), -np.inf)  # the k-th similarity so far
            best, more, waiting = None, [], 0

            def cut() -> pd.DataFrame:
                hits = pd.concat(([] if best is None else [best]) + more, ignore_index=True).sort_values(["at", "similarity", "id"], ascending=[True, False, True]).groupby("at").head(k)
                full = hits.groupby("at")["similarity"].agg(["size", "min"])
                full = full[full["size"] >= k]
                edge[full.index.to_numpy()] = full["min"].to_numpy()
                return hits

            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    rows = pa.Table.from_batches([batch.slice(begin, step)])
                    own = rows["id"].to_numpy()
                    score = q @ _dense_rows(rows, q.shape[1]).T
                    if skip_self:
                        score[ids[:, None] == own[None, :]] = -np.inf
                    # of each query the rows that reach its k-th similarity, ties at the border too
                    least = edge if score.shape[1] <= k else np.maximum(edge, np.partition(score, -k, axis=1)[:, -k])
                    at, row = np.nonzero((score >= least[:, None] - slack) & np.isfinite(score))
                    similarity = score[at, row] if places is None else np.round(score[at, row], places)
                    more.append(pd.DataFrame({"at": at, "id": own[row], "similarity": similarity}))
                    waiting += len(at)
                    if waiting > HITS or best is None:
                        best, more, waiting = cut(), [], 0
            if more or best is not None:
                best = cut()
                # a piece at a time, as ids may be long
                for c in range(0, len(best), FOUND):
                    out = best.iloc[c : c + FOUND]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[out["at"].to_numpy()]), "id": pa.array(out["id"].to_numpy()), "similarity": pa.array(out["similarity"].to_numpy(), pa.float64())})

        rows = vectors.select("id", *held).where(F.col(held[-1]).isNotNull())
        hits = rows.mapInArrow(search, f"query_id {query_kind}, id {kind}, similarity double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"query_id {query_kind}, rank int, id {kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _dense_rows(rows: pa.Table, width: int) -> np.ndarray:
    """The vectors of a table's rows, of unit length; of sparse ones the places below ``width``."""
    if "vector" in rows.column_names:
        return _unit(_matrix(rows["vector"])[0].astype(np.float64, copy=False).reshape(len(rows), -1))
    (at, sizes), x = _matrix(rows["at"]), _matrix(rows["weight"])[0]
    row, at = np.repeat(np.arange(len(rows)), sizes), at.astype(np.int64)
    out, some = np.zeros((len(rows), width)), at < width
    out[row[some], at[some]] = x[some]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


#: A dense join is used for vectors that are not zero in more than this share of their places.
DENSE = 0.25
#: A join multiplies every two blocks of rows; there are ``BLOCKS`` of them, more where one would exceed ``BLOCK_BYTES``,
#: which a task holds twice.  Rows of a long list are copied once for each of its blocks.  Pairs go back to Spark ``FOUND`` at a time.
BLOCKS, BLOCK_BYTES, FOUND = 10, 96 << 20, 65_536
#: A task sums pairs in arrays where there are at most so many sums.
KEYS = 1 << 22
#: Sparse rows are told apart by kind, at most ``KINDS`` of them and one for 2,048 rows, learned from ``LEARNED`` rows: ``SHARE`` of the squares of a
#: kind's rows lie in its places, and at most ``REST`` of a row's length outside; other rows are of no kind.
KINDS, LEARNED, SHARE, REST = 8, 4096, 0.98, 0.2
#: Products of unit rows in single precision are off by less than this; those that may reach the threshold are computed anew.
OFF = 5e-5
#: Rows that are multiplied at a time by all of a piece, and the share of hits from which on all are multiplied in double precision.
STRIP, MANY = 256, 0.02
#: A pair of a list takes so many times the work of a pair of blocks, whose rows are told apart by kind.
LISTS = 5


def similar_pairs(items: DataFrame, threshold: float, block: int = 2048, counts: dict[int, int] | None = None, idf: list[float] | None = None, by: list[str] | None = None, edges: tuple[float, ...] = ()) -> DataFrame:
    """(id1, id2, book1, book2, similarity) of items of different books, book1 < book2, with cosine >= threshold
    (which is positive); where books have an order of their own, ``book`` is the place in it.  Any other column c of
    the items comes along as c1 and c2, so that pairs, which may be very many, need not be joined with it.

    Items are (id, book, vector) or, sparse and of unit length, (id, book, at, weight) with ``at`` ascending; or, with
    the places' ``idf``, (id, book, at, n), which weigh (1 + ln n) * idf, of unit length: copies of these are small.  Vectors
    that are mostly zeros go through inverted lists where these multiply fewer pairs than there are, others
    block by block.  A task multiplies ``block`` by ``block`` items at a time.  ``counts``: in how many sparse
    items each place is, or about; they order the places and decide nothing.

    With ``by``, columns of pairs, the pairs are told together: (*by, band, n, total, least, most), how many pairs have the
    same values in these columns and reach the same number, ``band``, of ``edges``, and their similarities' sum, least and
    greatest.  Tasks sum their own pairs, so what leaves them does not grow with the pairs."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    joined = _joined(items, threshold, block, counts, idf, _Told(by, edges) if by is not None else None)
    if by is None:
        return joined
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")]
    return joined.groupBy(*by, "band").agg(*sums)


def _joined(items: DataFrame, threshold: float, block: int, counts: dict[int, int] | None, idf: list[float] | None, told: _Told | None) -> DataFrame:
    if "vector" not in items.columns:
        return _by_lists(items, threshold, block, counts, idf, told)
    filled = F.size(F.expr("filter(vector, x -> x <> 0)"))
    size = items.agg(F.count("*").alias("n"), F.sum(filled).alias("filled"), F.sum(F.size("vector")).alias("places")).first()
    if not size["n"]:
        return items.sparkSession.createDataFrame([], _pairs_ddl(items, told))
    others = _others(items)
    if (size["filled"] or 0) > DENSE * (size["places"] or 0):
        return _by_blocks(items.select("id", "book", F.col("vector").alias("x"), *others), threshold, block, size["n"], 8 * size["places"], None, told)
    unit = items.select("id", "book", *others, V.normalise("vector").alias("vector"))
    sparse = unit.select("id", "book", *others, F.expr("filter(transform(vector, (x, i) -> if(x <> 0, i, null)), i -> i is not null)").alias("at"), F.expr("filter(vector, x -> x <> 0)").alias("weight"))
    return _by_lists(sparse, threshold, block, counts, None, told)


def _others(items: DataFrame) -> list[str]:
    return [c for c in items.columns if c not in ("id", "book", "vector", "at", "weight", "n", "p", "x", "led", "list", "lo", "hi", "side", "b", "cuts")]


def _pairs_ddl(items: DataFrame, told: _Told | None) -> str:
    kinds = dict(items.dtypes)
    if told is not None:
        return ", ".join([*(f"`{c}` {kinds[c[:-1]]}" for c in told.by), "band int, n long, total double, least double, most double"])
    each = lambda c: f"`{c}1` {kinds[c]}, `{c}2` {kinds[c]}"
    return ", ".join([each("id"), each("book"), "similarity double", *map(each, _others(items))])


@dataclass
class _Told:
    """What a task sums of its pairs: see ``similar_pairs``."""

    by: list[str]
    edges: tuple[float, ...]

    def begin(self, columns: dict[str, pa.Array]) -> None:
        coded = [columns[c[:-1]].dictionary_encode(null_encoding="encode") for c in self.by]
        self.values = [c.dictionary for c in coded]
        self.codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
        keys = (len(self.edges) + 1) * int(np.prod([float(len(v)) for v in self.values]))
        #: Sums by key, where these are few enough for an array, or else parts of them.
        self.arrays = [np.zeros(keys, np.int64), np.zeros(keys), np.full(keys, np.inf), np.full(keys, -np.inf)] if keys <= KEYS else None
        self.sums: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, at: np.ndarray, to: np.ndarray, similarity: np.ndarray) -> None:
        """Pairs by the rows of both."""
        key, band = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for e in self.edges:
            band += similarity >= e
        for name, code, values in zip(self.by, self.codes, self.values):
            key = key * len(values) + code[at if name[-1] == "1" else to]
        key = key * (len(self.edges) + 1) + band
        if self.arrays is not None:
            n, total, least, most = self.arrays
            np.add.at(n, key, 1)
            np.add.at(total, key, similarity)
            np.minimum.at(least, key, similarity)
            np.maximum.at(most, key, similarity)
            return
        each = pd.DataFrame({"key": key, "n": 1, "total": similarity, "least": similarity, "most": similarity})
        self.sums.append(self._summed(each))
        self.waiting += len(self.sums[-1])
        if self.waiting > HITS:
            self.sums = [self._summed(pd.concat(self.sums, ignore_index=True))]
            self.waiting = 0

    @staticmethod
    def _summed(each: pd.DataFrame) -> pd.DataFrame:
        return each.groupby("key", sort=False).agg({"n": "sum", "total": "sum", "least": "min", "most": "max"}).reset_index()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.arrays is not None:
            key = np.flatnonzero(self.arrays[0])
            each = pd.DataFrame({"key": key} | {k: x[key] for k, x in zip(("n", "total", "least", "most"), self.arrays)})
        elif self.sums:
            each = self._summed(pd.concat(self.sums, ignore_index=True))
        else:
            return
        for c in range(0, len(each), FOUND):
            part = each.iloc[c : c + FOUND]
            key, band = np.divmod(part["key"].to_numpy(), len(self.edges) + 1)
            out = {}
            for name, values in reversed(list(zip(self.by, self.values))):
                key, code = np.divmod(key, len(values))
                out[name] = values.take(pa.array(code))
            sums = {k: pa.array(part[k].to_numpy(), pa.int64() if k == "n" else pa.float64()) for k in ("n", "total", "least", "most")}
            yield pa.RecordBatch.from_pydict({name: out[name] for name in self.by} | {"band": pa.array(band, pa.int32())} | sums)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array, and how many each row has."""
    flat, sizes = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks], [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat) if flat else np.zeros(0), np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)


class _Side:
    """The rows of a block: unit vectors as a matrix or, if sparse, by their entries, of which those from ``led`` on
    of a row are indexed."""

    def __init__(self, rows: pa.Table, idf: np.ndarray | None = None):
        self.n = len(rows)
        if "p" in rows.column_names:
            (self.p, sizes), self.x = _matrix(rows["p"]), _matrix(rows["x"])[0]
            self.p = self.p.astype(np.int64)
            self.starts = np.concatenate(([0], np.cumsum(sizes)))
            if idf is not None:
                row = np.repeat(np.arange(self.n), sizes)
                x = (1 + np.log(self.x)) * idf[self.p]
                self.x = x / np.sqrt(np.bincount(row, x * x, minlength=self.n))[row]
            self.led = rows["led"].to_numpy() if "led" in rows.column_names else None
        else:
            self.p, self.x = None, _unit(_matrix(rows["x"])[0].reshape(self.n, -1)) if self.n else np.zeros((0, 0))

    def entries(self, begin: int, end: int) -> tuple[slice, np.ndarray]:
        e = slice(self.starts[begin], self.starts[end])
        return e, np.repeat(np.arange(end - begin), np.diff(self.starts[begin : end + 1]))

    def part(self, begin: int, end: int, column: np.ndarray, first: int, width: int) -> np.ndarray:
        """Rows begin to end, in the columns from ``first`` on; of a matrix in all of them."""
        if self.p is None:
            return self.x[begin:end]
        e, row = self.entries(begin, end)
        at = column[self.p[e]] - first
        some = (at >= 0) & (at < width)
        out = np.zeros((end - begin, width))
        out[row[some], at[some]] = self.x[e][some]
        return out

    def later(self, begin: int, end: int, column: np.ndarray, n: int, own: int) -> np.ndarray:
        """Bits: indexed places of the rows that come after ``own`` in the order."""
        e, row = self.entries(begin, end)
        p = self.p[e]
        at = column[p]
        some = (np.arange(e.start, e.stop) - self.starts[begin:end][row] >= self.led[begin:end][row]) & (p > own) & (at >= 0)
        bits = np.zeros((end - begin, -(-n // 8)), dtype=np.uint8)
        np.bitwise_or.at(bits, (row[some], at[some] >> 3), (1 << (at[some] & 7)).astype(np.uint8))
        return bits


class _Piece:
    """Rows begin to end of an arranged side, which are of one kind (-1: of none)."""

    def __init__(self, side: _Arranged, begin: int, end: int):
        self.side, self.rows, self.kind = side, slice(begin, end), int(side.kind[begin])
        entries = slice(side.starts[begin], side.starts[end])
        self.p, self.x = side.p[entries], side.x[entries]
        self.row = np.repeat(np.arange(end - begin, dtype=np.int32), np.diff(side.starts[begin : end + 1]))
        self.places = np.bincount(self.p, minlength=side.width) > 0
        self.most = int(np.diff(side.starts[begin : end + 1]).max())
        self.rest = float(side.rest[begin:end].max())

    def dense(self, keep: np.ndarray) -> np.ndarray:
        """The rows to keep, with all places."""
        at = np.cumsum(keep) - 1
        some = keep[self.row]
        out = np.zeros((int(keep.sum()), self.side.width))
        out[at[self.row[some]], self.p[some]] = self.x[some]
        return out

    def reach(self, other: _Piece) -> np.ndarray:
        """The most that each row's product with a row of the other piece can be: by its greatest weights, as many as
        that has places, and by its length in the places of the other's kind."""
        side, n = self.side, self.rows
        most = side.top(n, other.most)
        if other.kind >= 0:
            most = np.minimum(most, side.within[n, other.kind] + other.rest)
        if self.kind >= 0:
            other_most = other.side.within[other.rows, self.kind].max()
            most = np.minimum(most, side.within[n, self.kind] * other_most + side.rest[n])
        return most


class _Arranged:
    """The rows of a side with places, of unit length, dealt into pieces by kind, with like rows side by side."""

    def __init__(self, side: _Side, place: np.ndarray, kinds: _Kinds, tile: int):
        sizes = np.diff(side.starts)
        entry = np.repeat(np.arange(side.n), sizes)
        kind, within, rest = kinds.of(side.p, side.x, entry, side.n)
        common = np.bincount(place[place >= 0]).argmax() if (place >= 0).any() else -1
        some = np.flatnonzero((sizes > 0) & (place >= 0))
        order = some[np.lexsort((sizes[some], place[some] == common, rest[some] > 0, kind[some]))]
        self.width, self.number, self.place = kinds.width, order, place[order]
        self.kind, self.within, self.rest = kind[order], within[order], rest[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes[order])))
        entries = np.repeat(side.starts[order] - self.starts[:-1], sizes[order]) + np.arange(self.starts[-1])
        self.p, self.x = side.p[entries].astype(np.int32), side.x[entries]
        # weights in descending order within each row
        row = np.repeat(np.arange(len(order), dtype=np.float64), sizes[order])
        sorted_x = 1 - 2 * (np.sort(row + (1 - self.x) / 2) - row)
        self.squares = np.concatenate(([0.0], np.cumsum(sorted_x * sorted_x)))
        change = np.flatnonzero((np.diff(self.kind) != 0) | (np.diff((self.rest > 0).astype(int)) != 0) | (np.diff((self.place == common).astype(int)) != 0)) + 1
        self.pieces = []
        for begin, end in zip([0, *change], [*change, len(order)]):
            self.pieces += [_Piece(self, i, min(end, i + tile)) for i in range(begin, end, tile)]

    def top(self, rows: slice, n: int) -> np.ndarray:
        """The length of each row's n greatest weights."""
        begin, end = self.starts[rows.start : rows.stop], self.starts[rows.start + 1 : rows.stop + 1]
        return np.sqrt(np.maximum(0, self.squares[np.minimum(begin + n, end)] - self.squares[begin]))


class _Kinds:
    """Kinds of sparse unit rows, such as languages: centers, and of each its places."""

    def __init__(self, sides: list[_Side]):
        self.width = max((int(s.p.max()) for s in sides if len(s.p)), default=0) + 1
        parts = []
        for s in sides:
            for i in range(0, s.n, max(1, -(-s.n * len(sides) // LEARNED))):
                e = slice(s.starts[i], s.starts[i + 1])
                if e.stop > e.start:
                    parts.append(np.zeros(self.width, np.float32))
                    parts[-1][s.p[e]] = s.x[e]
        x = np.stack(parts) if parts else np.zeros((0, self.width), np.float32)
        centers = []
        if len(x):
            near = x @ x.mean(axis=0)
            for _ in range(min(KINDS, 1 + sum(s.n for s in sides) // 2048, len(x))):
                # the row that is least like those chosen
                centers.append(x[near.argmin()])
                like = x @ centers[-1]
                near = like if len(centers) == 1 else np.maximum(near, like)
        self.centers = np.stack(centers) if centers else np.zeros((1, self.width), np.float32)
        for _ in range(6 if len(x) else 0):
            own = (x @ self.centers.T).argmax(axis=1)
            for k in range(len(self.centers)):
                mean = x[own == k].sum(axis=0)
                if mean.any():
                    self.centers[k] = mean / np.linalg.norm(mean)
        own = (x @ self.centers.T).argmax(axis=1)
        self.places = np.zeros((len(self.centers), self.width), bool)
        for k in range(len(self.centers)):
            squares = (x[own == k] ** 2).sum(axis=0)
            order = np.argsort(-squares)
            some = np.cumsum(squares[order]) <= SHARE * squares.sum()
            self.places[k, order[: int(some.sum()) + 1]] = True

    def of(self, p: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows, given by their entries: the kind, the length in the places of each kind, and the length outside those of its own."""
        like = np.stack([np.bincount(row, x * c[p], minlength=n) for c in self.centers], axis=1)
        kind = like.argmax(axis=1)
        within = np.sqrt(np.stack([np.bincount(row, x * x * k[p], minlength=n) for k in self.places], axis=1))
        rest = np.sqrt(np.bincount(row, x * x * ~self.places[kind[row], p], minlength=n))
        return np.where(rest > REST, -1, kind), within, rest


def _arranged(sides: list[_Side], place: np.ndarray, tile: int) -> tuple[_Arranged, _Arranged]:
    """Both sides, or the only one twice; ``place``: the books of all rows."""
    kinds, begin, out = _Kinds(sides), 0, []
    for s in sides:
        out.append(_Arranged(s, place[begin : begin + s.n], kinds, tile))
        begin += s.n
    return out[0], out[-1]


def _close(a: _Piece, b: _Piece, threshold: float, dense: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, similarity), by place in the pieces, of pairs that reach the threshold.  ``dense`` keeps a's rows."""
    keep, other = a.reach(b) >= threshold - OFF, b.reach(a) >= threshold - OFF
    if not keep.any() or not other.any():
        return
    held = np.concatenate([a.side.place[a.rows][keep], b.side.place[b.rows][other]])
    if (held == held[0]).all():
        return
    places = np.flatnonzero(a.places & b.places)
    if not len(places):
        return
    if "x" not in dense:
        dense["x"] = a.dense(np.ones(len(keep), bool))
    x, y = dense["x"][np.ix_(keep, places)], b.dense(other)[:, places]
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    keep, other, many = np.flatnonzero(keep), np.flatnonzero(other), False
    for begin in range(0, len(x), STRIP):
        own = x[begin : begin + STRIP]
        if not many:
            s = x4[begin : begin + STRIP] @ y4.T
            at = np.flatnonzero(s >= np.float32(threshold - OFF))
            many = len(at) > MANY * s.size
            i, j = np.divmod(at, len(y))
            parts = [np.einsum("ij,ij->i", own[i[c : c + 4096]], y[j[c : c + 4096]]) for c in range(0, 0 if many else len(i), 4096)]
            s = np.concatenate(parts) if parts else np.zeros(0)
        if many:
            s = own @ y.T
            at = np.flatnonzero(s >= threshold)
            many = len(at) > MANY * s.size
            i, j = np.divmod(at, len(y))
            s = s[i, j]
        some = s >= threshold
        yield keep[begin + i[some]], other[j[some]], s[some]


def _multiplied(threshold: float, tile: int, others: list[str], idf: list[float] | None, sums: _Told | None):
    """The task of a join: the pairs of one block, or of two, ``tile`` by ``tile`` rows at a time.  Blocks are tables of rows;
    with ``own`` they are parts of that place's list."""

    def tell(at: np.ndarray, to: np.ndarray, swap: np.ndarray, similarity: np.ndarray, told: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """Pairs by their rows, the later book first where ``swap``."""
        for c in range(0, len(at), FOUND):
            u, v, w, s = (x[c : c + FOUND] for x in (at, to, swap, similarity))
            if sums is not None:
                sums.add(np.where(w, v, u), np.where(w, u, v), s)
                continue
            ends = [pa.array(np.where(w, v, u)), pa.array(np.where(w, u, v))]
            out = {f"{k}{e + 1}": told[k].take(ends[e]) for k in ("id", "book") for e in (0, 1)} | {"similarity": pa.array(s, pa.float64())}
            yield pa.RecordBatch.from_pydict(out | {f"{k}{e + 1}": told[k].take(ends[e]) for k in others for e in (0, 1)})

    def by_kind(left: _Arranged, right: _Arranged, n: int, told: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """The join of sparse rows: pieces of like rows, in the places that two of them share, without rows that cannot reach
        the threshold.  Of the right side are the rows from n on."""
        for k, p in enumerate(left.pieces):
            dense: dict = {}
            for q in right.pieces[k if left is right else 0 :]:
                for i, j, s in _close(p, q, threshold, dense):
                    i, j = i + p.rows.start, j + q.rows.start
                    x, y = left.place[i], right.place[j]
                    keep = (x != y) & (i < j) if p is q else x != y
                    yield from tell(left.number[i[keep]], n + right.number[j[keep]], (x > y)[keep], s[keep], told)

    def join(tables: list[pa.Table], own: int | None = None) -> Iterator[pa.RecordBatch]:
        one = len(tables) == 1
        told = {c: pa.concat_arrays([k for t in tables for k in t[c].chunks]) for c in ("id", "book", *others)} if any(map(len, tables)) else {}
        scale = None if idf is None else np.array(idf)
        a, b = (_Side(tables[0], scale), _Side(tables[-1], scale)) if not one else [_Side(tables[0], scale)] * 2
        del tables
        if sums is not None:
            sums.begin(told)
        place = np.where(told["book"].is_valid().to_numpy(zero_copy_only=False), pc.rank(told["book"], sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64), -1)
        if a.p is not None and own is None:
            arranged, n = _arranged([a] if one else [a, b], place, tile), 0 if one else a.n
            del a, b
            yield from by_kind(*arranged, n, told)
            if sums is not None:
                yield from sums.end()
            return
        column, n = np.zeros(0, np.int64), 1
        if a.p is not None:
            # places that several rows have
            most = max((int(s.p.max()) for s in (a, b) if len(s.p)), default=0) + 1
            often = np.bincount(a.p, minlength=most) + (0 if one else np.bincount(b.p, minlength=most))
            column, n = np.where(often > 1, np.cumsum(often > 1) - 1, -1), max(1, int((often > 1).sum()))
        for i0 in range(0, a.n, tile):
            i1 = min(a.n, i0 + tile)
            for j0 in range(i0 if one else 0, b.n, tile):
                j1 = min(b.n, j0 + tile)
                s = a.part(i0, i1, column, 0, min(1024, n)) @ b.part(j0, j1, column, 0, min(1024, n)).T
                for first in range(1024, n, 1024):
                    width = min(1024, n - first)
                    s += a.part(i0, i1, column, first, width) @ b.part(j0, j1, column, first, width).T
                i, j = np.divmod(np.flatnonzero(s >= threshold), max(1, j1 - j0))
                x, y = place[i0 + i], place[(0 if one else a.n) + j0 + j]
                keep = (x != y) & (x >= 0) & (y >= 0)
                if one and i0 == j0:
                    keep &= i < j
                i, j, swap = i[keep], j[keep], (x > y)[keep]
                if own is not None and len(i):
                    # a pair that is indexed together at several places is told at the rarest of them only
                    left, right = a.later(i0, i1, column, n, own), b.later(j0, j1, column, n, own)
                    alone = np.concatenate([~(left[i[c : c + FOUND]] & right[j[c : c + FOUND]]).any(axis=1) for c in range(0, len(i), FOUND)])
                    i, j, swap = i[alone], j[alone], swap[alone]
                yield from tell(i0 + i, (0 if one else a.n) + j0 + j, swap, s[i, j], told)
        if sums is not None:
            yield from sums.end()

    return join


def _block_pairs(block: str, blocks: str) -> str:
    """SQL: (lo, hi, side) of all pairs of blocks that one block is in: as lo (side 0, with itself too) or as hi (side 1)."""
    return f"concat(transform(sequence({block}, {blocks} - 1), h -> struct({block} as lo, h as hi, 0 as side)), if({block} > 0, transform(sequence(0, {block} - 1), l -> struct(l as lo, {block} as hi, 1 as side)), cast(array() as array<struct<lo: int, hi: int, side: int>>)))"


def _blocks(n: int, size: float, block: int) -> int:
    """Into how many blocks n rows of so many bytes are dealt."""
    return max(1, -int(-size // BLOCK_BYTES), min(BLOCKS, -(-n // block)))


def _grouped(join):
    """The task of a join of blocks that come as groups of rows: of one block (lo = hi), or of two."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        one = rows["lo"][0] == rows["hi"][0]
        yield from join([rows] if one else [rows.filter(pc.equal(rows["side"], i)) for i in (0, 1)], rows["list"][0].as_py())

    return task


def _packed(items: DataFrame, blocks: int) -> DataFrame:
    """Rows (id, book, x, and p if they are sparse, ...) dealt into blocks, each a row (b, __sizes, ...): columns as arrays; of x and p,
    arrays themselves, the values one after the other and their sizes.  Kept as a checkpoint."""
    flat = [c for c in ("p", "x") if c in items.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [k for k in batches if k.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        held = {"__sizes": pc.cast(pc.fill_null(pc.list_value_length(rows["x"]), 0), pa.int32())} | {c: rows[c] for c in rows.column_names}
        for c in flat:
            held[c] = pc.list_flatten(rows[c])
        each = {c: pa.concat_arrays(x.chunks) for c, x in held.items()}
        yield pa.RecordBatch.from_pydict({c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in each.items()})

    kinds = ", ".join(["__sizes array<int>", *(f"`{c}` {kind}" if c in flat else f"`{c}` array<{kind}>" for c, kind in items.dtypes)])
    dealt = items.repartition(blocks) if blocks > 1 else items.coalesce(1)
    return settled(dealt.mapInArrow(pack, kinds).withColumn("b", F.monotonically_increasing_id()))


def _unpacked(row: pa.RecordBatch, end: str) -> pa.Table:
    """The rows of a block of ``_packed``, in the columns whose names have this ``end``."""
    sizes = row[f"__sizes{end}"].flatten().to_numpy()
    starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    held = {c.removesuffix(OTHER): row[c].flatten() for c in row.schema.names if c.endswith(OTHER) == bool(end) and c.removesuffix(OTHER) not in ("b", "__sizes")}
    return pa.table({c: pa.ListArray.from_arrays(starts, x) if c in ("p", "x") else x for c, x in held.items()})


#: How the columns of the second block of two end.
OTHER = "__other"


def _by_blocks(items: DataFrame, threshold: float, block: int, n: int, size: float, idf: list[float] | None, told: _Told | None) -> DataFrame:
    """The join of vectors (id, book, x), or of sparse unit vectors with their places p, or with ``idf`` of counts x at places
    p: n rows of ``size`` bytes.  Rows are moved once, into blocks; tasks read the blocks of every two where they are kept, so
    no row is copied to a shuffle for each of its partners."""
    packed = _packed(items, _blocks(n, size, block))
    others = packed.select([F.col(c).alias(c + OTHER) for c in packed.columns])
    both = packed.join(others.hint("shuffle_replicate_nl"), F.col("b") <= F.col("b" + OTHER))
    join = _multiplied(threshold, block, _others(items), idf, told)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ends = [""] if row["b"][0] == row["b" + OTHER][0] else ["", OTHER]
                yield from join([_unpacked(row, end) for end in ends])

    return both.mapInArrow(task, _pairs_ddl(items, told))


def _by_lists(items: DataFrame, threshold: float, block: int, counts: dict[int, int] | None, idf: list[float] | None, told: _Told | None) -> DataFrame:
    """The join of sparse unit vectors (id, book, at, weight), or of counts (id, book, at, n).

    Places are ordered by how many items have them, most first.  The leading places of a vector, as long as
    their norm is below the threshold, are not indexed.  If two vectors share no place that is indexed in both,
    all they share is among the leading places of one, so their cosine is below the threshold.  Each indexed
    place has a list; long lists are cut, and only these are paired block by block.
    A task multiplies the whole vectors of a list; a pair that is indexed together at several places is
    found at the rarest of these only.  Where the lists would multiply more pairs than there are, as with few places,
    the vectors go block by block instead, each pair once."""
    others = _others(items)
    if counts is None:
        counts = {r["p"]: r["n"] for r in items.select(F.explode("at").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return items.sparkSession.createDataFrame([], _pairs_ddl(items, told))
    order = sorted(counts, key=lambda p: (-counts[p], p))
    place = [0] * (max(counts) + 1)
    for rank, p in enumerate(order):
        place[p] = rank
    long = counts[order[0]] > block
    if long:
        narrow = [F.col("at").cast("array<smallint>") if idf is not None and len(place) < 1 << 15 else F.col("at"), "weight" if idf is None else "n"]
        items = settled(items.select("id", "book", *narrow, *others).where("size(at) > 0"))
    counted, items = items, items if idf is None else items.withColumn("weight", V.tfidf_weights("at", "n", idf)).drop("n")
    ranked = F.expr(f"array_sort(zip_with(at, weight, (a, x) -> struct(array({', '.join(map(str, place))})[a] as p, x as x)))").alias("e")
    least = threshold * threshold - 1e-9
    led = f"aggregate(e, struct(0D as s, 0 as k), (y, v) -> struct(y.s + v.x * v.x as s, if(y.s + v.x * v.x < {least!r}D, y.k + 1, y.k) as k)).k"
    rows = items.select("id", "book", *others, ranked).withColumn("led", F.expr(led))
    rows = rows.select("id", "book", *others, F.expr("e.p").alias("p"), F.expr("e.x").alias("x"), "led")
    listed = F.explode(F.expr("slice(p, led + 1, size(p) - led)")).alias("list")
    cuts = [1] * len(order)
    if long:
        own = {r["list"]: r["n"] for r in rows.select(listed).groupBy("list").agg(F.count("*").alias("n")).collect()}
        n = items.count()
        entry = 12 * sum(counts.values()) / max(1, n) + 64  # bytes of a row in a task, about
        if LISTS * sum(m * m for m in own.values()) >= n * n:
            if idf is not None:
                rows = counted.withColumnsRenamed({"at": "p", "n": "x"})
            return _by_blocks(rows.drop("led"), threshold, block, n, n * entry, idf, told)
        cuts = [_blocks(own.get(r, 0), own.get(r, 0) * entry, block) for r in range(len(order))]
    rows = rows.select("*", listed).withColumn("cuts", F.expr(f"array({', '.join(map(str, cuts))})[list]")).withColumn("b", F.expr("int(pmod(xxhash64(id), cuts))"))
    both = rows.select("id", "book", *others, "p", "x", "led", "list", F.inline(F.expr(_block_pairs("b", "cuts"))))
    return both.groupBy("list", "lo", "hi").applyInArrow(_grouped(_multiplied(threshold, block, others, None, told)), _pairs_ddl(items, told))
