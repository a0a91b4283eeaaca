"""Vector code compression: product codes whose codebooks are learned by Yinyang Lloyd, in whole numbers.

Each component x becomes floor(4096 x); vectors are cut into ``parts`` equal consecutive parts.  The codebook
of a part position begins as that part of the ``entries`` smallest vec_ids.  A round assigns every part to its
nearest entry (squared distance, ties to the lower index) and replaces each entry by floor(sum / count)
of its parts; unused entries stay.  After the last round parts are assigned once more.

Entries of a position are clustered into ``groups`` groups.  A part keeps the distance to its entry as an
upper bound and one lower bound for each group (of the distance to the group's other entries).  When entries
move, the upper bound grows by the drift of its entry and each lower bound shrinks by the greatest drift in
its group; a group is scanned only if its bound no longer exceeds the upper bound, after that was made exact.
Bounds are square roots rounded outwards and compared with a margin, so they never decide a tie: what
is near enough to tie is scanned, and scans compare whole numbers.

Vectors, assignments and bounds are a table in the shared folder, written anew each round; the one before
is deleted.  Sums are formed in tasks, then over (part, entry, component); the driver sees the
codebooks only.

Edge cases: vectors that are null, empty, or hold null or non-finite components are dropped, as are those
of another length than the commonest (of equally common ones the shortest); a length that ``parts`` does not
divide, or components of 2^14 and more (their squares do not fit 64 bits), are a ValueError.  With fewer than
``entries`` vectors the codebook has as many entries as there are vectors; rows of one vec_id each count, in
order of their vectors; null vec_ids count too, after all others.  Columns but vec_id, embedding and label are not looked at;
without a column label all rows are of one label.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.session import discard, stored

SCALE = 4096
LARGEST = 1 << 26  # of a whole component
MARGIN = 1e-6


@dataclass
class Codebooks:
    """``entry[p]``: entries x dims of part position p; ``group[p]``: the group of each."""

    entry: list[np.ndarray]
    group: list[np.ndarray]

    def drift(self, after: Codebooks) -> list[np.ndarray]:
        """How far each entry moves, rounded up."""
        return [_up(np.sqrt(((a - b) ** 2).sum(axis=1).astype(np.float64))) for a, b in zip(self.entry, after.entry)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entry for x in e.ravel().tolist()).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry: plain Lloyd from entries spread evenly over the list."""
    groups = min(groups, len(entries))
    centre = entries[np.arange(groups) * len(entries) // groups].astype(np.float64)
    for _ in range(rounds):
        own = ((entries[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centre[g] = entries[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, one row each."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1) if len(entries) else np.zeros((len(x), 0), np.int64)


def first_assignment(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds by group) of each part, by a full scan."""
    d = distances(x, entries)
    own = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = _up(np.sqrt(d[rows, own].astype(np.float64)))
    other = d.astype(np.float64)
    other[rows, own] = np.inf
    lower = np.stack([_down(np.sqrt(other[:, group == g].min(axis=1))) for g in range(group.max() + 1)], axis=1)
    return own, upper, lower


def reassign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The assignment after entries moved by ``drift``, its bounds, and how many distances it took."""
    n_groups = lower.shape[1]
    upper = _up(upper + drift[own])
    lower = _down(np.maximum(lower - np.array([drift[group == g].max() for g in range(n_groups)], dtype=np.float32), 0))
    open_ = np.flatnonzero(_fails(lower.min(axis=1), upper))
    own = own.copy()
    if not len(open_):
        return own, upper, lower, 0
    exact = ((x[open_] - entries[own[open_]]) ** 2).sum(axis=1)
    upper[open_] = _up(np.sqrt(exact.astype(np.float64)))
    scanned = _fails(lower[open_], upper[open_][:, None])
    work = len(open_)
    some = scanned.any(axis=1)
    open_, exact, scanned = open_[some], exact[some], scanned[some]
    far = np.iinfo(np.int64).max
    d = np.full((len(open_), len(entries)), far)
    rows = np.arange(len(open_))
    before = own[open_]
    for g in range(n_groups):
        members, at = np.flatnonzero(group == g), np.flatnonzero(scanned[:, g])
        d[at[:, None], members] = distances(x[open_[at]], entries[members])
        work += len(at) * len(members)
    d[rows, before] = exact
    now = d.argmin(axis=1)  # whole numbers; the first of equal ones
    upper[open_] = _up(np.sqrt(d[rows, now].astype(np.float64)))
    own[open_] = now
    # a group's bound leaves out the entry that the part now has, and takes in the one it had
    d[rows, now] = far
    for g in range(n_groups):
        least = d[:, group == g].min(axis=1)
        bound = np.where(least == far, np.float32(np.inf), _down(np.sqrt(least.astype(np.float64))))
        lower[open_, g] = np.where(scanned[:, g], bound, np.minimum(lower[open_, g], bound))
    return own, upper, lower, work


def _fails(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Where a lower bound does not surely exceed the upper bound."""
    return ~(lower.astype(np.float64) * (1 - MARGIN) > upper.astype(np.float64) * (1 + MARGIN) + MARGIN)


def _whole(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = np.floor(SCALE * batch.column(2).flatten().to_numpy(zero_copy_only=False))
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more in size cannot be coded")
    return flat.astype(np.int64).reshape(-1, dims)


_STATE = "vec_id long, label binary, x binary, own binary, upper binary, lower binary, work long"


def _state(ids, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, work: int) -> pa.RecordBatch:
    n = len(x)
    rows = lambda a, kind: pa.array([r.tobytes() for r in np.ascontiguousarray(a.reshape(n, -1).astype(kind))], pa.binary())
    each = np.zeros(n, dtype=np.int64)
    each[:1] = work
    return pa.RecordBatch.from_arrays([*ids, rows(x, "<i4"), rows(own, "u1"), rows(upper, "<f4"), rows(lower, "<f4"), pa.array(each)], names=["vec_id", "label", "x", "own", "upper", "lower", "work"])


def _read(batch: pa.RecordBatch, names: dict[str, str]) -> list[np.ndarray]:
    n = batch.num_rows
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=k).reshape(n, -1) if n else np.zeros((0, 1), dtype=k) for c, k in names.items()]


def learn(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4) -> tuple[DataFrame | None, Codebooks | None, list[int]]:
    """(codes, codebooks, distances computed in each assignment); codes: (vec_id, label, code, error)
    with ``label`` as JSON bytes, a stored table; None of an empty table."""
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("at most 256 entries: a code has two hex digits a part")
    label = F.to_json(F.struct(F.col("label").alias("v"))).cast("binary") if "label" in vectors.columns else F.lit(None).cast("binary")
    v = vectors.select(F.expr("cast(vec_id as long)").alias("vec_id"), label.alias("label"), F.expr("cast(embedding as array<double>)").alias("embedding"))
    v = v.where("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    first = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return None, None, []
    dims = first["n"]
    if dims % parts:
        raise ValueError(f"{parts} parts do not divide {dims} components")
    v, width = v.where(F.size("embedding") == dims), dims // parts
    drawn = v.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("vec_id", "label", "embedding").toArrow().to_batches()
    start = np.concatenate([_whole(b, dims) for b in drawn])
    cut = lambda x, p: x[:, p * width : (p + 1) * width]
    begin = [cut(start, p) for p in range(parts)]
    books = Codebooks(begin, [grouped(e, groups) for e in begin])
    lowers = [int(g.max()) + 1 for g in books.group]
    edge = np.concatenate(([0], np.cumsum(lowers)))
    shared = spark.sparkContext.broadcast(books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch, dims)
            each = [first_assignment(cut(x, p), b.entry[p], b.group[p]) for p in range(parts)]
            own, upper = (np.stack([e[i] for e in each], axis=1) for i in (0, 1))
            yield _state(batch.columns[:2], x, own, upper, np.concatenate([e[2] for e in each], axis=1), len(x) * sum(len(e) for e in b.entry))

    state, took = stored(v.mapInArrow(scan, _STATE), "codes"), []
    for _ in range(rounds):
        after = Codebooks(_means(state, books, dims), books.group)
        moved = spark.sparkContext.broadcast((after, books.drift(after)))

        def step(batches: Iterator[pa.RecordBatch], *, moved=moved) -> Iterator[pa.RecordBatch]:
            b, drift = moved.value
            for batch in batches:
                x, own, upper, lower = _read(batch, {"x": "<i4", "own": "u1", "upper": "<f4", "lower": "<f4"})
                if not len(x):
                    continue
                x = x.astype(np.int64)
                each = [reassign(cut(x, p), own[:, p].astype(np.int64), upper[:, p], lower[:, edge[p] : edge[p + 1]], b.entry[p], b.group[p], drift[p]) for p in range(parts)]
                yield _state(batch.columns[:2], x, *(np.stack([e[i] for e in each], axis=1) for i in (0, 1)), np.concatenate([e[2] for e in each], axis=1), sum(e[3] for e in each))

        following = stored(state.mapInArrow(step, _STATE), "codes")
        took.append(state.agg(F.sum("work")).first()[0])
        discard(state)
        state, books = following, after
    took.append(state.agg(F.sum("work")).first()[0])
    final = spark.sparkContext.broadcast(books)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = final.value
        for batch in batches:
            x, own = _read(batch, {"x": "<i4", "own": "u1"})
            if len(x):
                x = x.astype(np.int64)
                error = sum(((cut(x, p) - b.entry[p][own[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes().hex() for r in own]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    codes = stored(state.mapInArrow(finish, "vec_id long, label binary, code string, error long"), "coded")
    discard(state)
    return codes, books, took


def _means(state: DataFrame, books: Codebooks, dims: int) -> list[np.ndarray]:
    """Each entry's floor(sum / count) over its parts; unused entries as they are."""
    parts, width = len(books.entry), books.entry[0].shape[1]
    sizes = [len(e) for e in books.entry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [np.zeros((n, width), dtype=np.int64) for n in sizes], [np.zeros(n, dtype=np.int64) for n in sizes]
        for batch in batches:
            x, own = _read(batch, {"x": "<i4", "own": "u1"})
            for p in range(parts if len(x) else 0):
                order = np.argsort(own[:, p], kind="stable")
                used, at = np.unique(own[order, p], return_index=True)
                total[p][used] += np.add.reduceat(x[order, p * width : (p + 1) * width].astype(np.int64), at, axis=0)
                count[p] += np.bincount(own[:, p], minlength=sizes[p])
        for p in range(parts):
            used = np.flatnonzero(count[p])
            columns = [np.full(len(used) * width, p), np.repeat(used, width), np.tile(np.arange(width), len(used)), total[p][used].ravel(), np.repeat(count[p][used], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

    sums = state.select("x", "own").mapInArrow(run, "part long, entry long, place long, total long, n long")
    after = [e.copy() for e in books.entry]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        after[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return after


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, share_labels: int = 100_000) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of (vec_id, embedding, label) that is kept.
    Labels' sums are shared with the tasks up to ``share_labels`` labels and joined beyond."""
    codes, books, _ = learn(vectors, parts, entries, rounds, groups)
    if codes is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= share_labels:
        sums = F.broadcast(sums)
    found = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
