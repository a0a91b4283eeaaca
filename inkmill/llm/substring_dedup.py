"""Removal of passages that a document with a smaller doc_id holds already, with a count-min prefilter.

A window is ``width`` consecutive words.  A word goes if a window over it also starts in a document of
smaller doc_id; windows are judged on the input.

1. Each slice of the input sketches its windows: a window counts in the cell of its least inner run of
   ``ANCHOR`` words, so neighbouring windows share cells.  The sketch has a thousand cells or more for
   each word that the input may have, so it is sized from the data; its counters are kept sparse, as
   the sorted list of those that are not 0.  Merged, shard by shard of the cells, they are a count-min
   sketch of one row: a cell's count is never less than that of a window in it.  Cells that are counted
   for more than one document are reported to their documents.
2. Only windows in such cells, estimated repeated, are identified in full and grouped exactly, by shards:
   every document learns which of its windows start in a smaller doc_id too.  A window's identity is two
   hashes of its words, 96 bits together; words are hashed by tabulation.

Within a slice each cell or window is settled first and sent once, for its smallest doc_id, so that a
passage in a third of all rows sends one record a slice, not one a row.  Shards hold a bounded share of
the input.  No window is lost: the sketch only overestimates.

Edge cases: null counts as no words; texts shorter than a window keep everything; rows that repeat a
doc_id are no smaller than each other and keep their words; a null doc_id counts as the greatest;
whole texts are read; extra columns are kept by ``dedup`` (those named __ink_* excepted); an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.packed import pack, unpack
from inkmill.llm.session import small_batches
from inkmill.llm.textkit import U64, Words, mix, run_valid, runs, slices

ANCHOR = 6
SLICE = 2_000_000
#: Bits of a cell's number beyond those that count the characters of the input.
SPARE_BITS = 10
_ASK, _AT, _HASH = 0, 1, 2  # a record for a shard; places of windows; hashes of cells or windows
_MESSAGE = "shard long, kind int, key long, th long, keys binary, ths binary, data binary, owner binary, more binary"
_REPLY = "bucket long, kind int, keys binary, ths binary, sizes binary, data binary"
_FLAGS = "__ink_key long, __ink_th long, __ink_at binary, __ink_hash binary"


def _windows(texts: list[str | None], width: int, cell_bits: int = 64) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts: words, cell and full hash of the window that starts at each word, and if one does."""
    w = Words(texts)
    ok = run_valid(w.first, len(w.hash), width)
    anchor = min(ANCHOR, width)
    inner = runs(w.hash, anchor)
    cell = inner.copy()
    for j in range(1, width - anchor + 1):
        np.minimum(cell[: len(cell) - j], inner[j:], out=cell[: len(cell) - j])
    return w, cell >> U64(64 - cell_bits), runs(w.hash, width), ok


def _first_of(*sorted_: np.ndarray) -> np.ndarray:
    """Where another combination of values begins in arrays that are ordered together."""
    new = np.zeros(max(0, len(sorted_[0]) - 1), bool)
    for v in sorted_:
        new |= v[1:] != v[:-1]
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(sorted_[0])), bool), new)))


def _second(w: Words, width: int) -> np.ndarray:
    """32 more bits of the identity of the window at each word."""
    return runs(mix(w.hash ^ U64(0x5851F42D4C957F2D)), width) >> U64(32)


class _Out:
    """Rows of _MESSAGE for one Arrow batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def flag(self, shards: int, key: int, th: int, kind: int, data: bytes) -> None:
        self.rows.append(((key ^ th) % shards, kind, key, th, None, None, data, None, None))

    def ask(self, shards: int, values: np.ndarray, owner: np.ndarray, keys: np.ndarray, ths: np.ndarray, more: np.ndarray | None = None) -> None:
        """Send each value (sorted) with the number of its row (of keys and ths; one more: no answer wanted)."""
        shard = (values % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        begins = _first_of(shard)
        for a, b in zip(begins.tolist(), np.append(begins[1:], len(shard)).tolist()):
            own = owner[order[a:b]]
            used, number = np.unique(own, return_inverse=True)
            self.rows.append((int(shard[a]), _ASK, 0, 0, pack(np.append(keys, 0)[used].view(np.uint64)), pack(np.append(ths, 0)[used].view(np.uint64)), pack(values[order[a:b]], True), pack(np.where(own == len(keys), -1, number)), None if more is None else pack(more[order[a:b]])))

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        names = [x.split()[0] for x in _MESSAGE.split(", ")]
        columns = list(zip(*self.rows)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _sketch(shards: int, width: int, cell_bits: int):
    """(key, th, text) -> messages: the slice's sketch, and what it settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ths, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in slices([len(t or "") for t in texts], SLICE):
                out = _Out()
                w, cell, _, ok = _windows(texts[a:b], width, cell_bits)
                at = np.flatnonzero(ok)
                row = w.text_of_word()[at]
                values = cell[at]
                order = np.lexsort((row, values))
                v, r = values[order], row[order]
                begins = _first_of(v)
                ends = np.append(begins[1:], len(v))
                many = r[begins] != r[ends - 1] if len(v) else np.zeros(0, bool)  # in more rows than one here
                owner = np.where(many, b - a, r[begins]) if len(v) else begins
                out.ask(shards, v[begins], owner, keys[a:b], ths[a:b])
                known = np.sort(order[np.repeat(many, ends - begins)])
                _flag_places(out, shards, w, at[known], row[known], keys[a:b], ths[a:b])
                yield out.batch()

    return run


def _flag_places(out: _Out, shards: int, w: Words, at: np.ndarray, row: np.ndarray, keys: np.ndarray, ths: np.ndarray) -> None:
    begins = _first_of(row)
    for x, y in zip(begins.tolist(), np.append(begins[1:], len(row)).tolist()):
        r = int(row[x])
        out.flag(shards, int(keys[r]), int(ths[r]), _AT, pack((at[x:y] - w.first[r]).astype(np.uint64), True))


def _asked(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """All records of a shard: value, key, th, if an answer is wanted, and the rest of the identity."""
    parts = []
    for keys, ths, data, owner, more in zip(pdf["keys"], pdf["ths"], pdf["data"], pdf["owner"], pdf["more"]):
        own = unpack(owner).view(np.int64)
        place = np.maximum(own, 0)
        parts.append((unpack(data, True), unpack(keys).view(np.int64)[place], unpack(ths).view(np.int64)[place], own >= 0, np.zeros(len(own), np.uint64) if more is None else unpack(more)))
    kinds = (np.uint64, np.int64, np.int64, bool, np.uint64)
    return tuple(np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))


def _by_row(key: np.ndarray, th: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each row's stretch in arrays that are ordered by key and th."""
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (th[1:] != th[:-1]))))
    return list(zip(begins.tolist(), np.append(begins[1:], len(key)).tolist()))


def _replies(shards: int, value: np.ndarray, key: np.ndarray, th: np.ndarray) -> list[tuple]:
    """What a shard tells its rows, packed by the bucket of each row."""
    bucket = (key ^ th) % shards
    order = np.lexsort((value, th, key, bucket))
    value, key, th, bucket = value[order], key[order], th[order], bucket[order]
    begins = _first_of(bucket)
    out = []
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(bucket)).tolist()):
        spans = np.array(_by_row(key[a:b], th[a:b]))
        out.append((int(bucket[a]), _HASH, pack(key[a:b][spans[:, 0]].view(np.uint64)), pack(th[a:b][spans[:, 0]].view(np.uint64)), pack(spans[:, 1] - spans[:, 0]), pack(value[a:b])))
    return out


def _merge(shards: int, exact: bool):
    """Merge a shard's records; pass on what slices settled.  Sketch: a cell of two documents is
    reported to all; exact: a window is reported to documents other than its smallest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        passed = pdf[pdf["kind"] != _ASK]
        one = pack(np.ones(1, np.uint64))
        out = [((k ^ t) % shards, _AT, pack(np.array([k]).view(np.uint64)), pack(np.array([t]).view(np.uint64)), one, d) for k, t, d in zip(passed["key"], passed["th"], passed["data"])]
        value, key, th, wanted, more = _asked(pdf[pdf["kind"] == _ASK])
        if len(value):
            order = np.lexsort((key, more, value))
            value, key, th, wanted, more = value[order], key[order], th[order], wanted[order], more[order]
            begins = _first_of(value, more)
            size = np.diff(np.append(begins, len(value)))
            told = key > np.repeat(key[begins], size) if exact else wanted & np.repeat(size > 1, size)
            out += _replies(shards, value[told], key[told], th[told])
        return pd.DataFrame(out, columns=[c.split()[0] for c in _REPLY.split(", ")])

    return run


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """All replies to the rows of a bucket: one record a row."""
    at: dict[tuple[int, int], np.ndarray] = {}
    parts = []
    for kind, keys, ths, sizes, data in zip(pdf["kind"], pdf["keys"], pdf["ths"], pdf["sizes"], pdf["data"]):
        key, th = unpack(keys).view(np.int64), unpack(ths).view(np.int64)
        if kind == _AT:
            row = (int(key[0]), int(th[0]))
            places = unpack(data, True)
            at[row] = np.union1d(at[row], places) if row in at else places
        else:
            n = unpack(sizes).astype(np.int64)
            parts.append((unpack(data), np.repeat(key, n), np.repeat(th, n)))
    hashes: dict[tuple[int, int], bytes] = {}
    if parts:
        value, key, th = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((value, th, key))
        value, key, th = value[order], key[order], th[order]
        hashes = {(int(key[a]), int(th[a])): pack(np.unique(value[a:b]), True) for a, b in _by_row(key, th)}
    rows = [(*row, pack(at[row], True) if row in at else None, hashes.get(row)) for row in dict.fromkeys([*at, *hashes])]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _FLAGS.split(", ")])


def _flagged(at: bytes | None, hash_: bytes | None, hashes: np.ndarray) -> np.ndarray:
    """Which windows of one text are named, by place or by hash."""
    hit = np.zeros(len(hashes), dtype=bool)
    if at is not None:
        hit[unpack(at, True).astype(np.int64)] = True
    if hash_ is not None:
        v = unpack(hash_, True)
        hit |= v[np.minimum(np.searchsorted(v, hashes), len(v) - 1)] == hashes
    return hit


def _exact(shards: int, width: int, cell_bits: int):
    """(key, th, text, places, cells) -> messages: windows estimated repeated, and what the slice settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ths, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in slices([len(t or "") for t in texts], SLICE):
                out = _Out()
                w, cell, full, ok = _windows(texts[a:b], width, cell_bits)
                for i in range(a, b):
                    x, y = w.first[i - a], w.first[i - a + 1]
                    ok[x:y] &= _flagged(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), cell[x:y])
                at = np.flatnonzero(ok)
                row = w.text_of_word()[at]
                values, key, more = full[at], keys[a:b][row], _second(w, width)[at]
                order = np.lexsort((row, key, more, values))
                v, k, r, m = values[order], key[order], row[order], more[order]
                begins = _first_of(v, m)
                least = np.repeat(k[begins], np.diff(np.append(begins, len(v))))
                later = np.sort(order[k > least])
                _flag_places(out, shards, w, at[later], row[later], keys[a:b], ths[a:b])
                first = k == least
                v, r, m = v[first], r[first], m[first]
                once = _first_of(v, m, r)
                out.ask(shards, v[once], r[once], keys[a:b], ths[a:b], m[once])
                yield out.batch()

    return run


def dedup(docs: DataFrame, width: int = 13, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with n_words, n_removed, kept_sha256 and, with
    ``keep_text``, kept_text: the kept words joined by single spaces, or the text as it was if all are."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if not c.startswith("__ink_")]
    key, th = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select(key.alias("__ink_key"), th.alias("__ink_th"), *kept)
    characters = own.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-characters // 24_000_000))
    cell_bits = min(64, characters.bit_length() + SPARE_BITS)

    def settle(messages: DataFrame, exact: bool) -> DataFrame:
        replies = messages.groupBy("shard").applyInPandas(_merge(shards, exact), _REPLY)
        return replies.groupBy("bucket").applyInPandas(_gather, _FLAGS)

    with_text = own.select("__ink_key", "__ink_th", F.col("text").cast("string").alias("text"))
    repeated = settle(with_text.mapInArrow(_sketch(shards, width, cell_bits), _MESSAGE), False)
    joined = own.join(repeated, ["__ink_key", "__ink_th"]).sortWithinPartitions("__ink_key", "__ink_th")
    # all columns go along unread, so that this join's shuffle of the rows is the last join's too
    windows = joined.select("__ink_key", "__ink_th", F.col("text").cast("string").alias("__ink_text"), "__ink_at", "__ink_hash", *kept)
    verdict = settle(windows.mapInArrow(_exact(shards, width, cell_bits), _MESSAGE), True)

    new = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + ([("kept_text", pa.string())] if keep_text else [])
    names = [n for n, _ in new]
    passed = [c for c in kept if c not in names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, hashes = batch.columns[-3:]
            out: list[list] = [[] for _ in new]
            for t, at, hash_ in zip(texts, places, hashes):
                text, at, hash_ = t.as_py(), at.as_py(), hash_.as_py()
                words = (text or "").encode("utf-8", "surrogatepass").split()
                left, gone = words, 0
                if at is not None or hash_ is not None:
                    _, _, full, ok = _windows([text], width)
                    hit = np.flatnonzero(_flagged(at, hash_, full) & ok)
                    cover = np.zeros(len(words) + width, dtype=np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + width, -1)
                    stay = np.cumsum(cover)[: len(words)] == 0
                    left = list(compress(words, stay.tolist()))
                    gone = len(words) - len(left)
                joined_ = b" ".join(left)
                row = [len(words), gone, hashlib.sha256(joined_).hexdigest(), joined_.decode("utf-8", "surrogatepass") if gone else text]
                for column, v in zip(out, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *[pa.array(v, t) for v, (_, t) in zip(out, new)]], names=[*passed, *names])

    schema = own.select(passed).schema
    for n, t in new:
        schema = schema.add(n, "string" if t == pa.string() else "long")
    final = own.join(verdict, ["__ink_key", "__ink_th"], "left")
    return final.select(*passed, F.col("text").cast("string").alias("__ink_text"), "__ink_at", "__ink_hash").mapInArrow(cut, schema)
