"""Packing token sequences by cutting-stock column generation.

1. Each document's ids (and a closing id) are cut at multiples of the sequence length; what remains is
   one piece.  Tokenising is one pass: the library encodes each distinct word once per worker.  A text
   that holds one of the tokenizer's added tokens goes to the library whole.
2. The histogram of piece lengths, in units of ``unit`` tokens and so of bounded size, is collected.
   A linear program over packing patterns is solved by column generation: a revised simplex keeps the
   basis, and an unbounded-knapsack dynamic program prices new patterns.
3. The solution is rounded down; what is left over is packed first-fit decreasing.  The counts of the
   patterns then cover the histogram exactly.
4. Pieces are ranked within their length (in salted groups, so that a common length is no single
   task) and the pattern table, of bounded size, tells each rank its sequence and place.

Edge cases: null and empty texts have the closing id alone; repeated rows are packed each; ties in
rank are broken by doc_id and start; an empty table gives an empty result; extra columns are ignored;
very long texts are encoded whole and cut into as many pieces as they need.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.session import small_batches, stored
from inkmill.llm.textkit import Words, slices

SENTINEL = "\x01"


class WordIds:
    """Token ids of words; a word is given to the tokenizer the first time a worker sees it.  Words are
    told apart by their bytes; within one slice of texts by 64-bit tabulation hashes."""

    MOST = 600_000  # entries kept; beyond it the memory starts anew

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.mark = self.tokenizer.encode(SENTINEL, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.begin, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: many words a call, a mark between them."""
        out: list[np.ndarray] = []
        plain = len(self.mark) == 1
        groups, at = [], 0
        while at < len(words):
            group, size = [], 0
            while at < len(words) and size < 20_000:
                group.append(words[at])
                size += len(words[at]) + 3
                at += 1
            groups.append(group)
        if not plain or any(SENTINEL in w for w in words):
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        joined = [f" {SENTINEL} ".join(g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark[0])
            ends, begins = np.append(marks, len(ids)), np.append(0, marks + 1)
            if len(ends) == len(group):
                out += [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
            else:  # the mark's id stands for something else here too
                out += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=np.uint32) for w in group]
        return out

    def add(self, words: list[bytes]) -> None:
        ids = self._encode([w.decode("utf-8", "surrogatepass") for w in words])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.index), int(sizes.sum())
        while n + len(ids) > len(self.begin):
            self.begin, self.size = np.concatenate((self.begin, self.begin * 0)), np.concatenate((self.size, self.size * 0))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, self.pool * np.uint32(0)))
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.size[n : n + len(ids)] = sizes
        self.begin[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.index.update(zip(words, range(n, n + len(ids))))

    def whole(self, text: str) -> np.ndarray | None:
        """The ids of a text that cannot be taken word by word, else None."""
        if not self.added:
            return None
        low = text.lower()
        if not any(t in low for t in self.added):
            return None
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, and where those of each text begin (one more at the end)."""
        if not len(words.hash):
            return np.zeros(0, np.uint32), np.zeros(len(words.first), np.int64)
        _, sample, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        data = words.buf.tobytes()
        kinds = [data[a:b] for a, b in zip(words.start[sample].tolist(), words.end[sample].tolist())]
        if len(self.index) + len(kinds) > self.MOST:
            self.forget()
        at = np.fromiter((self.index.get(w, -1) for w in kinds), np.int64, len(kinds))
        new = np.flatnonzero(at < 0)
        if len(new):
            self.add([kinds[i] for i in new.tolist()])
            at[new] = np.arange(len(self.index) - len(new), len(self.index))
        entry = at[inverse]
        size = self.size[entry]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size - self.begin[entry], size)
        return self.pool[place], np.concatenate(([0], ends))[words.first]


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, closing_id: int = 2, length: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece of each row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_file)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 2_000_000):
                whole = {i: ids for i, t in enumerate(texts[a:b]) if t and (ids := known.whole(t)) is not None}
                ids, first = known.of(Words([None if i in whole else t for i, t in enumerate(texts[a:b])] if whole else texts[a:b], lower=True, parts=True))
                together, rows = memoryview(ids.astype("<u4").tobytes()), []
                close = int(closing_id).to_bytes(4, "little")
                for i, (doc_id, x, y) in enumerate(zip(doc_ids[a:b], first[:-1].tolist(), first[1:].tolist())):
                    data = together
                    if i in whole:
                        data, x, y = memoryview(whole[i].astype("<u4").tobytes()), 0, len(whole[i])
                    tokens = y - x + 1
                    for s in range(0, tokens, length):
                        e = min(s + length, tokens)
                        crc = zlib.crc32(data[4 * (x + s) : 4 * min(x + e, y)])
                        rows.append((doc_id, s, e - s, zlib.crc32(close, crc) if e == tokens else crc, tokens))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..len(value) that fits; by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(value))
        gain = value[:m] + best[c - 1 :: -1][:m] if m < c else value[:m] + best[:c][::-1]
        k = int(np.argmax(gain))
        if gain[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(value), dtype=np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(need: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, for need[i] pieces of i + 1 units: the linear program's
    optimum within ``gap`` (or the best basis after ``rounds`` columns)."""
    sizes = np.flatnonzero(need > 0)
    m = len(sizes)
    if not m:
        return []
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, capacity // (sizes + 1))
    inverse, x = np.diag(1 / np.diag(columns)), need[sizes] / np.diag(columns)
    least = float((need[sizes] * (sizes + 1)).sum()) / capacity
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value = np.zeros(int(sizes[-1]) + 1)
        value[sizes] = np.maximum(dual, 0)
        best, pattern = knapsack(value, capacity)
        least = max(least, x.sum() / best)  # Farley's bound
        if best <= 1 + 1e-9 or x.sum() <= least * (1 + gap):
            break
        column = pattern[sizes].astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-10, np.maximum(x, 0) / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x -= step * ratio[out]
        x[out] = ratio[out]
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= np.outer(step, inverse[out])
        columns[:, out] = column
    found = []
    for j in range(m):
        pattern = np.zeros(len(need), dtype=np.int64)
        pattern[sizes] = np.rint(columns[:, j]).astype(np.int64)
        found.append((pattern, float(max(x[j], 0))))
    return found


def whole_patterns(need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that use exactly need[i] pieces of i + 1 units."""
    left, plan = need.astype(np.int64).copy(), []
    for pattern, x in sorted(column_generation(need, capacity), key=lambda p: -p[1]):
        fits = pattern > 0
        n = min(int(x + 1e-7), int((left[fits] // pattern[fits]).min()) if fits.any() else 0)
        if n > 0:
            plan.append((pattern, n))
            left -= n * pattern
    bins: dict[tuple[int, ...], int] = {}
    while left.any():  # first-fit decreasing, many alike at once
        pattern, room = np.zeros(len(need), dtype=np.int64), capacity
        for i in np.flatnonzero(left)[::-1]:
            k = min(room // (i + 1), int(left[i]))
            pattern[i], room = k, room - k * (i + 1)
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= n * pattern
        key = tuple(pattern.tolist())
        bins[key] = bins.get(key, 0) + n
    return plan + [(np.array(k), n) for k, n in bins.items()]


def pack(docs: DataFrame, tokenizer_file: str, length: int = 4096, unit: int = 8, closing_id: int = 2) -> DataFrame:
    """Each piece with its sequence and the place in it (``sequence_id``, ``offset``)."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_file, closing_id, length), "pieces").withColumn("units", F.expr(f"cast(ceil(length / {unit}) as int)"))
    capacity = length // unit
    need = np.zeros(capacity, dtype=np.int64)
    for units, n in cut.groupBy("units").count().collect():  # at most length / unit rows
        need[units - 1] = n
    lines: dict[int, list[tuple[int, int, int, int]]] = {}  # of each length: first rank, first sequence, pieces in each, place of the first
    ranked, sequence = np.zeros(capacity, dtype=np.int64), 0
    for pattern, n in whole_patterns(need, capacity):
        place = 0
        for i in np.flatnonzero(pattern)[::-1]:
            lines.setdefault(int(i) + 1, []).append((int(ranked[i]), sequence, int(pattern[i]), place))
            ranked[i] += n * pattern[i]
            place += int(pattern[i])
        sequence += n
    plan = spark.sparkContext.broadcast({u: np.array(v, dtype=np.int64) for u, v in lines.items()})

    groups = max(1, int(need.sum()) // 2000)
    own = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = own.groupBy("units", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("units").orderBy("salt")) - F.col("count")).select("units", "salt", "before")
    rank = F.row_number().over(Window.partitionBy("units", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    own = own.withColumn("place", rank).join(before, ["units", "salt"]).withColumn("rank", F.col("before") + F.col("place"))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        for batch in batches:
            units, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            found, slot = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
            for u in np.unique(units).tolist():
                mine = np.flatnonzero(units == u)
                first, begin, each, place = table[u].T
                k = np.searchsorted(first, rank[mine], side="right") - 1
                nth = rank[mine] - first[k]
                found[mine], slot[mine] = begin[k] + nth // each[k], place[k] + nth % each[k]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(found), pa.array(slot)], schema=schema)

    placed = own.selectExpr(*names[:5], "cast(units as long) units", "cast(rank as long) rank").mapInArrow(assign, ", ".join(f"{n} long" for n in names))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
