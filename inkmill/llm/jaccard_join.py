"""Exact Jaccard self-join of documents on word n-grams, as a metric-space join.

Jaccard distance is a metric, so pivots and the triangle inequality can rule pairs out.  Taken over a
whole corpus that alone prunes nothing: unrelated documents are all at distance 1 of every pivot.  The
space is therefore divided twice.

*First regions.*  Documents of one n-gram set are one node.  If two nodes link, they share one of the
first ``n - ceil(t n) + 1`` n-grams of each under a common order (prefix principle).  Each such n-gram,
an anchor, makes a region; those that frequent n-grams would form are avoided by putting a bounded list
of frequent n-grams last in the order.  Of regions with the same members one is kept.

*Large regions* (over ``REGION`` nodes) are divided by rounds of DataFrame jobs.  One node is the pivot
and every member meets it.  Members within r of it, the greatest distance of a link, are its Voronoi
cell and in one component.  The others make up the far region of the next round; those of them that may
be within 2r, and are not in the pivot's component yet, are also copied into the cell: by the triangle
inequality no other can link to a member of the cell.  A cell and its copies are dealt to blocks of
``REGION`` nodes so that each pair of member and copy meets in one block.

*Small regions* are divided within a task, again by pivots, cells and windows (``_cells``), under the
metric that sketches give: a sketch has one bit for each of at least 2n cells, the parity of the n-grams
in it, and the number of differing bits never exceeds the number of n-grams in which two sets differ.
The first metric ball is by size, the distance to the empty set.  Within a last cell pairs of unlike
components whose sketches allow a link become candidates; a node joined to one tentatively is asked
about no other, so a group of k near copies asks for k - 1 distances and not for all its pairs.

*Verification* compares the words of the two texts.  Two more rounds ask for what the first left open:
up to ``ROUNDS[1]`` further candidates between two components of a region, then all that remain.  After
that every pair of one region is linked by verified links, refuted by its words, or ruled out by a
bound: no link between components is missed, none is taken twice, no group's pairs are listed.

How equality is decided: n-grams that may link are compared as words; equal n-gram sets by a 128-bit
cryptographic digest; sizes, anchors and sketches use 64-bit n-gram hashes, where a chance collision can
only propose a pair that verification then refutes.

Edge cases: null, empty and wordless texts have no n-grams and link with nothing; a text of fewer words
than n has its whole sequence as its one n-gram; repeated rows and equal sets are one node and link;
whole texts are read; a null doc_id takes part, but names no component unless it has no other member;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import log
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.session import discard, small_batches, stored
from inkmill.llm.textkit import U64, Words, mix, run_valid, runs, slices

SLICE = 6_000_000
#: Nodes that one task compares; larger regions are divided before.
REGION = 4096
#: Pivots that a large region meets one after the other before what is left is dealt to blocks.
PIVOT_ROUNDS = 2
#: Candidates asked for between two components of a region: a spanning forest, so many, all.
ROUNDS = (0, 16, None)
#: Within a task cells of so many nodes are compared outright; others get so many pivots.
LEAF, PIVOTS = 48, 8
#: The list of frequent n-grams has at most so many; it only settles an order, whatever it holds.
FREQUENT = 1 << 17
FREQUENT_FROM = 8  # in one slice
#: Ids of nodes whose texts are asked for are broadcast up to this number (24 bytes each), and joined beyond it.
BROADCAST_IDS = 500_000
_SPACE_AND_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text (words in lower case A-Z)."""
    w = Words(texts, lower=True)
    h, ok = runs(w.hash, words), run_valid(w.first, len(w.hash), words)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(h[a:b][ok[a:b]]))
        elif b > a:
            out.append(mix(runs(w.hash[a:b], b - a)[:1] + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_set(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The n-grams of a text themselves."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE_AND_LOWER).split()
    return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)} if w else set()


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key: equal sets have equal keys."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
    return a, b


def sketch_of(s: np.ndarray) -> bytes:
    """Parities of the n-grams in 2n cells or more, a power of two and at least 64."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    parity = np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _digest(words: int):
    """(doc_id, th, text) -> one row per document, and the slice's frequent n-grams."""
    types = [pa.int64()] * 7
    names = ["doc_id", "th", "k1", "k2", "n", "gram", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices([len(t or "") for t in texts], SLICE):
                sets = shingle_sets(texts[a:b], words)
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                distinct = list(dict(zip(keys, sets)).values())
                gram, times = np.unique(np.concatenate(distinct), return_counts=True)
                gram, times = gram[times >= FREQUENT_FROM].view(np.int64), times[times >= FREQUENT_FROM]
                none, k, m = [None], b - a, len(gram)
                columns = [ids[a:b] + none * m, ths[a:b] + none * m, [x for x, _ in keys] + none * m, [x for _, x in keys] + none * m, [len(s) for s in sets] + none * m, none * k + gram.tolist(), none * k + times.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


_NODES = "k1 long, k2 long, least long, doc_id long, th long, n long, anchors array<long>, sketch binary"


def _distinct(words: int, percent: int, frequent):
    """(doc_id, th, text) -> each distinct set of the slice: the least doc_id, a row that has it, its
    anchors and its sketch."""
    types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
    names = [x.split()[0] for x in _NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for batch in batches:
            ids, ths, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices([len(t or "") for t in texts], SLICE):
                found: dict[tuple[int, int], list] = {}
                for i, s in enumerate(shingle_sets(texts[a:b], words), a):
                    if not len(s):
                        continue
                    key = set_key(s)
                    if key in found:
                        found[key][2] = min((x for x in (found[key][2], ids[i]) if x is not None), default=None)
                        continue
                    size = len(s)
                    sketch = sketch_of(s)
                    if len(common):
                        often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                        s = np.concatenate((s[~often], s[often]))
                    found[key] = [*key, ids[i], ids[i], ths[i], size, s[: size + (-percent * size // 100) + 1].view(np.int64), sketch]
                columns = list(zip(*found.values())) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


class _Node:
    """A member of a region: what is needed to bound its distance to another."""

    __slots__ = ("id", "n", "width", "bits", "comp", "order", "folded")

    def __init__(self, nid: int, n: int, sketch: bytes, comp: int):
        self.id, self.n, self.comp = nid, n, comp
        self.width, self.bits = 8 * len(sketch), int.from_bytes(sketch, "little")
        self.order = (nid * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        self.folded: dict[int, int] = {}

    def at(self, width: int) -> int:
        """The sketch of so many cells."""
        if width == self.width:
            return self.bits
        bits = self.folded.get(width)
        if bits is None:
            bits, w = self.bits, self.width
            while w > width:
                w //= 2
                bits = (bits >> w) ^ (bits & ((1 << w) - 1))
            self.folded[width] = bits
        return bits


def _shared_at_most(a: _Node, b: _Node) -> int:
    """A bound of the number of n-grams that two sets share."""
    width = min(a.width, b.width)
    return min(a.n, b.n, (a.n + b.n - (a.at(width) ^ b.at(width)).bit_count()) // 2)


def _may_link(a: _Node, b: _Node, percent: int) -> bool:
    if 100 * min(a.n, b.n) < percent * max(a.n, b.n):
        return False
    both = _shared_at_most(a, b)
    return 100 * both >= percent * (a.n + b.n - both)


def _cells(nodes: list[_Node], percent: int, by_size: bool = True) -> Iterator[list[_Node]]:
    """Sets of nodes such that all pairs that may link meet in one: windows of sizes, then Voronoi cells
    of pivots, each with the nodes beyond its border that a member may link to."""
    if len(nodes) <= LEAF:
        yield nodes
        return
    if by_size:
        step = log(100 / percent)
        bands: dict[int, list[_Node]] = {}
        for x in nodes:
            bands.setdefault(int(log(x.n) / step + 1e-9), []).append(x)
        for band, own in bands.items():
            yield from _cells(own + bands.get(band + 1, []), percent, False)
        return
    width = min(x.width for x in nodes)
    apart = 2 * max(x.n for x in nodes) * (100 - percent) / (100 + percent)  # of sets that link
    pivots = [x.at(width) for x in nodes[:PIVOTS]]
    cells: list[list[_Node]] = [[] for _ in pivots]
    for x in nodes:
        bits = x.at(width)
        to = [(bits ^ p).bit_count() for p in pivots]
        nearest = to.index(min(to))
        for q in range(nearest + 1):  # those of lesser pivots, so that a pair meets once
            if q == nearest or to[q] <= to[nearest] + 2 * apart:
                cells[q].append(x)
    if max(map(len, cells)) > 0.8 * len(nodes):
        yield nodes
        return
    for cell in cells:
        yield from _cells(cell, percent, False)


def _candidates(nodes: list[_Node], percent: int, most: int | None) -> Iterator[tuple[int, int]]:
    """Pairs of a region to verify: of unlike components, where sizes and sketches allow a link.  ``most``
    0: a spanning forest of them; otherwise at most so many between two components."""
    nodes.sort(key=lambda x: (x.order, x.id))
    label = {x.id: x.comp for x in nodes}
    asked: dict[tuple[int, int], int] = {}
    for cell in _cells(nodes, percent):
        for i, a in enumerate(cell):
            for b in cell[i + 1 :]:
                x, y = label[a.id], label[b.id]
                if x == y:
                    continue
                between = (min(x, y), max(x, y))
                if most and asked.get(between, 0) >= most:
                    continue
                if _may_link(a, b, percent):
                    yield min(a.id, b.id), max(a.id, b.id)
                    if most == 0:
                        for c in nodes:
                            if label[c.id] == y:
                                label[c.id] = x
                    elif most:
                        asked[between] = asked.get(between, 0) + 1


def _meet(percent: int, most: int | None):
    """Rows (region, nid, n, sketch, comp) ordered by region -> (region, a, b) of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["region", "a", "b"])

        for region, group in groupby(rows, key=itemgetter(0)):
            members = [_Node(*r[1:]) for r in group]
            out.extend((region, a, b) for a, b in _candidates(members, percent, most))
            if len(out) > 10_000:
                yield flush()
        yield flush()

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, pivot, n, sketch, n and sketch of the pivot) -> (nid, pivot, least distance)."""
    for batch in batches:
        nid, pivot, n, sketch, m, other = (c.to_pylist() for c in batch.columns)
        least = []
        for i in range(len(nid)):
            both = _shared_at_most(_Node(nid[i], n[i], sketch[i], 0), _Node(pivot[i], m[i], other[i], 0))
            least.append(1 - both / (n[i] + m[i] - both))
        yield pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), pa.array(pivot, pa.int64()), pa.array(least, pa.float64())], names=["nid", "pivot", "least"])


def _compare(words: int):
    """(a, b, text of a, text of b) -> (a, b, shared, united): how many n-grams both have, and either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            shared, united, known = [], [], {}  # a pivot's rows follow each other
            for i in range(len(a)):
                if b[i] not in known:
                    known = {b[i]: word_set(right[i], words)}
                x, y = word_set(left[i], words), known[b[i]]
                shared.append(len(x & y))
                united.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, shared, united)], names=["a", "b", "shared", "united"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each end of the edges (a, b) with the least node that it is connected to.

    Every node takes the least label among its neighbours, then its label's label, until none changes."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = stored(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), "was"), "labels")
        discard(labels)
        labels = new
        if not new.where("comp <> was").limit(1).count():
            discard(both)
            return labels.select("node", "comp")


class _Join:
    """The tables of one join, and the steps that both kinds of regions share."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, words: int, percent: int):
        self.texts, self.nodes, self.words, self.percent = texts, nodes, words, percent
        spark = texts.sparkSession
        self.comp = spark.createDataFrame([], "node long, comp long")
        self.done = spark.createDataFrame([], "a long, b long")
        self.held: DataFrame | None = None  # texts by node
        self.scratch: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A stored table that lasts until the join ends."""
        table = stored(df, name)
        self.scratch.append(table)
        return table

    def hold(self, pairs: DataFrame) -> None:
        """Have the text of every node of the pairs, once each."""
        wanted = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
        if self.held is not None:
            wanted = wanted.join(self.held.select("nid"), "nid", "left_anti")
        rows = self.keep(self.nodes.join(wanted, "nid", "left_semi").select("nid", "doc_id", "th"), "wanted")
        side = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
        found = self.texts.join(side, (self.texts["th"] == side["th"]) & self.texts["doc_id"].eqNullSafe(side["doc_id"]))
        table = self.keep(found.select("nid", "text").dropDuplicates(["nid"]), "texts")
        self.held = table if self.held is None else self.held.unionByName(table)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, d): the distances of pairs not seen before; links join components."""
        new = pairs.join(self.done, ["a", "b"], "left_anti")
        both = new.join(self.held.select(F.col("nid").alias("a"), F.col("text").alias("left")), "a").join(self.held.select(F.col("nid").alias("b"), F.col("text").alias("right")), "b")
        found = self.keep(both.select("a", "b", "left", "right").mapInArrow(_compare(self.words), "a long, b long, shared long, united long"), "found")
        self.done = self.done.unionByName(found.select("a", "b"))
        self._link(found.where(f"100 * shared >= {self.percent} * united").select("a", "b"))
        return found.select("a", "b", (1 - F.col("shared") / F.col("united")).alias("d"))

    def _link(self, links: DataFrame) -> None:
        """Components after more links: only the graph of the components that they connect is searched."""
        for end in ("a", "b"):
            links = links.join(self.comp.select(F.col("node").alias(end), F.col("comp").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = self.keep(links.where("a <> b").distinct(), "links")
        if not links.limit(1).count():
            return
        merged = components(links)
        kept = self.comp.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        self.comp = self.keep(kept.unionByName(merged.join(self.comp, "node", "left_anti")), "components")

    def labelled(self, members: DataFrame) -> DataFrame:
        known = self.comp.select(F.col("node").alias("nid"), "comp")
        return members.join(known, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))

    def divide(self, members: DataFrame) -> DataFrame:
        """Large regions (region, nid) -> regions of at most REGION nodes in which all pairs that may
        still join components meet."""
        r, half = (100 - self.percent) / 100 + 1e-9, max(1, REGION // 2)
        sketches = self.nodes.select("nid", "n", "sketch")
        of_pivot = sketches.select(F.col("nid").alias("pivot"), F.col("n").alias("m"), F.col("sketch").alias("other"))
        parts: list[DataFrame] = []

        def blocks(nodes: Column) -> Column:
            return F.greatest(F.ceil(nodes / half), F.lit(1))

        def own(k: Column) -> Column:
            return F.pmod(F.xxhash64("nid"), k)

        for i in range(PIVOT_ROUNDS):
            pivots = members.groupBy("region").agg(F.min_by("nid", F.xxhash64("nid")).alias("pivot"))
            met = self.keep(members.join(pivots, "region"), "met")
            asked = met.where("nid <> pivot").select("nid", "pivot").distinct()
            bounds = asked.join(sketches, "nid").join(of_pivot, "pivot").select("nid", "pivot", "n", "sketch", "m", "other")
            least = self.keep(bounds.mapInArrow(_bounds, "nid long, pivot long, least double"), "least")
            pairs = self.keep(least.where(F.col("least") <= r).select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")).distinct(), "pairs")
            self.hold(pairs)
            d = self.verify(pairs)
            linked = least.select("nid", "pivot", "least", F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")).join(d, ["a", "b"], "left").select("nid", "pivot", "least", "d")
            comp_of_pivot = self.labelled(pivots.select(F.col("pivot").alias("nid")).distinct()).select(F.col("nid").alias("pivot"), F.col("comp").alias("pivot_comp"))
            state = self.labelled(met).join(linked, ["nid", "pivot"], "left").join(comp_of_pivot, "pivot")
            inside = (F.col("nid") == F.col("pivot")) | (F.coalesce("d", F.lit(1.0)) <= r)
            beside = ~inside & (F.col("least") <= 2 * r) & (F.col("comp") != F.col("pivot_comp"))
            state = self.keep(state.select("region", "nid", inside.alias("inside"), beside.alias("beside")), "state")
            sizes = state.groupBy("region").agg(F.count_if("inside").alias("nx"), F.count_if("beside").alias("ny"), F.count_if(~F.col("inside")).alias("nr"))
            sized = state.join(sizes, "region")
            kx, ky = blocks(F.col("nx")), blocks(F.col("ny"))
            window = sized.where("ny > 0")
            x = window.where("inside").select("region", "nid", own(kx).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), ky - 1)).alias("y"))
            y = window.where("beside").select("region", "nid", F.explode(F.sequence(F.lit(0).cast("long"), kx - 1)).alias("x"), own(ky).alias("y"))
            parts.append(x.unionByName(y).select(F.xxhash64("region", F.lit(i), "x", "y").alias("region"), "nid"))
            far = sized.where("not inside").select(F.xxhash64("region", F.lit("far")).alias("region"), "nid", "nr")
            parts.append(far.where(f"nr <= {REGION}").select("region", "nid"))
            members = self.keep(far.where(f"nr > {REGION}").select("region", "nid"), "far")
            if not members.limit(1).count():
                break
        sized = members.join(members.groupBy("region").agg(F.count("*").alias("nr")), "region")
        k = blocks(F.col("nr"))
        dealt = sized.select("region", "nid", own(k).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("y"))
        parts.append(dealt.select(F.xxhash64("region", F.least("x", "y"), F.greatest("x", "y")).alias("region"), "nid"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return self.keep(out, "blocks")

    def finish(self, members: DataFrame) -> None:
        """Verify all that may still join components within the regions (region, nid)."""
        sketches = self.nodes.select("nid", "n", "sketch")
        for most in ROUNDS:
            rows = self.labelled(members)
            if most != 0:
                open_ = rows.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region")
                rows = rows.join(open_, "region", "left_semi")
            rows = rows.join(sketches, "nid").select("region", "nid", "n", "sketch", "comp")
            found = self.keep(rows.repartition("region").sortWithinPartitions("region").mapInArrow(_meet(self.percent, most), "region long, a long, b long"), "candidates")
            pairs = found.select("a", "b").distinct()
            if not found.limit(1).count():
                return
            if most == 0:
                self.hold(pairs)  # a node with any candidate is in one of these
            self.verify(pairs)
            members = members.join(found.select("region").distinct(), "region", "left_semi")


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (xxhash64 of the text), n_shingles and component_id, the
    least doc_id that links lead to.

    Two documents link when 100 * intersection >= percent * union of their sets of ``words``-word n-grams.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))
    table = stored(texts.mapInArrow(_digest(words), "doc_id long, th long, k1 long, k2 long, n long, gram long, times long"), "digest")
    often = table.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(FREQUENT).collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in often], dtype=np.int64).view(np.uint64)))
    digest = table.where("n is not null").select("doc_id", "th", "k1", "k2", "n")

    slices_ = texts.mapInArrow(_distinct(words, percent, frequent), _NODES)
    first = slices_.groupBy("k1", "k2").agg(F.min("least").alias("least"), F.first(F.struct("doc_id", "th", "n", "anchors", "sketch")).alias("s"))
    nodes = stored(first.select(F.monotonically_increasing_id().alias("nid"), "k1", "k2", "least", "s.*"), "nodes")

    anchors = nodes.select("nid", "n", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("of")).where("of > 1")
    every = stored(anchors.join(shared, "anchor"), "anchors")
    # a node without another of a linking size in the region leaves it; large regions are left to their pivots
    by_size = Window.partitionBy("anchor").orderBy("n")
    beside = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    close = every.where(f"of <= {REGION}").withColumn("beside", beside).where("beside").select("anchor", "nid")
    members = stored(close.unionByName(every.where(f"of > {REGION}").select("anchor", "nid")), "members")
    alike = members.groupBy("anchor").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("nid")).alias("x1"), F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("x2"))
    regions = stored(alike.groupBy("k", "x1", "x2").agg(F.min("anchor").alias("anchor")).select("anchor", "k"), "regions")
    join = _Join(texts, nodes, words, percent)
    chosen = members.join(regions, "anchor").select(F.col("anchor").alias("region"), "nid", "k")
    small = chosen.where(f"k <= {REGION}").select("region", "nid")
    if regions.where(f"k > {REGION}").limit(1).count():
        small = small.unionByName(join.divide(chosen.where(f"k > {REGION}").select("region", "nid")))
    small = join.keep(small, "regions")
    discard(every, members, regions)
    join.finish(small)

    named = nodes.select("k1", "k2", "least", F.col("nid").alias("node")).join(join.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = stored(named.join(least, "comp").select("k1", "k2", "component_id"), "named")
    discard(nodes, *join.scratch)
    return digest.join(by_node, ["k1", "k2"], "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each class stays: that of the least
    doc_id, and of rows that repeat it one."""
    found = classes(docs, words, percent).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("__ink_id"), F.col("th").alias("__ink_th")).distinct()
    own = docs.withColumn("__ink_own", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = own.join(found, (own["__ink_own"] == found["__ink_th"]) & own["doc_id"].cast("long").eqNullSafe(found["__ink_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__ink_own"]).drop("__ink_own")
