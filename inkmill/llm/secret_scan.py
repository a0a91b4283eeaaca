"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings, leftmost and not overlapping within a kind: ``assign`` (a credential's name, : or =, a value of six
characters or more), ``access`` (AKIA and capitals or digits, 20 or more), ``hex`` (24 or more digits of
0-9a-f).  A match that is too short is dropped and its text is not tried again.

Candidates are all other runs of at least ``LEAST`` of A-Za-z0-9+/_- (with up to two = after them) that
touch no base finding.  The network reads a candidate with ``LEFT`` characters before and ``RIGHT`` after
it: characters (as UTF-8 bytes, those beyond ASCII as one class) told apart by whether they lie before, in or
after the candidate are embedded, convolved, rectified, pooled by maximum and by mean inside the
candidate and by maximum outside, and joined in a logistic output.  A candidate longer than ``SPAN`` is
read in overlapping stretches, of which the greatest score counts.

Training (numpy, Adam) takes labelled findings (left, value, right, label): ``findings`` takes all of all texts, each once.  The network
begins with those of least hash, at most ``sample`` of each label, on the driver.  If there are more, all findings train it
further, ``SHARD`` a task: a task goes on from what is common, and the networks of a round's tasks are averaged.  What base patterns find, if the value has a digit, is
labelled a secret, other candidates are not.  As patterns know few shapes, each positive is also shown under other names, without
its name's sign, and respelled in another alphabet; each clean one also as a path, a name of words or a number.  A
fifth of all findings, with their variants, is set aside; tasks count their outputs by label in steps of 1/1024.  On these counts
scores are calibrated (a logistic fit of the network's output, with smoothed labels, each label weighing as ``sample``
findings at most) and the threshold is chosen: as few clean candidates may
pass as at the greatest threshold that finds ``recall`` of its secrets, and of all such thresholds the middle
one is taken, one half at least.

Edge cases: null and empty texts have no findings; whole texts are read; places are code points, the end is
exclusive; equal texts have equal findings; without a labelled secret nothing is added to base findings;
columns but doc_id and text are not looked at; repeated rows each have a row; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.session import discard, small_batches, stored

KINDS = ("assign", "access", "hex", "model")
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), _ANY_CASE("api") + "_?" + _ANY_CASE("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_HINTS = ("passw", "secret", "token", "api")

LEFT, SPAN, RIGHT = 24, 48, 8
WIDTH = LEFT + SPAN + RIGHT
_PAD = 129  # classes: ASCII, beyond ASCII (128), nothing
CLASSES = 130


def base(text: str) -> list[list[tuple[int, int, int]]]:
    """Of each base kind (start, end, start of the value)."""
    low = text.lower()
    assign = [(m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6] if any(h in low for h in _HINTS) else []
    access = [(m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return [assign, access, [(m.start(), m.end(), m.start()) for m in HEX.finditer(text)]]


def candidates(text: str, taken: list[list[tuple[int, int, int]]]) -> list[tuple[int, int]]:
    """Runs that touch no base finding."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    spans = sorted(s[:2] for kind in taken for s in kind)
    if not spans or not found:
        return found
    begins, ends = np.array([s for s, _ in spans]), np.maximum.accumulate([e for _, e in spans])
    at = np.searchsorted(begins, [e for _, e in found])  # findings that begin before the run's end
    return [f for f, i in zip(found, at.tolist()) if not i or ends[i - 1] <= f[0]]


_CLASS = np.minimum(np.arange(256), 128).astype(np.uint8)


def _bytes(s: str) -> np.ndarray:
    return _CLASS[np.frombuffer(s.encode("utf-8", "replace"), dtype=np.uint8)]


def windows(left: str, value: str, right: str) -> list[np.ndarray]:
    """What the network reads of a candidate: one row, or several where it is longer than SPAN."""
    before, after, inside = _bytes(left[-LEFT:])[-LEFT:], _bytes(right[:RIGHT])[:RIGHT], _bytes(value)
    out = []
    for a in range(0, max(1, len(inside) - SPAN // 2), SPAN // 2):
        row = np.full(WIDTH, _PAD, dtype=np.uint8)
        row[LEFT - len(before) : LEFT] = before
        part = inside[a : a + SPAN]
        row[LEFT : LEFT + len(part)] = part
        row[LEFT + SPAN : LEFT + SPAN + len(after)] = after
        out.append(row)
    return out


_ZONE = np.repeat([0, 1, 2], [LEFT, SPAN, RIGHT]) * CLASSES


@dataclass
class Network:
    """embed: 3 zones of classes x e; kernel: taps x e x filters; out: pooled features and a constant."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the output
    threshold: float = 1.1

    @staticmethod
    def fresh(e: int = 8, filters: int = 16, taps: int = 5) -> Network:
        rng = np.random.default_rng(23)
        return Network(
            rng.normal(0, 0.3, (3 * CLASSES, e)).astype(np.float32), rng.normal(0, (2 / (taps * e)) ** 0.5, (taps, e, filters)).astype(np.float32),
            np.zeros(filters, np.float32), rng.normal(0, 0.1, 3 * filters + 1).astype(np.float32),
        )

    def _pooled(self, rows: np.ndarray, h: np.ndarray):
        """The rectified filters ``h``, set to zero where nothing was read, pooled; they are changed in place."""
        taps = len(self.kernel)
        real = rows[:, taps // 2 : taps // 2 + h.shape[1]] != _PAD
        np.maximum(h, 0, out=h)
        h *= real[:, :, None]
        begin, end = LEFT - taps // 2, LEFT + SPAN - taps // 2
        inside, outside = h[:, begin:end], (h[:, :begin], h[:, end:])
        n = np.maximum(real[:, begin:end].sum(axis=1), 1)[:, None].astype(np.float32)
        high, low = inside.max(axis=1), np.maximum(*(o.max(axis=1) for o in outside))
        pooled = np.concatenate([high, inside.sum(axis=1) / n, low, np.ones((len(rows), 1))], axis=1).astype(np.float32)
        return real, n, pooled

    def _forward(self, rows: np.ndarray):
        taps = len(self.kernel)
        code = rows.astype(np.int64) + _ZONE
        x = self.embed[code]
        wide = np.concatenate([x[:, j : WIDTH - taps + 1 + j] for j in range(taps)], axis=2)
        h = wide @ self.kernel.reshape(-1, self.kernel.shape[2])
        h += self.bias
        return code, wide, h, *self._pooled(rows, h)

    def logits(self, rows: np.ndarray, batch: int = 128) -> np.ndarray:
        """Outputs.  What a filter makes of a character at each of its places is looked up: there are few characters."""
        taps = len(self.kernel)
        each = [np.ascontiguousarray(self.embed @ k) for k in self.kernel]
        out = []
        for i in range(0, len(rows), batch):
            own = rows[i : i + batch]
            code = own + _ZONE
            h = each[0].take(code[:, : WIDTH - taps + 1], axis=0)
            for j in range(1, taps):
                h += each[j].take(code[:, j : WIDTH - taps + 1 + j], axis=0)
            h += self.bias
            out.append(self._pooled(own, h)[-1] @ self.out)
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logit.astype(np.float64) + b, -60, 60)))

    def gradients(self, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        code, wide, h, real, n, pooled = self._forward(rows)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out, -30, 30)))
        error = ((p - label) * weight / weight.sum()).astype(np.float32)
        back = error[:, None] * self.out[None]
        taps, e = self.kernel.shape[:2]
        begin, end = LEFT - taps // 2, LEFT + SPAN - taps // 2
        f, each = h.shape[2], np.arange(len(rows))[:, None]
        dh = np.zeros_like(h)
        dh[:, begin:end] = (back[:, None, f : 2 * f] / n[:, :, None]) * real[:, begin:end, None]
        left, right = h[:, :begin], h[:, end:]
        at_left, at_right = left.argmax(axis=1), right.argmax(axis=1)
        first = left.max(axis=1) >= right.max(axis=1)
        for block, top in ((0, begin + h[:, begin:end].argmax(axis=1)), (2, np.where(first, at_left, end + at_right))):
            dh[each, top, np.arange(f)[None]] += back[:, block * f : (block + 1) * f] * (pooled[:, block * f : (block + 1) * f] > 0)
        dh *= h > 0
        flat = dh.reshape(-1, f)
        dk = wide.reshape(len(flat), -1).T @ flat
        dwide = dh @ self.kernel.reshape(-1, f).T
        dx = np.zeros((*code.shape, e), np.float32)
        for j in range(taps):
            dx[:, j : j + h.shape[1]] += dwide[:, :, j * e : (j + 1) * e]
        at = (code[:, :, None] * e + np.arange(e)).ravel()
        dembed = np.bincount(at, dx.ravel(), minlength=self.embed.size).reshape(self.embed.shape).astype(self.embed.dtype)
        return [dembed, dk.reshape(self.kernel.shape), flat.sum(axis=0), pooled.T @ error]


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The scale and shift of a logit that fit the labels best (Newton, steps halved until the loss falls); labels are smoothed
    by one finding of either kind, so that labels which part cleanly have a finite fit."""
    many = (label * weight).sum()
    label = np.where(label > 0, (many + 1) / (many + 2), 1 / (weight.sum() - many + 2))
    design, fit = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])

    def loss(f: np.ndarray) -> float:
        z = design @ f
        return float((weight * (np.logaddexp(0, z) - label * z)).sum()) if f[0] > 0 else np.inf

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ fit, -60, 60)))
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (weight * (p - label)))
        while loss(fit - step) > loss(fit) and np.abs(step).max() > 1e-9:
            step /= 2
        fit = fit - step
    return float(fit[0]), float(fit[1])


_ALPHABETS = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", "abcdefghijklmnopqrstuvwxyz0123456789")
_NAMES_MORE = ("pwd", "auth", "credential", "access_key", "private_key", "client-secret", "Authorization: Bearer", "sig")


def variants(left: str, value: str, right: str, draw: np.random.Generator, copies: int) -> list[tuple[str, str, str]]:
    """A labelled secret as it is, and ``copies`` times in other spellings, contexts and lengths."""
    out = [(left, value, right)]
    for i in range(copies):
        alphabet = _ALPHABETS[int(draw.integers(len(_ALPHABETS)))]
        n = int(draw.integers(max(16, LEAST), 65))
        spelled = "".join(alphabet[j] for j in draw.integers(len(alphabet), size=n))
        context = left if i % 3 == 0 else re.sub(r"""\S+\s*[:=]?\s*["']?$""", "", left)
        if i % 3 == 1:
            context += _NAMES_MORE[int(draw.integers(len(_NAMES_MORE)))] + (" = ", ": ", "=", ' = "', " ")[int(draw.integers(5))]
        after = right if i % 2 else " " + re.sub(r"^\W+", "", right)
        out.append((context[-LEFT:], spelled, after))
    return out


def clean_variants(left: str, value: str, right: str, draw: np.random.Generator) -> list[tuple[str, str, str]]:
    """A clean candidate as it is, and as a path, a name of several words or a number."""
    letters = "".join(c for c in value if c.isalpha()) or "words"
    at = np.concatenate(([0], np.cumsum(draw.integers(2, 9, size=5))))
    pieces = [(letters * 6)[a:b] for a, b in zip(at[:-1], at[1:])]
    pieces[-1] += str(draw.integers(100)) if draw.random() < 0.3 else ""
    joined = ("-", "_", "/")[int(draw.integers(3))].join(pieces)
    number = "".join(map(str, draw.integers(10, size=int(draw.integers(LEAST, 21)))))
    return [(left, value, right), (left, joined, right) if draw.random() < 0.7 else (left, number, right)]


def labelled(texts: list[str | None]) -> Iterator[tuple[str, str, str, int]]:
    """(left, value, right, label) of the findings and candidates of texts."""
    for text in texts:
        if not text:
            continue
        taken = base(text)
        spans = {(v, e): 1 for kind in taken for _, e, v in kind if e - v >= LEAST and any(c.isdigit() for c in text[v:e])}
        spans |= dict.fromkeys(candidates(text, taken), 0)
        for (a, b), label in spans.items():
            yield text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT], label


def findings(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """All labelled findings (left, value, right, label), each once; with ``sample`` at most so many of each label,
    those of least hash, of which each task keeps no more than that."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[dict, dict] = ({}, {})
        edge = ["g", "g"]  # beyond every hash

        def told() -> pa.RecordBatch:
            rows = [(draw, *held[label][draw], label) for label in (0, 1) for draw in sorted(held[label])[:sample]]
            columns = list(zip(*rows)) if rows else [[]] * 5
            clean = [[c.encode("utf-8", "replace").decode() for c in column] for column in columns[:4]]
            for own in held:
                own.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in clean), pa.array(columns[4], pa.int32())], names=["draw", "left", "value", "right", "label"])

        for batch in batches:
            for left, value, right, label in labelled(batch.column(0).to_pylist()):
                draw = hashlib.blake2b(f"{left}\0{value}\0{right}".encode("utf-8", "replace"), digest_size=12).hexdigest()
                own = held[label]
                if draw < edge[label]:
                    own[draw] = (left, value, right)
                    if sample is None and len(own) >= 4096:
                        yield told()
                    elif sample is not None and len(own) >= 2 * sample:
                        for old in sorted(own)[sample:]:
                            del own[old]
                        edge[label] = max(own)
        yield told()

    drawn = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "draw string, left string, value string, right string, label int")
    if sample is None:
        return drawn.dropDuplicates(["draw", "label"]).drop("draw")
    each = [drawn.where(F.col("label") == label).dropDuplicates(["draw"]).orderBy("draw").limit(sample) for label in (0, 1)]
    return each[0].unionByName(each[1]).drop("draw")


#: Findings that a task trains on, and rounds after which networks are averaged, if there are as many tasks.
SHARD, ROUNDS = 8192, 4
_KEYS = ["left", "value", "right"]


def _aside(finding: tuple) -> bool:
    return int(hashlib.md5("\0".join(finding[:3]).encode()).hexdigest(), 16) % 5 == 0


def _shown(table: list[tuple], copies: int, alone: bool, draw: np.random.Generator | None = None, want: bool | None = None, each: bool = True) -> tuple[tuple[list, list], tuple[list, list]]:
    """What the network reads of findings to train on, with labels, and of those set aside.  If there are too few secrets to
    part (``alone``) their variants are parted instead.  Without ``draw`` a finding's variants depend on it only; ``want``
    makes those set aside only, or the others; without ``each`` a clean finding is shown as it is or else as its variant."""
    parts: tuple[tuple[list, list], tuple[list, list]] = (([], []), ([], []))
    for *finding, label in table:
        aside = _aside(tuple(finding))
        if want is not None and aside is not want and not (label and alone):
            continue
        rng = draw or np.random.default_rng(int(hashlib.md5("\1".join(finding).encode()).hexdigest()[:15], 16))
        if not label and not each and rng.random() < 0.5:
            own = [tuple(finding)]
        else:
            own = variants(*finding, rng, copies) if label else clean_variants(*finding, rng)[0 if each else 1 :]
        for j, v in enumerate(own):
            x, y = parts[j % 5 == 4] if label and alone else parts[aside]
            x.append(windows(*v)[0])
            y.append(label)
    return parts


def _arrays(part: tuple[list, list]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(part[0], dtype=np.uint8).reshape(-1, WIDTH), np.array(part[1], dtype=np.float32)


def _descend(net: Network, x: np.ndarray, y: np.ndarray, share: float, epochs: int, batch: int, rate: float, end: float, draw: np.random.Generator) -> None:
    """Passes of Adam, the rate falling to ``end``; both labels weigh the same, of which ``share`` are secrets."""
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.embed, net.kernel, net.bias, net.out)]
    t, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for i in range(0, len(x), batch):
            own, t = order[i : i + batch], t + 1
            now = end + (rate - end) * (1 - t / (steps + 1))
            for p, g, m in zip((net.embed, net.kernel, net.bias, net.out), net.gradients(x[own], y[own], weight[own]), moments):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= now * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)


def _findings_of(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table[c].to_pylist() for c in (*_KEYS, "label"))))


def _further(rows: DataFrame, net: Network, n: dict[int, int], alone: bool, copies: int, batch: int, rate: float) -> Network:
    """Train on all findings, each once: rounds of tasks that go on from one network, whose results are averaged."""
    shards = -(-sum(n.values()) // SHARD)
    rounds = min(ROUNDS, shards)
    share = n[1] * (copies + 1) / (n[1] * (copies + 1) + n[0])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*_KEYS), F.lit(shards)).cast("int"))

    def fitter(begin: Network, now: float, end: float):
        def fit(table: pa.Table) -> pa.Table:
            own = Network(*(p.copy() for p in (begin.embed, begin.kernel, begin.bias, begin.out)))
            x, y = _arrays(_shown(_findings_of(table), copies, alone, want=False, each=False)[0])
            _descend(own, x, y, share, 1, batch, now, end, np.random.default_rng(31))
            told = np.concatenate([p.ravel() for p in (own.embed, own.kernel, own.bias, own.out)]).astype(np.float32).tobytes()
            return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int64()), "net": pa.array([told], pa.binary())})

        return fit

    for r in range(rounds):
        fit = fitter(net, *(0.25 * rate * (1 - k / rounds) for k in (r, r + 1)))
        fitted = dealt.where(F.col("shard") % rounds == r).groupBy("shard").applyInArrow(fit, "shard int, n long, net binary").collect()
        whole = sum(f["n"] for f in fitted)
        if whole:
            mean = sum(np.frombuffer(f["net"], np.float32).astype(np.float64) * (f["n"] / whole) for f in sorted(fitted, key=lambda f: f["shard"]))
            shapes = [net.embed.shape, net.kernel.shape, net.bias.shape, net.out.shape]
            parts = np.split(mean.astype(np.float32), np.cumsum([int(np.prod(k)) for k in shapes])[:-1])
            net = Network(*(p.reshape(k).copy() for p, k in zip(parts, shapes)))
    return net


#: Outputs set aside are counted in steps of this size, within these bounds.
STEP, MOST = 1 / 1024, 60


def _counted(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, step, how many) of outputs."""
    steps = np.round(np.clip(net.logits(x).astype(np.float64), -MOST, MOST) / STEP).astype(np.int64)
    (label, step), n = np.unique(np.stack([y.astype(np.int64), steps]), axis=1, return_counts=True)
    return label, step, n


def _counts_of_all(rows: DataFrame, net: Network, alone: bool, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_counted`` of all findings set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _arrays(_shown(_findings_of(pa.Table.from_batches([b])), copies, alone, want=True)[1])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _counted(net, x, y)], names=["label", "step", "n"])

    told = rows.mapInArrow(run, "label long, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))
    found = sorted(tuple(r) for r in told.collect())
    return tuple(np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def train(rows: DataFrame, recall: float = 0.98, epochs: int = 6, batch: int = 64, rate: float = 0.004, positives: int = 2000, steps: int = 1800, sample: int = 6000) -> Network:
    """Fit the network to labelled findings (left, value, right, label).  It begins with at most ``sample`` of each label, in
    ``epochs`` passes or as many as make up ``steps`` steps; if there are more, all of them train it further, and those set aside
    are counted in the tasks."""
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _KEYS]
    rows = stored(rows.select(*clean, F.coalesce(F.col("label"), F.lit(0)).cast("int").alias("label")), "findings")
    n = {0: 0, 1: 0} | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    net = Network.fresh()
    if not n[0] or not n[1]:
        discard(rows)
        return net
    least = [rows.where(F.col("label") == label).orderBy(F.md5(F.concat_ws("\0", *_KEYS)), *_KEYS).limit(sample).collect() for label in (0, 1)]
    table = sorted(tuple(r) for part in least for r in part)
    secrets = [r[:3] for r in table if r[3]]
    draw = np.random.default_rng(29)
    copies = min(60, max(2, positives // len(secrets)))
    alone = all(map(_aside, secrets)) or not any(map(_aside, secrets))
    (x, y), held = map(_arrays, _shown(table, copies, alone, draw))
    _descend(net, x, y, float(y.mean()), max(epochs, -(-steps // -(-len(x) // batch))), batch, rate, 0.0, draw)
    if sum(n.values()) > len(table):
        net = _further(rows, net, n, alone, min(60, max(2, max(positives, n[0] // 10) // n[1])), batch, rate)
        label, step, many = _counts_of_all(rows, net, alone, copies)
    else:
        label, step, many = _counted(net, *held) if len(held[0]) else (np.zeros(0, np.int64),) * 3
    discard(rows)
    if not label.any():
        label, step, many = _counted(net, x, y)
    logit = step * STEP
    weight = many * np.where(label > 0, min(1.0, sample / n[1]), min(1.0, sample / n[0]))
    net.scale = logistic(logit, label, weight)
    secret = label > 0  # steps ascend within a label
    high = float(logit[secret][np.searchsorted(np.cumsum(many[secret]), int((1 - recall) * many[secret].sum()), side="right")])
    below = logit[~secret & (logit < high)]
    low = float(below.max()) if len(below) else high
    net.threshold = max(0.5, float(net.probability(np.array([(low + high) / 2]))[0]))
    return net


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans, best) of each row of (doc_id, text);
    ``spans``: all spans as kind:start:end by start, then kind; ``best``: the greatest score of a candidate, null without one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def look(texts: list[str | None]) -> list[tuple]:
        known = shared.value
        taken = [base(t) if t else [[], [], []] for t in texts]
        spans = [[(a, k, b) for k, kind in enumerate(found) for a, b, _ in kind] for found in taken]
        counts = [[len(kind) for kind in found] for found in taken]
        best: list[float | None] = [None] * len(texts)
        held, of = [], []

        def settle() -> None:
            logit = known.logits(np.stack(held)) if held else []
            greatest: dict[tuple[int, int, int], float] = {}
            for key, v in zip(of, known.probability(np.asarray(logit)).tolist() if held else []):
                greatest[key] = max(v, greatest.get(key, 0.0))
            for (i, a, b), v in greatest.items():
                best[i] = max(v, best[i] or 0.0)
                if v >= known.threshold:
                    spans[i].append((a, 3, b))
            held.clear()
            of.clear()

        for i, text in enumerate(texts):
            for a, b in candidates(text, taken[i]) if text else []:
                rows = windows(text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT])
                held.extend(rows)
                of.extend([(i, a, b)] * len(rows))
                if len(held) >= 4096:
                    settle()
        settle()
        out = []
        for i in range(len(texts)):
            told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans[i])]
            first = ",".join(t for t in told if not t.startswith("model"))
            out.append((*counts[i], len(spans[i]) - sum(counts[i]), hashlib.sha256(first.encode()).hexdigest(), ",".join(told), best[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*look(batch.column(1).to_pylist()))) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "best"])

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, best double"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)
