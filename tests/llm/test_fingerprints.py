import bisect
import hashlib
import re
from itertools import pairwise

import xxhash
from pyspark.sql import functions as F

from inkmill.llm import fingerprints
from tests.llm.data import DOCS, documents, rows

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def texts():
    long = " ".join(WORDS[(i * i + i // 7) % 19] + str(i % 23) for i in range(3000))
    return ["one", "", None, long, long, long[:9000] + " different end " + long[9000:], "日本語の文章はここにあります", " ".join(WORDS), "é " * 7 + "x" * 50, "a b c d e"]


def test_edited_text_and_order(spark):
    ts = texts()
    found = {r["doc_id"]: r for r in rows(fingerprints.compare(documents(spark, ts)))}
    assert sorted(found) == list(range(len(ts)))
    for i, t in enumerate(ts):
        t, following = t or "", ts[(i - 1) % len(ts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert found[i]["n_chars"] == len(t)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    assert found[3]["fingerprint"] == found[4]["fingerprint"] and found[4]["near_next"] == 1.0
    assert found[5]["near_next"] > 0.8 > 0.2 > found[3]["near_next"]


def xx(*values):
    """Hash of strings (by their bytes) or whole numbers, each seeded by the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed=seed)
    return seed


def plain_anchors(text):
    """(hash, place) of each anchor, window by window."""
    spaced = re.sub("([\u2E80-\u9FFF\uAC00-\uD7AF\u0E00-\u0E7F\uF900-\uFAFF])", r" \1 ", text or "")
    h = [xx(w) for w in re.split(r"[ \t-\r]+", spaced) if w]
    if len(h) < 5:
        return [(xx(*h) & 0xFFFFFFFF, 0)] if h else []
    out = []
    for i in range(len(h) - 4):
        p = [xx(a, b) for a, b in pairwise(h[i : i + 5])]
        signed = [x - (x >> 63 << 64) for x in p]
        if min(signed[0], signed[3]) <= min(signed[1], signed[2]):
            out.append((xx(p[0], p[2], h[i + 4]) & 0xFFFFFFFF, i))
    return out


def plain_fingerprint(text):
    found = plain_anchors(text)
    return "".join(f"{h:08x}{at - before}" for (h, at), before in zip(found, [0, *(at for _, at in found)]))


def plain_likeness(one, other):
    """Read from two fingerprints alone."""
    places = []
    for text in (one, other):
        at, own = 0, {}
        for j in range(0, len(text), 9):
            at += int(text[j + 8])
            own.setdefault(text[j : j + 8], at)
        places.append(own)
    a, b = places
    if not a and not b:
        return 1.0
    ends = []
    for x in (b[h] for h in sorted(set(a) & set(b), key=a.get)):
        ends[bisect.bisect_left(ends, x) : bisect.bisect_left(ends, x) + 1] = [x]
    return len(ends) / (len(a) + len(b) - len(ends))


def test_fingerprints_and_likeness_equal_a_plain_version(spark):
    words = [w for w in " ".join(t or "" for t in texts()[7:]).split()]
    ts = [*texts(), " ".join(words[(i * 7919) % len(words)] + str(i * i % 977) for i in range(120_000)), "\x1f\u00a0 a\x0bb", "wort " * 40]
    docs = documents(spark, ts).withColumns({c: F.lit("x") for c in ("fp", "next_text", "half", "fingerprint", "edited", "__end")})
    found = {r["doc_id"]: r for r in rows(fingerprints.compare(docs))}
    assert len(found) == len(ts)
    for i, t in enumerate(ts):
        t, following = t or "", ts[(i - 1) % len(ts)] or ""
        half = len(t) // 2
        own, edited, after = (plain_fingerprint(x) for x in (t, t[: len(t) - half] + following[:half], following))
        assert (found[i]["fingerprint"], found[i]["edited_fingerprint"]) == (own, edited)
        assert abs(found[i]["near_edited"] - plain_likeness(own, edited)) < 1e-12
        assert abs(found[i]["near_next"] - plain_likeness(own, after)) < 1e-12


def test_anchor_rule(spark):
    """Every anchor's window has its least pair at an edge, every other window has it inside."""
    text = " ".join(WORDS * 3)
    q = spark.createDataFrame([(text,)], "text string")
    got = q.select(fingerprints.anchors("text").alias("a")).first()["a"]
    pairs = [r["h"] for r in q.selectExpr("posexplode(transform(sequence(0, size(split(text, ' ')) - 2), i -> xxhash64(xxhash64(split(text, ' ')[i]), xxhash64(split(text, ' ')[i + 1])))) as (i, h)").orderBy("i").collect()]
    want = sum(min(pairs[i], pairs[i + 3]) <= min(pairs[i + 1], pairs[i + 2]) for i in range(len(pairs) - 3))
    assert len(got) == want and 0 < want < len(pairs) - 3


def test_next_over_many_ranges(spark):
    ids = [5 * i if i < 500 else 10_000_000 + i * i for i in range(1500)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(7777, None), (7777, "b")], "doc_id long, text string")
    found = rows(fingerprints.with_next(docs, ["doc_id"], rows_each=20))
    assert len(found) == 1502
    ordered = sorted([*ids, 7777, 7777], reverse=True)
    got = sorted(((r["doc_id"], r["next_doc_id"]) for r in found), reverse=True)
    assert got == sorted(zip(ordered, ordered[1:] + ordered[:1]), reverse=True)


def test_one_and_none(spark):
    one = rows(fingerprints.compare(documents(spark, ["just one text"])))
    assert one[0]["near_next"] == 1.0
    assert fingerprints.compare(spark.createDataFrame([], DOCS)).count() == 0


def longest_ascending(xs):
    best = []
    for i, x in enumerate(xs):
        best.append(1 + max((best[j] for j in range(i) if xs[j] < x), default=0))
    return max(best, default=0)


def test_anchors_keep_their_places_and_moved_text_is_less_like(spark):
    first, second = (" ".join(f"{c}{i * i}" for i in range(1000)) for c in "pq")
    passage = " ".join(f"shared{i}" for i in range(60))
    others = [" ".join(f"{c}{i}" for i in range(3000)) for c in "xy"]
    mixed = " ".join(" ".join(f"p{i * i}" for i in range(a, a + 50)) for a in (400, 0, 700, 300, 350, 900, 100))
    ts = [f"{second} {first}", f"{first} {second}", f"{first} {second}", f"{others[0]} {passage}", f"{passage} {others[1]}", "a b", "a b", first, mixed]
    found = {r["doc_id"]: r for r in rows(fingerprints.compare(documents(spark, ts)))}
    placed = {}
    for i, r in found.items():
        parts = [(r["fingerprint"][j : j + 8], int(r["fingerprint"][j + 8], 16)) for j in range(0, len(r["fingerprint"]), 9)]
        at, placed[i] = 0, {}
        for anchor, distance in parts:
            at += distance
            placed[i].setdefault(anchor, at)
        assert len(parts) == len(placed[i]) and (len(ts[i].split()) - 8 <= at <= len(ts[i].split()) - 5 or len(parts) == 1)
    for i in found:
        a, b = placed[i], placed[(i - 1) % len(ts)]
        n = longest_ascending([b[x] for x in sorted(set(a) & set(b), key=a.get)])
        assert abs(found[i]["near_next"] - n / (len(a) + len(b) - n)) < 1e-12
    assert found[2]["near_next"] == 1.0 and 0.3 < found[1]["near_next"] < 0.35  # the halves changed places
    assert found[4]["near_next"] > 0 and found[6]["near_next"] == 1.0  # a short passage in long texts
