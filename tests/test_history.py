"""Versions, as-of joins, rollback, comparison and undo against plain Python."""

import random

import pytest

from inkmill.operators import history

LOG = "id string, seq long, op string, name string, size long"


def changes(seed=1, keys=6, n=400):
    """One key has a third of all changes."""
    draw = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        key, seq = ("k0" if draw.random() < 0.33 else f"k{draw.randrange(keys)}"), draw.randrange(2000)
        if (key, seq) not in used:
            used.add((key, seq))
            rows.append((key, seq, "delete" if draw.random() < 0.2 else "set", draw.choice(["a", "b", None]), draw.randrange(4)))
    return rows


def state(rows, version=None):
    out = {}
    for key, _, op, name, size in sorted((r for r in rows if version is None or r[1] <= version), key=lambda r: r[1]):
        out.pop(key, None)
        if op == "set":
            out[key] = (name, size)
    return out


def as_dict(df):
    return {r["id"]: (r["name"], r["size"]) for r in df.collect()}


@pytest.fixture(scope="module")
def log(spark):
    rows = changes()
    return rows, spark.createDataFrame(rows, LOG)


def test_states_and_intervals(log):
    rows, df = log
    for version in (None, -1, 0, 700, 1999):
        assert as_dict(history.as_of(df, ["id"], version)) == state(rows, version)
    for span in (7, 1 << 16):  # a key's changes in many pieces, and in one
        got = {(r["id"], r["valid_from"]): r["valid_to"] for r in history.validity(df, ["id"], span).collect()}
        for key in {r[0] for r in rows}:
            seqs = sorted(r[1] for r in rows if r[0] == key)
            for r in rows:
                if r[0] == key and r[2] == "set":
                    assert got[key, r[1]] == next((s for s in seqs if s > r[1]), None)
        assert len(got) == sum(r[2] == "set" for r in rows)


@pytest.mark.parametrize("span", [5, 1 << 16])
def test_as_of_join(spark, log, span):
    rows, df = log
    draw = random.Random(3)
    asked = [(f"k{draw.randrange(8)}", draw.randrange(2100), i) for i in range(200)] + [(rows[0][0], rows[0][1], 900)]
    table = spark.createDataFrame(asked, "id string, at long, size long")  # a column named like a field
    got = {r["size"]: r["name"] for r in history.as_of_each(table, df, ["id"], span=span).collect()}
    assert got == {i: state(rows, at).get(key, (None,))[0] for key, at, i in asked}


def test_compare_and_rollback(spark, log):
    rows, df = log
    a, b = state(rows, 300), state(rows, 1500)
    want = {}
    for key in a.keys() | b.keys():
        if key not in a or key not in b:
            want[key] = ("added" if key not in a else "removed", [])
        elif a[key] != b[key]:
            want[key] = ("changed", [f for f, x, y in zip(("name", "size"), a[key], b[key]) if x != y])
    assert {r["id"]: (r["change"], r["changed_fields"]) for r in history.compare(df, ["id"], 300, 1500).collect()} == want
    back = history.rollback(df, ["id"], 300, 5000)
    assert as_dict(history.as_of(df.unionByName(back), ["id"])) == a
    assert as_dict(history.as_of(df.unionByName(back), ["id"], 1500)) == b  # history stays
    assert history.rollback(df.unionByName(back), ["id"], 300, 6000).collect() == []  # nothing differs any more


def stacks(commands):
    """(key, seq) of live commands and what undid the others, with a list as a stack."""
    stack, undone = {}, {}
    for key, seq, undo, _ in sorted(commands, key=lambda c: c[1]):
        own = stack.setdefault(key, [])
        if not undo:
            own.append(seq)
        elif own:
            undone[key, own.pop()] = seq
    return {(k, s) for k, own in stack.items() for s in own}, undone


COMMANDS = "decision_id string, seq long, undo boolean, action string"


@pytest.mark.parametrize("share", [0.2, 0.5, 0.7])
@pytest.mark.parametrize("span", [4, 1 << 16])
def test_undo_is_a_stack(spark, share, span):
    draw = random.Random(int(share * 10))
    commands = [("d0" if draw.random() < 0.4 else f"d{draw.randrange(5)}", s, draw.random() < share, draw.choice(["keep", "merge", "remove"])) for s in draw.sample(range(3000), 500)]
    live, undone = stacks(commands)
    got = history.command_log(spark.createDataFrame(commands, COMMANDS), ["decision_id"], span).collect()
    assert len(got) == len(commands)
    assert {(r["decision_id"], r["seq"]) for r in got if r["live"]} == live
    assert {(r["decision_id"], r["seq"]): r["undone_by"] for r in got if r["undone_by"] is not None} == undone


def test_overrides_and_return_to_the_original(spark):
    decisions = spark.createDataFrame([("a", "merge", "r1"), ("b", "keep", "r2"), ("c", "keep", "r3")], "decision_id string, action string, reason string")
    commands = [("a", 1, False, "keep"), ("a", 2, False, "remove"), ("a", 3, True, None), ("b", 4, False, "remove"), ("b", 5, True, None), ("b", 6, True, None), ("x", 7, False, "keep")]
    got = {r["decision_id"]: tuple(r)[1:] for r in history.overridden(decisions, spark.createDataFrame(commands, COMMANDS)).collect()}
    assert got == {"a": ("keep", "r1", "merge", 1, 1), "b": ("keep", "r2", "keep", 0, 1), "c": ("keep", "r3", "keep", 0, 0)}
    none = history.overridden(decisions, spark.createDataFrame([], COMMANDS)).collect()
    assert [r["action"] for r in none] == ["merge", "keep", "keep"]
