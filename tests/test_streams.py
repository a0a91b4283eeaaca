"""Streams with state: order, late messages, restarts, replayed batches."""

import random

from inkmill import workflows
from inkmill.sources.store import Store
from inkmill.streaming import messages

MESSAGE = "conv_id string, turn long, role string, text string"
TOPICS = ("red", "blue")


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(f"{folder}/{name}")


def plain(batches, n):
    """What is told, with lists of all messages: the topic as of a turn, the last n up to it."""
    seen, out = {}, {}
    for batch in batches:
        for conv, turn, role, text in sorted(batch, key=lambda m: m[1]):
            own = seen.setdefault(conv, [])
            own.append((turn, role, text))
            own.sort()
            upto = [m for m in own if m[0] <= turn]
            named = [next(t for t in TOPICS if t in x) for _, _, x in upto if any(t in x for t in TOPICS)]
            out[conv, turn] = (named[-1] if named else None, "\n".join(f"{'用户' if r == 'user' else '助手'}: {x}" for _, r, x in upto[-n:]))
    return out


def test_messages_in_order_restarts_and_late_ones(spark, tmp_path):
    draw = random.Random(2)
    said = lambda turn: (f"c{draw.randrange(3)}", turn, draw.choice(["user", "assistant"]), draw.choice(["hello", "the red one", "so blue", "well"]))
    first, second = [said(t) for t in range(30)], [said(t) for t in range(30, 50)]
    late = [m for m in second if m[1] in (46, 47)]  # come a batch later, among the last messages
    batches = [first, [m for m in second if m not in late], late]
    path, place = str(tmp_path / "in"), str(tmp_path / "place")
    want = {}
    for i, batch in enumerate(batches):
        put(spark, path, batch, f"part{i}")
        got = messages.run_available(spark, path + "/*", place, TOPICS, n=5)  # each time a restart
        want = plain(batches[: i + 1], 5)
        rows = got.collect()
        assert len(rows) == len(want) and {(r["conv_id"], r["turn"]): (r["current_topic"], r["history"]) for r in rows} == want
    again = messages.run_available(spark, path + "/*", place, TOPICS, n=5)
    assert again.count() == len(want)  # nothing new, nothing told twice
    assert spark.conf.get(messages.PROVIDER) != messages.ROCKS  # no setting stays behind


def test_a_message_older_than_all_that_is_known(spark, tmp_path):
    path, place = str(tmp_path / "in"), str(tmp_path / "place")
    put(spark, path, [("c", t, "user", "red" if t == 3 else "x") for t in range(3, 9)], "a")
    messages.run_available(spark, path + "/*", place, TOPICS, n=2)
    put(spark, path, [("c", 1, "user", "blue"), ("c", 9, "user", "y")], "b")
    got = {r["turn"]: (r["current_topic"], r["history"]) for r in messages.run_available(spark, path + "/*", place, TOPICS, n=2).collect()}
    assert got[1] == ("blue", "用户: blue") and got[9] == ("red", "用户: x\n用户: y")


def test_null_texts_and_keys(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [("c", 1, "user", None), (None, 1, "user", "red"), ("c", 2, None, "red"), ("c", None, "user", "blue")], "a")
    got = {r["turn"]: (r["role"], r["current_topic"], r["history"]) for r in messages.run_available(spark, str(tmp_path / "in") + "/*", None, TOPICS, n=3).collect()}
    assert got == {1: ("user", None, ""), 2: (None, "red", "助手: red")}


def log(store):
    return sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in store.messages.read().collect())


def test_a_replayed_chat_batch_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    asked = []

    def provider(prompts):
        return [str(p.count("用户: ")) for p in prompts]

    one = spark.createDataFrame([("a", "hello", 1), ("a", "again", 2), (None, "new here", 1), ("b", " ", 1)], "conv_id string, text string, sent int")
    first = {r["conv_id"]: (r["turn"], r["response"]) for r in workflows.chat_batch(store, one, provider, "s-0").collect()}
    assert first["a"] == (1, "2") and len(first) == 2 and "b" not in first
    before = log(store)
    assert [m[1:3] for m in before if m[0] == "a"] == [(0, "user"), (1, "user"), (2, "assistant")]
    again = {r["conv_id"]: (r["turn"], r["response"]) for r in workflows.chat_batch(store, one, provider, "s-0").collect()}
    assert again == first and log(store) == before  # a retry, and nothing was added
    workflows.chat_batch(store, one.where("conv_id = 'a' and sent = 1"), provider, "s-1")
    assert [m[1] for m in log(store) if m[0] == "a"] == [0, 1, 2, 3, 4]

    def fails(prompts):
        asked.append(len(prompts))
        raise RuntimeError("no service")

    two = spark.createDataFrame([("z", "x")], "conv_id string, text string")
    assert workflows.chat_batch(store, two, fails, "t-0").first()["response"] is None
    assert [m for m in log(store) if m[0] == "z"] == [("z", 0, "user", "x")]
    workflows.chat_batch(store, two, provider, "t-0")  # the retry of a batch whose provider failed
    assert [m for m in log(store) if m[0] == "z"] == [("z", 0, "user", "x"), ("z", 1, "assistant", "1")]
    assert [r["turn"] for r in store.history("z").collect()] == [0, 1]


def test_chat_as_a_stream_with_a_restart(spark, tmp_path):
    store, path, place = Store(spark, str(tmp_path / "store")), str(tmp_path / "in"), str(tmp_path / "place")
    provider = lambda prompts: [str(p.count("用户: ")) for p in prompts]
    for i, rows in enumerate([[("a", "one")], [("a", "two"), ("b", "x")]]):
        spark.createDataFrame(rows, "conv_id string, text string").coalesce(1).write.parquet(f"{path}/p{i}")
        for _ in range(2):  # the second run finds nothing new
            workflows.chat_stream(store, spark.readStream.schema("conv_id string, text string").parquet(path + "/*"), provider, place, "s")
    assert log(store) == [("a", 0, "user", "one"), ("a", 1, "assistant", "1"), ("a", 2, "user", "two"), ("a", 3, "assistant", "2"), ("b", 0, "user", "x"), ("b", 1, "assistant", "1")]


def test_files_as_a_stream_with_a_restart_and_broken_files(spark, tmp_path):
    store, folder, place = Store(spark, str(tmp_path / "store")), tmp_path / "in", str(tmp_path / "place")
    folder.mkdir()
    (folder / "f1_one.txt").write_text("第一章 Cells\nwater\n第二章 Atoms\nelectrons\n", encoding="utf-8")
    (folder / "f2_bad.docx").write_bytes(b"no archive at all")
    (folder / "f3_x.exe").write_bytes(b"x")
    status = lambda: {r["file_id"]: r for r in workflows.take_in(store, str(folder), place).collect()}
    first = status()
    assert {k: (r["parse_status"], r["chapter_count"]) for k, r in first.items()} == {"f1": ("completed", 2), "f2": ("failed", 0), "f3": ("failed", 0)}
    assert first["f2"]["error_message"].startswith("BadZipFile: ") and first["f3"]["error_message"] == "unsupported file format: .exe"
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "chapters").rglob("part-*")}
    assert status() == first  # nothing new
    (folder / "f4_two.md").write_text("# T\n## Stars\nhydrogen\n", encoding="utf-8")
    again = status()  # a restart
    assert set(again) == {"f1", "f2", "f3", "f4"} and {k: again[k] for k in first} == first
    assert all(p.stat().st_mtime_ns == t for p, t in stamp.items())  # files of before were not parsed again
    assert {r["file_id"]: r["n"] for r in store.chapters.read().groupBy("file_id").count().withColumnRenamed("count", "n").collect()} == {"f1": 2, "f4": 1}
