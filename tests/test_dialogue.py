"""Dialogue windows, state, the stream, stores, files and model hooks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from inkmill.functions import hooks
from inkmill.operators import dialogue
from inkmill.sources import files
from inkmill.sources.store import Store
from inkmill.streaming.conversations import run_available

MESSAGES = "conv_id string, turn long, role string, text string"


@pytest.fixture(scope="module")
def messages(spark):
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"消息{i}" + ("整合" if i == 3 else "决策知识点" if i == 8 else "")) for i in range(15)]
    return spark.createDataFrame([*rows, ("b", 0, "user", "x" * 80)], MESSAGES)


def test_recent_and_summary(messages):
    assert [r["turn"] for r in dialogue.recent(messages, 5).where("conv_id = 'a'").orderBy("turn").collect()] == [10, 11, 12, 13, 14]
    got = {r["conv_id"]: r["summary"] for r in dialogue.summaries(messages).collect()}
    assert got["b"] == "最近对话：\n用户: " + "x" * 50 + "...\n"
    assert got["a"].startswith("最近对话：\n用户: 消息10...\n助手: 消息11...\n")


def test_sticky_topic(messages):
    got = dialogue.sticky_topic(messages, bucket_turns=2).where("conv_id = 'a'").orderBy("turn").collect()
    assert [r["current_topic"] for r in got] == [None] * 3 + ["整合"] * 5 + ["决策"] * 7


def test_clear_feedback_latest(spark, messages):
    left = dialogue.live(messages, spark.createDataFrame([("a", 12)], "conv_id string, turn long"))
    assert sorted((r["conv_id"], r["turn"]) for r in left.collect()) == [("a", 13), ("a", 14), ("b", 0)]
    added = dialogue.feedback(messages, spark.createDataFrame([("b", 1, "ok")], "conv_id string, turn long, text string"))
    assert added.where("conv_id = 'b' and turn = 1").first()["text"] == "[反馈] ok"
    log = spark.createDataFrame([("t", 1, "a"), ("t", 3, "c"), ("t", 2, "b"), ("u", 1, "z")], "task_id string, seq long, state string")
    assert sorted((r["task_id"], r["state"]) for r in dialogue.latest(log, "task_id", ["seq"]).collect()) == [("t", "c"), ("u", "z")]


def test_file_listing(spark):
    own = spark.createDataFrame([("1", "a.txt"), ("2", "b.txt"), ("3", "c.txt"), ("1", "1_parsed.json")], "file_id string, name string")
    status = spark.createDataFrame([("1", "failed", 4)], "file_id string, status string, chapter_count int")
    got = dialogue.file_listing(own, status, spark.createDataFrame([("2",)], "file_id string")).orderBy("file_id").collect()
    assert [(r["parse_status"], r["chapter_count"]) for r in got] == [("failed", 4), ("completed", 0), ("pending", 0)]


def test_stream_over_several_files(spark, messages, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    for part in (messages.where("turn < 6"), messages.where("turn >= 6")):
        part.coalesce(1).write.mode("append").parquet(path)
    got = {r["conv_id"]: r for r in run_available(spark, path).collect()}
    assert (got["a"]["messages"], got["a"]["last_turn"], got["a"]["current_topic"]) == (15, 14, "决策")
    assert got["b"]["messages"] == 1


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("前言\n第一章 甲\n内容\r\nx\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("第二章 乙\n国语".encode("gbk"))
    (tmp_path / "c.md").write_text("# T\n## A\nx\n## B\ny", encoding="utf-8")
    (tmp_path / "d.txt").write_text("  no headings ", encoding="utf-8")
    got = [(r["textbook_id"], r["title"], r["content"]) for r in files.parse_files(spark, str(tmp_path)).orderBy("textbook_id", "chapter_id").collect()]
    assert got == [("a", "章节 1", "前言"), ("a", "第一章 甲", "内容\nx"), ("b", "第二章 乙", "国语"), ("c", "A", "x"), ("c", "B", "y"), ("d", "章节 1", "no headings")]
    (tmp_path / "e.odd").write_text("x")
    with pytest.raises(ValueError):
        files.parse_files(spark, str(tmp_path), strict=True)
    assert files.parse_files(spark, str(tmp_path)).count() == 6
    sizes = spark.createDataFrame([("a.TXT", 200 * 1024 * 1024), ("b.pdf", 200 * 1024 * 1024 + 1), ("c.exe", 1)], "filename string, size long")
    assert [r["accepted"] for r in files.upload_check(sizes).collect()] == [True, False, False]


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files_and_failures_alone(spark, tmp_path):
    w, m = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    archive(tmp_path / "a.docx", {
        "word/document.xml": f"<w:document {w}><w:body>{p('first')}{p('One', 'x1')}{p('a &amp; b')}<w:tbl><w:tr><w:tc>{p('in a table')}</w:tc></w:tr></w:tbl>{p('第二章 Two')}{p('c')}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {w}><w:style w:styleId='x1'><w:name w:val='heading 1'/></w:style></w:styles>",
    })
    sheet = lambda rows: f"<worksheet {m}><sheetData>{rows}</sheetData></worksheet>"
    archive(tmp_path / "b.xlsx", {
        "xl/workbook.xml": f"<workbook {m} xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='S1' r:id='r1'/><sheet name='S2' r:id='r2'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Target='worksheets/s1.xml'/><Relationship Id='r2' Target='/xl/worksheets/s2.xml'/></Relationships>",
        "xl/sharedStrings.xml": f"<sst {m}><si><t>word</t></si></sst>",
        "xl/worksheets/s1.xml": sheet("<row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1'><v>1.5</v></c></row><row r='3'><c r='B3' t='b'><v>1</v></c><c r='C3' t='inlineStr'><is><t>in</t></is></c></row>"),
        "xl/worksheets/s2.xml": sheet(""),
    })
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = [(r["textbook_id"], r["title"], r["content"]) for r in files.parse_files(spark, str(tmp_path)).orderBy("textbook_id", "chapter_id").collect()]
    assert [g[0] for g in got] == ["a", "a", "a", "b"]
    assert [g[2] for g in got] == ["first", "a & b", "c", "word\t\t1.5\n\tTrue\tin"] and [g[1] for g in got][1:] == ["One", "第二章 Two", "S1"]
    status = {r["filename"]: (r["parse_status"], r["error_message"], r["chapter_count"]) for r in files.parse_status(spark, str(tmp_path)).collect()}
    assert status == {"a.docx": ("completed", None, 3), "b.xlsx": ("completed", None, 1), "c.docx": ("failed", "BadZipFile: File is not a zip file", 0), "d.pdf": ("failed", "unsupported file format: .pdf", 0)}


def test_sheets_and_paragraphs(spark):
    cells = [("p", "f.xlsx", 0, "S1", 0, ["a", None, "b"]), ("p", "f.xlsx", 0, "S1", 1, [None, " "]), ("p", "f.xlsx", 1, "S2", 0, [""]), ("p", "f.xlsx", 2, "S3", 0, ["c"]), ("q", "g.xlsx", 0, "S", 0, [None])]
    got = files.cells_to_chapters(spark.createDataFrame(cells, "path string, filename string, sheet_no int, sheet string, row int, cells array<string>")).orderBy("path", "chapter_id").collect()
    assert [(r["title"], r["content"], r["char_count"]) for r in got] == [("S1", "a\t\tb", 4), ("S3", "c", 1), ("g", "No content found", 0)]
    rows = [("p", "f.docx", 0, "Heading 1", "H"), ("p", "f.docx", 1, None, "x")]
    got = files.paragraphs_to_chapters(spark.createDataFrame(rows, "path string, filename string, pos int, style string, text string")).collect()
    assert [(r["title"], r["content"]) for r in got] == [("H", "x")]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.nodes.read().count() == 0
    nodes = spark.createDataFrame([("n1", "x", 1), ("n2", "y", 2)], "id string, name string, seq long")
    links = spark.createDataFrame([("n1", "n2", "r", 1)], "source string, target string, relation_type string, seq long")
    store.save_graph("f1", nodes, links)
    store.save_graph("f2", nodes.limit(1), links)
    store.save_graph("f1", nodes.where("id = 'n2'"), links)
    assert [r["id"] for r in store.nodes.load("f1").collect()] == ["n2"] and store.nodes.load("f2").count() == 1
    store.save_graph("f2", nodes.limit(1), links.limit(0))
    assert store.relations.load("f2").count() == 0 and store.relations.load("f1").count() == 1
    assert store.delete_graph("f1") and not store.delete_graph("f1")
    assert [r[0] for r in store.nodes.keys().collect()] == ["f2"]
    vectors = spark.createDataFrame([("i", "a", [1.0, 0.0], "text a"), ("i", "b", [0.0, 1.0], "text b")], "index_name string, id string, vector array<double>, content string")
    store.vectors.save(vectors)
    assert store.search("i", [0.1, 1.0], 1).first()["content"] == "text b"
    store.states.append(spark.createDataFrame([("t", 1, "a")], "task_id string, seq long, state string"))
    store.states.append(spark.createDataFrame([("t", 2, "b")], "task_id string, seq long, state string"))
    assert store.task().first()["state"] == "b"


def test_hooks(spark):
    chapters = spark.createDataFrame([("b", "ch_00", "T", "Alpha meets Beta. Then Alpha\nGamma", 1), ("b", "ch_01", "U", "Beta again Beta", 2)], "textbook_id string, chapter_id string, title string, content string, page_start int")
    nodes, relations = hooks.extract_graph(chapters, hooks.rule_provider)
    got = {r["name"]: r for r in nodes.collect()}
    assert set(got) == {"Alpha", "Beta", "Then", "Gamma"} and got["Beta"]["frequency"] == 2 and got["Beta"]["chapter"] == "T"
    assert relations.count() == 3

    def failing(prompts):
        if "bad" in prompts[0]:
            raise RuntimeError("no")
        return ['{"is_equivalent": true, "confidence": 0.9, "reason": "r"}']

    asked = spark.createDataFrame([("good", "merge", "c"), ("bad", "keep", "")], "prompt string, action string, context string")
    assert [(r["is_equivalent"], r["confidence"]) for r in hooks.verify_pairs(asked, failing).collect()] == [(True, 0.9), (False, 0.0)]
    assert [(r["reason"], r["reason_confidence"]) for r in hooks.decision_reasons(asked, failing).collect()] == [("r", 0.9), ("基于规则判断: keep", 0.5)]
    assert {r["prompt"]: r["answer"] for r in hooks.answer_questions(asked, failing).collect()}["bad"] == hooks.NOT_FOUND


def test_context_and_citations(spark):
    hits = spark.createDataFrame([(2, "k2", "T", "C2", 3, "b" * 300, 0.5), (1, "k1", None, "C1", None, "a", 0.9)], "rank int, chunk_id string, textbook_title string, chapter_title string, page_start int, content string, similarity double")
    assert hits.agg(dialogue.rag_context().alias("c")).first()["c"] == "[来源: , C1]\na\n\n[来源: T, C2]\n" + "b" * 300
    assert [len(r["content"]) for r in dialogue.citations(hits).orderBy(F.desc("relevance_score")).collect()] == [1, 200]
