"""The pipeline: each stage against a plain version of its decision, and the stages together."""

import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from inkmill.llm import toxicity
from tests.llm.data import rows
from tests.llm.test_dedup import components, cut
from tests.llm.test_pii import TEXTS, brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append((name, docs))
    return dict(out)


def by_id(df):
    return {r["doc_id"]: r for r in rows(df)}


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert stages[n].schema.names == stages["input"].schema.names


def test_toxicity_drops_what_scores_high(spark, stages):
    model = toxicity.fit(stages["input"], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = by_id(toxicity.score(stages["input"], model))
    assert set(by_id(stages["toxicity"])) == {i for i, r in scores.items() if r["score"] < 0.5}


def test_near_copies(stages):
    before = by_id(stages["toxicity"])
    ids = sorted(before)
    _, comp = components([before[i]["text"] for i in ids], 5, 80)
    assert sorted(by_id(stages["near_copies"])) == sorted({ids[c] for c in comp})


def test_substrings(stages):
    before, after = by_id(stages["near_copies"]), by_id(stages["substring_dedup"])
    ids = sorted(before)
    for i, _, gone, kept in cut([before[i]["text"] for i in ids], ids, 13):
        assert after[i]["text"] == (kept if gone else before[i]["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_personal_data(stages):
    before, after = by_id(stages["substring_dedup"]), by_id(stages["pii"])
    assert set(before) == set(after)
    for i, r in before.items():
        if not any(brute(r["text"]).values()) and not re.search("[A-Z]{2}[0-9]{2}", r["text"]):
            assert after[i]["text"] == r["text"]
        assert not brute(after[i]["text"])["email"]


def test_packing_holds_all_that_is_left(stages):
    found, docs = rows(stages["packing"]), by_id(stages["pii"])
    assert {r["doc_id"] for r in found} == set(docs)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in found:
        ids = library.encode(docs[r["doc_id"]]["text"], add_special_tokens=False).ids + [2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"]


def test_run_equals_the_stages(spark, stages):
    want = sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows(stages["packing"]))
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows(corpus_pipeline.run(spark, SF))) == want


def test_edges_pass_every_stage(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {6, 7} <= {r["doc_id"] for r in rows(docs.where(F.coalesce("text", F.lit("")) == ""))}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
