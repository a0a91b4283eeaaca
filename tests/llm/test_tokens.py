"""Byte-level BPE and packing: exact round trips, the library's own ids, whole cover."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from inkmill.llm import byte_bpe, packing
from tests.llm.data import DOCS, documents, rows

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = ["the", "Über", "'s", "don't", " ", "  ", "\n", "\t", "日本", "é", "!?", "...", "123", "<|endoftext|>", "\x01", "\xa0", "\x1c", "x-1", "Σας", "ΟΔΟΣ", "é", "🙂", "word"]
    made = ["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    long = " ".join(rng.choice(["alpha", "beta", "gamma.", "Δέλτα", "\n\n x", "1 2"]) for _ in range(30_000))
    bits = [bin(i).count("1") % 2 for i in range(1024)]  # two words of one polynomial hash
    made += ["".join("ab"[b] for b in bits) + " x", "".join("ba"[b] for b in bits) + " x", "<|endoftext|> z", "a <|StartOfText|>b<|startoftext|>c", "<|endoftext |>"]
    return [*made, None, "", " ", long, "x" * 40_000, "a b " * 20_000, made[0]]


def test_ids_and_bytes_equal_the_library(spark, texts):
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    got = {r["doc_id"]: r for r in rows(byte_bpe.encode_decode(documents(spark, texts), RANKS, P.PATTERN))}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(got[i]["decoded"]) == (t or "").encode()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert len(list(byte_bpe.safe_pieces(texts[158]))) > 5


def test_packing_covers_every_id_once(spark, texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    ids = [np.array(e.ids + [2], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    found = rows(packing.pack(documents(spark, texts), WORDS))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert sorted(pieces) == list(range(len(texts)))
    for doc_id, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(ids[doc_id])
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        used += at
    assert used / 4096 / len(sequences) > 0.9


def test_supplied_documents_have_little_padding(spark):
    found = rows(packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORDS))
    n = len({r["sequence_id"] for r in found})
    assert sum(r["length"] for r in found) / 4096 / n > 0.98


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(3)
    for need in (rng.integers(0, 40, 64), np.zeros(64, int), np.eye(64, dtype=int)[63] * 5, np.eye(64, dtype=int)[0] * 1000, rng.integers(0, 2, 64)):
        plan = packing.whole_patterns(need, 64)
        total = sum((p * n for p, n in plan), np.zeros(64, int))
        assert (total == need).all() and all((p * np.arange(1, 65)).sum() <= 64 and n > 0 for p, n in plan)
        bound = -(-int((need * np.arange(1, 65)).sum()) // 64)
        assert sum(n for _, n in plan) <= bound * 1.05 + 3


def test_knapsack():
    best, pattern = packing.knapsack(np.array([0.1, 0.5, 0.0, 1.1]), 7)
    assert best == pytest.approx(1.1 + 0.5 + 0.1) and pattern.tolist() == [1, 1, 0, 1]


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(empty, WORDS).count() == 0 and byte_bpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0
    docs = documents(spark, ["same text"]).unionByName(documents(spark, ["same text"]))
    assert packing.pack(docs, WORDS).count() == 2
