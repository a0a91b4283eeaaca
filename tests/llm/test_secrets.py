"""Secret scans: base spans against a plain reader, gradients, unseen kinds of secrets, clean words, odd tables."""

import hashlib
import re

import numpy as np
import pytest

from inkmill.llm import secret_scan as ss
from tests.llm.data import documents, rows

VALUE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def plain_assign(text):
    """The contract's pattern read letter by letter."""
    out, i = [], 0
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while i < len(text):
        for name in names:
            j = i + len(name)
            if low[i:j] != name:
                continue
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            k = j
            while k < len(text) and text[k] in VALUE:
                k += 1
            if k > j:
                if k - j >= 6:
                    out.append((i, k))
                i = k - 1
                break
        i += 1
    return out


def plain_runs(text, letters, least, begin=""):
    out, i = [], 0
    while i < len(text):
        if text.startswith(begin, i) and (begin or text[i] in letters):
            j = i + len(begin)
            while j < len(text) and text[j] in letters:
                j += 1
            if j > i + len(begin):
                if j - i >= least:
                    out.append((i, j))
                i = j
                continue
        i += 1
    return out


def plain(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kinds = (plain_assign(text), plain_runs(text, upper, 20, "AKIA"), plain_runs(text, "0123456789abcdef", 24))
    told = [(a, k, b) for k, spans in enumerate(kinds) for a, b in spans]
    return [len(s) for s in kinds], ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in sorted(told))


def test_base_spans_equal_a_plain_reader(spark):
    rng = np.random.default_rng(8)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABC123", "0123456789abcdef", "deadbeef", "é", "ſecret", "K", "x", ".", "\n", "abc", "toketoken", "-_+/"]
    texts = ["".join(rng.choice(pieces, size=rng.integers(1, 30))) for _ in range(1500)]
    texts += [None, "", "secret=token = abcdefgh", "token:" + "A" * 100_000, "é" * 7 + "AKIA" + "Z9" * 8]
    got = rows(ss.scan(documents(spark, texts), ss.Network.fresh()))
    for text, r in zip(texts, sorted(got, key=lambda r: r["doc_id"])):
        counts, told = plain(text or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts, text
        assert r["spans"] == told and r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["n_model"] == 0  # an untrained network adds nothing


def test_gradients():
    rng = np.random.default_rng(9)
    net = ss.Network.fresh(e=3, filters=4, taps=3)
    for name in ("embed", "kernel", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = rng.integers(0, ss.CLASSES, size=(6, ss.WIDTH)).astype(np.uint8)
    x[2, ss.LEFT + 10 :] = ss._PAD
    y, w = np.array([0, 1, 1, 0, 1, 0.0]), np.ones(6)

    def loss():
        z = net._forward(x)[-1].astype(np.float64) @ net.out
        return float((np.logaddexp(0, z) - y * z).mean())

    for name, g in zip(("embed", "kernel", "bias", "out"), net.gradients(x, y, w)):
        p = getattr(net, name)
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g).ravel())[:4]]:
            old, step = p[at], 1e-3
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], abs=2e-3, rel=0.1)


def test_outputs_are_looked_up(monkeypatch):
    """Outputs for a scan do not go through what training needs, and are the same."""
    rng = np.random.default_rng(10)
    x = rng.integers(0, ss.CLASSES, size=(300, ss.WIDTH)).astype(np.uint8)
    x[::3, ss.LEFT + 12 : ss.LEFT + ss.SPAN] = ss._PAD
    x[5] = ss._PAD
    net = ss.Network.fresh()
    want = net._forward(x)[-1] @ net.out
    monkeypatch.setattr(ss.Network, "_forward", None)
    assert np.allclose(net.logits(x), want, atol=1e-5) and len(net.logits(x[:0])) == 0


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, ss.train(ss.findings(docs))


def test_adds_unseen_secrets_and_leaves_clean_words(spark, trained):
    docs, net = trained
    rng = np.random.default_rng(10)
    letters = list(VALUE[:62])
    hidden = ["".join(rng.choice(letters, size=40)) for _ in range(40)] + ["".join(rng.choice(list("0123456789ABCDEF"), size=32)) for _ in range(20)]
    texts = [f"of the them access_key: {h} and then" for h in hidden] + ["the internationalization of " + "4929 3847 5610 2938", "see www.example.org/some-long-path-of-words", "abc " * 400]
    got = sorted(rows(ss.scan(documents(spark, texts), net)), key=lambda r: r["doc_id"])
    caught = [r["spans"] == f"model:{t.index(h)}:{t.index(h) + len(h)}" for r, t, h in zip(got, texts, hidden)]
    assert sum(caught) >= 0.9 * len(hidden)
    assert all(r["n_model"] == 0 for r in got[len(hidden) :])
    every = rows(ss.scan(docs, net))
    assert sum(r["n_model"] > 0 for r in every) <= 0.005 * len(every)  # clean documents stay clean


def test_recall_of_labelled_findings_with_their_kind_unknown(trained):
    docs, net = trained
    texts = [r["text"] for r in docs.select("text").collect()]
    secret = [r[:3] for r in ss.labelled(texts) if r[3]]
    clean = [r[:3] for r in ss.labelled(texts) if not r[3]]
    score = lambda part: net.probability(net.logits(np.stack([w for r in part for w in ss.windows(*r)[:1]])))
    assert len(secret) >= 5 and (score(secret) >= net.threshold).mean() >= 0.95
    assert (score(clean) < net.threshold).mean() >= 0.99


def test_whole_candidates_are_read(trained):
    _, net = trained
    value = "a" * 300 + "9f8e7d6c5b4a39281706f5e4d3c2b1a0" + "b" * 300
    assert len(ss.windows("", value, "")) > 20
    rows_ = np.stack(ss.windows("", value, ""))
    assert b"9f8e7d6c5b4a" in rows_.tobytes()
    assert [m.span() for m in re.finditer("x{12,}", "é " + "x" * 12)] == ss.candidates("é " + "x" * 12, [[], [], []])


def test_odd_tables(spark, trained):
    _, net = trained
    table = spark.createDataFrame([(1, "token = abcdef12", 3, "s"), (None, None, 4, None), (1, "token = abcdef12", 3, "s")], "doc_id long, text string, spans long, best string")
    got = rows(ss.scan(table, net))
    assert [r["spans"] for r in got if r["doc_id"] == 1] == ["assign:0:16"] * 2
    assert [r["spans"] for r in got if r["doc_id"] is None] == [""]
    assert rows(ss.scan(table.limit(0), net)) == [] and rows(ss.findings(table.limit(0))) == []
    nothing = ss.train(ss.findings(table.where("doc_id is null")))
    assert rows(ss.scan(table, nothing))[0]["n_model"] == 0


def test_sample_is_bounded_and_follows_the_hash(spark):
    texts = [f"plainwordnumber{i} other{i}wordsarelong token = 12345678901234{i}" for i in range(50)]
    small = {r["value"] for r in rows(ss.findings(documents(spark, texts).repartition(4), sample=7))}
    whole = rows(ss.findings(documents(spark, texts), sample=7))
    assert len(whole) == 14 and {r["value"] for r in whole} == small


def test_all_findings_train_and_are_counted(spark, monkeypatch):
    """Beyond the sample each finding still trains the network or is counted, once."""
    monkeypatch.setattr(ss, "SHARD", 40)
    texts = [f"plainwordnumber{i} other{i}wordsarelong token = 12345678901234{i}" for i in range(90)]
    docs = documents(spark, texts * 2)
    every = ss.findings(docs)
    assert {tuple(r) for r in every.collect()} == set(ss.labelled(texts)) and every.count() == len(set(ss.labelled(texts)))
    seen, counted = [], []
    further, counts = ss._further, ss._counts_of_all
    monkeypatch.setattr(ss, "_further", lambda table, net, n, *more: (seen.append((table.count(), dict(n))), further(table, net, n, *more))[1])
    monkeypatch.setattr(ss, "_counts_of_all", lambda *a: (counted.append(counts(*a)), counted[-1])[1])
    net = ss.train(every, steps=20, positives=40, sample=10)
    own = sorted(set(ss.labelled(texts)))
    assert seen == [(len(own), {0: sum(not r[3] for r in own), 1: sum(r[3] for r in own)})]
    label, step, n = counted[0]
    copies = 4  # 40 positives of 10 secrets
    aside = [r for r in own if ss._aside(r)]
    assert n[label == 0].sum() == 2 * sum(not r[3] for r in aside) and n[label == 1].sum() == (copies + 1) * sum(r[3] for r in aside) > 0
    again = ss.train(every.repartition(7), steps=20, positives=40, sample=10)
    assert all((a == b).all() for a, b in zip((net.embed, net.kernel, net.bias, net.out), (again.embed, again.kernel, again.bias, again.out)))
    assert (net.scale, net.threshold) == (again.scale, again.threshold)
    # a finding beyond the sample changes what is learnt
    other = ss.train(every.where("value <> 'plainwordnumber7'"), steps=20, positives=40, sample=10)
    assert (net.embed != other.embed).any()


def test_parts_of_findings_are_shown_once():
    table = [("l", f"value{i}longenough", "r", i % 2) for i in range(60)]
    both = ss._shown(table, 3, False)
    train, held = (ss._shown(table, 3, False, want=w)[w] for w in (False, True))
    assert [len(p[1]) for p in both] == [len(train[1]), len(held[1])] and len(held[1]) > 0
    assert len(ss._shown(table, 3, False, want=False, each=False)[0][1]) == sum(4 if r[3] else 1 for r in table if not ss._aside(r))
