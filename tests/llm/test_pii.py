import hashlib
import re

from inkmill.llm import pii
from tests.llm.data import DOCS, documents, rows

TEXTS = [
    "mail bob.smith+x@ex-ample.co.uk now, a@b.c_d@e.f and x@y no",
    "ip 10.0.0.1 or 1.2.3.4.5.6.7.8 or 999.1.1.1 and 12345678901234567890.1.1.1 or 000000000255.1.2.3",
    "card 4111 1111 1111 1111, bad 4111 1111 1111 1112, 4111-1111-1111-1111 4, 41111111111111111111111",
    "call +1 (555) 010-9999 or +49-30-1234567. not +12 34 or +1234567890123456, +1 2 3 4 5 6 7 8",
    "iban DE89 3704 0044 0532 0130 00 is right, DE88 3704 0044 0532 0130 00 is not; GB82WEST12345698765432.",
    "naïve é😀 4111111111111111 bob@é.com é@b.co",
    "", None, "1 " * 30_000 + "x@" * 2000, "9" * 50_000 + "." * 50, "a.b-c" * 30_000,
    "4111 1111 1111 1111", "+1 (555) 010-9999", "a@b.c", "1.1.1.1", "1 1 4111111111111111",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    """The contract's patterns, as they are, with Python's engine (digit runs shortened where it is slow)."""
    text = text or ""
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))] if re.search(r"[0-9]\.[0-9]", text) else []
    found = [(m.span(), re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out["card"] = [s for s, d in found if 16 <= len(d) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def check(found, texts):
    for r, text in zip(sorted(found, key=lambda r: r["doc_id"]), texts):
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("iban"))
        assert base == joined, text[:200]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_spans_equal_brute_force(spark):
    found = rows(pii.find(documents(spark, TEXTS)))
    check(found, TEXTS)
    assert [x for x in found[4]["spans"].split(",") if x.startswith("iban")] == ["iban:5:32", "iban:79:101"]


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    check(rows(pii.find(docs)), texts)


def test_redact_keeps_rows_and_columns(spark):
    docs = documents(spark, TEXTS)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = [r["text"] for r in sorted(rows(out), key=lambda r: r["doc_id"])]
    assert got[11:15] == ["[CARD]", "[PHONE]", "[EMAIL]", "[IP]"]
    assert got[6:8] == ["", None] and got[10] == TEXTS[10]
    assert "DE88 3704" in got[4] and "DE89 3704" not in got[4]


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0


def test_redact_leaves_nothing_of_any_span(spark):
    """What is left of a text is what lies outside the union of its spans."""
    texts = [*TEXTS, "tel +33.1.42.68.53.00, again +33.1.42.68.53.00.", "+1.2.3.4@a.b 1.2.3.4@a.b", "x" * 9000 + " a@b.c " + "é😀" * 5000 + " 1.1.1.1 " + "y" * 4096, "a@b.c," * 3000]
    docs = documents(spark, texts)
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find(docs))}
    got = {r["doc_id"]: r["text"] for r in rows(pii.redact(docs))}
    for i, text in enumerate(texts):
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in found[i].split(",") if x)
        union = []
        for a, b in spans:
            if union and a < union[-1][1]:
                union[-1][1] = max(b, union[-1][1])
            else:
                union.append([a, b])
        kept, at = [], 0
        for a, b in union:
            kept.append((text or "")[at:a])
            at = b
        kept.append((text or "")[at:])
        assert re.split(r"\[(?:EMAIL|IBAN|CARD|IP|PHONE)\]", got[i] or "") == kept, (text or "")[:100]
    assert got[len(TEXTS)] == "tel [PHONE], again [PHONE]."


def test_iban_before_upper_case_words(spark):
    texts = {
        "DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX": ["0:27"],
        "GB82 WEST 1234 5698 7654 32 SWIFT": ["0:27"],
        "IBAN GB82WEST12345698765432 1234 OR DE89370400440532013000 BIC": ["5:27", "36:58"],
        "REF AB12 DE89 3704 0044 0532 0130 00 BIC IE12 GB82 WEST 1234 5698 7654 32": ["9:36", "46:73"],
        "NO93 8601 1117 947, MT84 MALT 0110 0001 2345 MTLC AST0 01S": ["0:18", "20:58"],
        "DE89 3704 0044 0532 0130 001 and DE89 3704 0044 0532 0130 0": [],
    }
    docs = documents(spark, list(texts))
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find(docs))}
    masked = {r["doc_id"]: r["text"] for r in rows(pii.redact(docs))}
    for i, want in enumerate(texts.values()):
        assert [x for x in found[i].split(",") if x.startswith("iban")] == [f"iban:{x}" for x in want]
        assert masked[i].count("[IBAN]") == len(want)
    assert masked[0] == "[IBAN] BIC: COBADEFFXXX"


def test_redact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.de", "x", "y", "z")], "doc_id long, text string, __email string, __spans string, __SPANS_ string")
    got = pii.redact(df).collect()[0]
    assert tuple(got) == (1, "mail [EMAIL]", "x", "y", "z")
