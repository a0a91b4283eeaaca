"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import ann, byte_bpe, fingerprints, html_extract, jaccard_join, language_id, lexical_search, packing, pii, secret_scan, substring_dedup, toxicity, vector_codes
from inkmill.llm.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(read_table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    draw = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    model = language_id.train(docs.where(_fold(3) != 1).select("text", "lang", draw))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs, width=13, keep_text=False).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(_fold(5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN, keep_ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.findings(docs)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_html": op3_html,
    "op4_fingerprints": op4_fingerprints,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_multi_index": op8_multi_index,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t-\r]+'), lambda x: x <> '')"
ORACLE_SQL["op1_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::varchar[] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::bigint AS n_shingles, min(reach.b) AS component_id FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
ORACLE_SQL["op6_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS least FROM s),
gone AS (SELECT doc_id, list(DISTINCT k) AS k FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM h WHERE least < doc_id) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(w) AS n, list_filter(w, lambda x, i: k IS NULL OR NOT list_contains(k, i)) AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::bigint AS n_words, (n - len(kept))::bigint AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept"""

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op12_lexical_search"] = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
g AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM p, g GROUP BY t, n_docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint AS score
    FROM q JOIN w USING (t) JOIN p USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM r WHERE rank <= 20"""


def _lloyd_sql(rounds: int = 6) -> str:
    """A table of entries and one of assignments for each round."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // 8) + 1:(part + 1) * (len(x) // 8)] AS y FROM v, (SELECT unnest(range(8)) AS part))",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for r in range(rounds + 1):
        square = "list_sum(list_transform(range(1, len(p.y) + 1), lambda i: (p.y[i] - c.y[i]) * (p.y[i] - c.y[i])))::bigint"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(y) AS y, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d FROM (SELECT p.vec_id, p.part, p.y, c.entry, {square} AS d FROM p JOIN c{r} c USING (part)) GROUP BY vec_id, part)")
        if r < rounds:
            sums = f"SELECT part, entry, i, sum(x)::bigint AS s, count(*) AS n FROM (SELECT part, entry, unnest(y) AS x, unnest(range(len(y))) AS i FROM a{r}) GROUP BY part, entry, i"
            steps.append(f"m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM ({sums}) GROUP BY part, entry)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} m USING (part, entry))")
    steps.append(f"e AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a{rounds} GROUP BY vec_id)")
    books = f"(SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM c{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, {books} AS codebooks_sha256 FROM e JOIN v USING (vec_id)"


ORACLE_SQL["op13_vector_codes"] = _lloyd_sql()
