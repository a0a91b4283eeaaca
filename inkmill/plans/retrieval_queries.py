"""Queries on keyword retrieval, fusion and evaluation: benchmark items ask, documents are the chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.operators import embed, index, retrieval, vector
from inkmill.plans.tables import read
from inkmill.sources import scratch

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _chunks(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _bm25(spark, d, k=10):
    chunks, asked = _chunks(spark, d), _questions(spark, d)
    return retrieval.bm25(retrieval.postings(chunks, retrieval.terms_asked(asked)), retrieval.collection(chunks), asked, k)


def _vectors(spark, d, k=10):
    """The nearest chunks by TF-IDF cosine."""
    chunks = _chunks(spark, d)
    vocabulary = embed.tfidf_fit(chunks)
    asked = embed.tfidf_sparse(_questions(spark, d).select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), vocabulary)
    hits = vector.top_k_batch(embed.tfidf_sparse(chunks, vocabulary), asked, k, skip_self=False, places=9)
    return hits.withColumnsRenamed({"query_id": "question_id", "similarity": "score"})


_BM25 = r"""
b_tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS u FROM documents),
b_size AS (SELECT count(*) AS n_texts, avg(len(u)) AS mean_words FROM b_tok WHERE len(u) > 0),
b_q AS (SELECT question_id, term, count(*) AS times FROM (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark) GROUP BY ALL),
b_p AS (SELECT id, term, n, count(*) AS tf FROM (SELECT id, len(u) AS n, unnest(u) AS term FROM b_tok) WHERE term IN (SELECT term FROM b_q) GROUP BY ALL),
b_idf AS (SELECT term, ln(1 + (n_texts - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM b_p, b_size GROUP BY term, n_texts),
b_s AS (SELECT question_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_words))), 9) AS score FROM b_q JOIN b_idf USING (term) JOIN b_p USING (term), b_size GROUP BY question_id, id),
bm25 AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score FROM b_s QUALIFY rank <= 10)"""
_TFIDF = r"""
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS u FROM documents),
terms AS (SELECT id, unnest(u) AS term FROM tok UNION ALL SELECT id, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) FROM tok),
tf AS (SELECT id, term, count(*) AS n FROM terms GROUP BY id, term),
vocab AS (SELECT term, sum(n)::bigint AS tf, count(*) AS df FROM tf GROUP BY term ORDER BY 2 DESC, 1 LIMIT 384),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM vocab),
w AS (SELECT id, term, (1 + ln(n)) * idf AS w FROM tf JOIN idf USING (term)),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w),
q_tok AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS u FROM benchmark),
q_terms AS (SELECT id, unnest(u) AS term FROM q_tok UNION ALL SELECT id, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) FROM q_tok),
q_w AS (SELECT id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM q_terms JOIN idf USING (term) GROUP BY id, term),
q_weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM q_w),
v_s AS (SELECT b.item_id AS question_id, d.doc_id AS id, round(coalesce(s, 0), 9) AS score FROM benchmark b CROSS JOIN documents d
    LEFT JOIN (SELECT q.id AS question_id, w.id, sum(q.weight * w.weight) AS s FROM q_weights q JOIN weights w USING (term) GROUP BY ALL) x ON x.question_id = b.item_id AND x.id = d.doc_id),
vectors AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score FROM v_s QUALIFY rank <= 10)"""
_FUSED = """
parts AS (SELECT question_id, id, 1.0::double / (60 + rank) AS part FROM bm25 UNION ALL SELECT question_id, id, 1.0::double / (60 + rank) FROM vectors),
f_s AS (SELECT question_id, id, round(sum(part), 9) AS score FROM parts GROUP BY question_id, id),
fused AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score FROM f_s QUALIFY rank <= 10)"""


def _out(df):
    return df.select("question_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT question_id, rank, id, round(score, 6) AS score FROM bm25")
def bm25_topk(spark, d):
    return _out(_bm25(spark, d))


@query(f"WITH {_BM25}, {_TFIDF}, {_FUSED} SELECT question_id, rank, id, round(score, 6) AS score FROM fused")
def hybrid_topk(spark, d):
    return _out(retrieval.fuse([_bm25(spark, d), _vectors(spark, d)], 10))


_OPENING = r"array_join(slice(filter(split({0}, '[ \\t-\\r]+'), w -> w <> ''), 1, 8), ' ')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t-\r]+'), lambda w: w <> '')"


def _judged(spark, d):
    """A chunk is relevant to an item, with gain 2, if it holds the item's first eight words in a row."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.expr(_OPENING.format("text")).alias("opening")).where("opening <> ''")
    openings = items.select("opening").distinct().limit(retrieval.SMALL + 1).collect()
    if len(openings) <= retrieval.SMALL:
        windows = retrieval.holding(_chunks(spark, d), sorted(r["opening"] for r in openings), 8, r"[ \t-\r]+").withColumnRenamed("run", "opening")
    else:
        words = _chunks(spark, d).select("id", F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')").alias("w"))
        windows = words.select("id", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(size(w) - 7, 1)), i -> array_join(slice(w, i, 8), ' ')))")).alias("opening"))
    return windows.join(items, "opening").select("question_id", "id", F.lit(2).alias("gain"))


@query(f"""WITH {_BM25}, {_TFIDF}, {_FUSED},
o AS (SELECT item_id AS question_id, array_to_string(w[1:8], ' ') AS opening FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS opening FROM (SELECT doc_id AS id, {_WORDS.format('text')} AS w FROM documents)),
judged AS (SELECT DISTINCT question_id, id FROM win JOIN o USING (opening)),
ranked AS (SELECT 'bm25' AS config, question_id, rank, id FROM bm25 UNION ALL SELECT 'fused', question_id, rank, id FROM fused UNION ALL SELECT 'vectors', question_id, rank, id FROM vectors),
ideal AS (SELECT question_id, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 3.0::double / log2(i + 1))) AS ideal FROM (SELECT question_id, count(*) AS n FROM judged GROUP BY question_id)),
hit AS (SELECT config, question_id, count(*) AS found, min(rank) AS first, sum(3.0::double / log2(rank + 1)) AS gained FROM ranked JOIN judged USING (question_id, id) GROUP BY config, question_id)
SELECT config, count(*) AS questions, round(avg(coalesce(found / n, 0)), 6) AS recall, round(avg(coalesce(1.0::double / first, 0)), 6) AS mrr, round(avg(coalesce(gained / ideal, 0)), 6) AS ndcg
FROM (SELECT DISTINCT config FROM ranked) CROSS JOIN ideal LEFT JOIN hit USING (config, question_id) GROUP BY config""")
def retrieval_quality(spark, d):
    """The three ways of retrieval compared on the benchmark."""
    keyword, near = scratch.settled(_bm25(spark, d)), scratch.settled(_vectors(spark, d))  # several lists read them
    lists = {"bm25": keyword, "vectors": near, "fused": retrieval.fuse([keyword, near], 10)}
    ranked = None
    for name, found in lists.items():
        own = found.select(F.lit(name).alias("config"), "question_id", "rank", "id")
        ranked = own if ranked is None else ranked.unionByName(own)
    found = retrieval.evaluate(ranked, _judged(spark, d), 10)
    return found.select("config", "questions", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


# --- an index after three updates: documents are chunks of the books that their sources are


def _editions(spark, d):
    """The chunks as they are before each update: at the second, toxic ones begin otherwise and those of low quality
    gone; at the third, half of these are back, and German ones end otherwise."""
    docs = read(spark, d, "documents").select(F.col("source").alias("textbook_id"), F.col("doc_id").alias("chunk_id"), "lang", F.col("text").alias("content"))
    both = docs.join(read(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality", "toxic"), "chunk_id", "left")
    second = both.withColumn("content", F.expr("if(toxic = 1, concat('!', content), content)"))
    third = second.withColumn("content", F.expr("if(lang = 'de', concat(content, '.'), content)"))
    return docs, second.where("quality is null or quality = 1"), third.where("quality is null or quality = 1 or chunk_id % 2 = 0")


def _updated(spark, d):
    log = spark.createDataFrame([], "textbook_id string, chunk_id long, key string, version long, live boolean")
    books = read(spark, d, "documents").select(F.col("source").alias("textbook_id"))
    for version, chunks in enumerate(_editions(spark, d), 1):
        log = scratch.settled(log.unionByName(index.changes(log, index.keyed(chunks).select("textbook_id", "chunk_id", "key"), books, version)))
    return log


_EDITIONS = """e AS (SELECT source AS textbook_id, doc_id AS chunk_id, text AS c1, CASE WHEN toxic = 1 THEN '!' || text ELSE text END AS c2, CASE WHEN lang = 'de' THEN '.' ELSE '' END AS tail, quality IS NULL OR quality = 1 AS good, doc_id % 2 = 0 AS even
    FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT textbook_id, chunk_id, md5(c1) AS k1, CASE WHEN good THEN md5(c2) END AS k2, CASE WHEN good OR even THEN md5(c2 || tail) END AS k3 FROM e)"""


@query(f"WITH {_EDITIONS} SELECT textbook_id, chunk_id, k3 AS key, CASE WHEN k3 IS DISTINCT FROM k2 THEN 3 WHEN k2 <> k1 THEN 2 ELSE 1 END::bigint AS version FROM k WHERE k3 IS NOT NULL")
def index_three_updates(spark, d):
    """The index after three updates is what a rebuild would be, each chunk with the update that wrote it."""
    return index.live(_updated(spark, d)).select("textbook_id", "chunk_id", "key", "version")


@query(f"""WITH {_EDITIONS}, n AS (SELECT 1 AS version, count(k1) AS written, 0 AS removed FROM k
    UNION ALL SELECT 2, count(*) FILTER (k2 <> k1), count(*) FILTER (k2 IS NULL) FROM k UNION ALL SELECT 3, count(*) FILTER (k3 IS NOT NULL AND k3 IS DISTINCT FROM k2), count(*) FILTER (k3 IS NULL AND k2 IS NOT NULL) FROM k)
SELECT version::bigint AS version, written::bigint AS written, removed::bigint AS removed FROM n WHERE written + removed > 0""")
def index_update_sizes(spark, d):
    """What each update wrote: only chunks that changed."""
    return _updated(spark, d).groupBy("version").agg(F.count_if("live").alias("written"), F.count_if(~F.col("live")).alias("removed"))
