"""Queries on embeddings and retrieval: norms, similar pairs, nearest vectors, context, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmill.functions import vectors as V
from inkmill.operators import dialogue, embed, integrate, vector
from inkmill.plans.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("book"), F.col("embedding").cast("array<double>").alias("vector"))


@query("SELECT vec_id AS id, i - 1 AS pos, round(e[i]::double / sqrt(list_dot_product(e::double[], e::double[])), 6) AS x FROM (SELECT vec_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def l2_normalize(spark, d):
    return _vectors(spark, d).select("id", F.posexplode(V.normalise("vector")).alias("pos", "x")).select("id", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


_SIMILAR = "s AS (SELECT a.vec_id AS id1, b.vec_id AS id2, a.label AS book1, b.label AS book2, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS similarity FROM embeddings a JOIN embeddings b ON a.label < b.label)"


@query(f"WITH {_SIMILAR} SELECT id1, id2, book1, book2, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3")
def cosine_pairs(spark, d):
    return vector.similar_pairs(_vectors(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SIMILAR} SELECT vec_id::varchar AS id, label AS book FROM embeddings WHERE vec_id NOT IN (SELECT id2 FROM s WHERE similarity >= 0.3 AND (round(similarity, 6) >= 0.9 OR round(similarity, 6) < 0.7))")
def apply_removals(spark, d):
    """Pairs below the band of what is kept: the second of each is removed."""
    own = _vectors(spark, d).select(F.col("id").cast("string").alias("id"), "book", F.col("book").cast("string").alias("definition"))
    items = _vectors(spark, d).withColumn("len", F.length(F.col("book").cast("string")))
    pairs = vector.similar_pairs(items, 0.3).select(F.col("id1").cast("string").alias("node1_id"), F.col("id2").cast("string").alias("node2_id"), F.round("similarity", 6).alias("confidence"), "len1", "len2")
    return integrate.apply_decisions(own, integrate.decide(pairs, own)).select("id", "book")


_QUERY_SQL = "(SELECT embedding::double[] FROM embeddings WHERE vec_id = 7)"
_TOP = f"t AS (SELECT vec_id AS id, list_cosine_similarity(embedding::double[], {_QUERY_SQL}) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 5)"


def _top(spark, d):
    q = read(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").cast("array<double>").alias("q")).first()["q"]
    return vector.top_k(_vectors(spark, d), q, 5)


@query(f"WITH {_TOP} SELECT id, round(similarity, 6) AS similarity FROM t")
def vector_topk(spark, d):
    return _top(spark, d).select("id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::double[], v.embedding::double[]) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def vector_topk_batch(spark, d):
    v = _vectors(spark, d)
    found = vector.top_k_batch(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 5)
    return found.select("query_id", F.col("rank").cast("long"), "id", F.round("similarity", 6).alias("similarity"))


def _hits(spark, d):
    """The five nearest vectors, joined with the documents of the same number as their chunks."""
    ranked = _top(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("textbook_title"), F.col("lang").alias("chapter_title"), F.lit(0).alias("page_start"), F.col("text").alias("content"))
    return docs.join(F.broadcast(ranked), "id")


@query(f"WITH {_TOP} SELECT string_agg('[来源: ' || source || ', ' || lang || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY similarity DESC, id) AS context FROM t JOIN documents ON doc_id = id")
def rag_context(spark, d):
    return _hits(spark, d).agg(dialogue.rag_context().alias("context"))


@query(f"WITH {_TOP} SELECT doc_id::varchar AS chunk_id, source AS textbook, lang AS chapter, 0 AS page, left(text, 200) AS content, round(similarity, 6) AS relevance_score FROM t JOIN documents ON doc_id = id")
def citations(spark, d):
    return dialogue.citations(_hits(spark, d)).withColumn("relevance_score", F.round("relevance_score", 6))


@query("SELECT doc_id, md5(text) AS key FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def encode_cache_misses(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    cache = docs.join(read(spark, d, "labels").select("doc_id"), "doc_id").select(F.lit("tfidf").alias("model"), F.md5(F.col("text").cast("binary")).alias("key"))
    return embed.cache_misses(docs, cache).select("doc_id", "key")
