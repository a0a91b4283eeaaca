"""How the supplied tables play the parts of books, graphs and logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as knowledge points: the brand is the book, names recur within it."""
    return read(spark, d, "part").select(
        F.col("p_brand").alias("textbook_id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("definition"),
        F.col("p_type").alias("category"), F.lit(1).cast("long").alias("frequency"), F.col("p_partkey").alias("seq"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_ids(graph.merge_nodes(raw_nodes(spark, d)))


def raw_relations(spark: SparkSession, d: str) -> DataFrame:
    """Parts of neighbouring lines of an order as related knowledge points."""
    ids = graph.with_ids(raw_nodes(spark, d)).select("id", F.col("seq").alias("part"))
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount")
    following = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("other"))
    pairs = line.join(following, ["l_orderkey", "l_linenumber"])
    return (
        pairs.join(ids.select(F.col("part").alias("l_partkey"), F.col("id").alias("source")), "l_partkey")
        .join(ids.select(F.col("part").alias("other"), F.col("id").alias("target")), "other")
        .select("source", "target", F.col("l_returnflag").alias("relation_type"), F.lit("").alias("description"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"))
    )


def relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_relations(raw_relations(spark, d))


#: The same in SQL, as common table expressions.
NODES_SQL = """
raw_nodes AS (SELECT p_brand AS textbook_id, p_name AS name, p_type || ' ' || p_size AS definition, p_type AS category, p_partkey AS seq,
    'node_' || substr(md5(p_brand || ':' || p_name), 1, 8) AS id FROM part),
nodes AS (SELECT id, textbook_id, name, first(definition ORDER BY length(definition) DESC, seq) AS definition, count(*) AS frequency,
    min(seq) AS seq, first(category ORDER BY seq) AS category FROM raw_nodes GROUP BY id, textbook_id, name)"""
RELATIONS_SQL = """
raw_relations AS (SELECT s.id AS source, t.id AS target, a.l_returnflag AS relation_type, '' AS description, a.l_discount AS confidence,
    a.l_orderkey * 16 + a.l_linenumber AS seq
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    JOIN raw_nodes s ON s.seq = a.l_partkey JOIN raw_nodes t ON t.seq = b.l_partkey),
relations AS (SELECT source, target, relation_type, min(seq) AS seq, first(description ORDER BY seq, confidence) AS description,
    first(confidence ORDER BY seq, confidence) AS confidence FROM raw_relations GROUP BY ALL)"""
RELATIONS_SQL = RELATIONS_SQL.replace("GROUP BY ALL", "GROUP BY source, target, relation_type")


def chapters_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document is a chapter, its source the book."""
    return read(spark, d, "documents").select(
        F.col("source").alias("textbook_id"), F.col("source").alias("textbook_title"), F.col("doc_id").cast("string").alias("chapter_id"),
        F.col("lang").alias("title"), F.lit(0).alias("page_start"), F.col("text").alias("content"),
    )
