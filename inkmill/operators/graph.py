"""Knowledge graphs as two tables: nodes (id, name, definition, category, textbook_id, frequency, seq)
and relations (source, target, relation_type, description, confidence, seq).  ``seq`` is list order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import node_id


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per (textbook_id, name): the first one's fields, the first longest definition, and the
    first one's frequency plus one for each other."""
    first = [c for c in nodes.columns if c not in ("textbook_id", "name", "definition", "frequency", "seq")]
    return nodes.groupBy("textbook_id", "name").agg(
        F.max_by("definition", F.struct(F.length("definition"), -F.col("seq"))).alias("definition"),
        (F.min_by("frequency", "seq") + F.count("*") - 1).alias("frequency"), F.min("seq").alias("seq"),
        *[F.min_by(c, "seq").alias(c) for c in first],
    )


def with_ids(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("id", node_id("textbook_id", "name"))


def merge_relations(relations: DataFrame) -> DataFrame:
    """The first relation of each (source, target, relation_type); equal seq: the least other fields."""
    rest = sorted(c for c in relations.columns if c not in ("source", "target", "relation_type", "seq"))
    return relations.groupBy("source", "target", "relation_type").agg(F.min(F.struct("seq", *rest)).alias("__first")).select("source", "target", "relation_type", "__first.*")


def valid_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return relations.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def page_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with an end among the nodes: two hash joins in place of one on an OR."""
    ids = nodes.select("id").distinct()
    by_source = relations.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    by_target = relations.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    return by_source.unionByName(by_target)


def page(nodes: DataFrame, number: int = 1, size: int = 100, category: str | None = None) -> DataFrame:
    """One page of nodes in list order, with the totals on each row."""
    if number < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= size <= 1000:
        raise ValueError("page size must be between 1 and 1000")
    kept = nodes.where(F.col("category") == category) if category else nodes
    total = kept.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return kept.orderBy("seq").offset((number - 1) * size).limit(size).join(F.broadcast(total))


def search(nodes: DataFrame, keyword: str) -> DataFrame:
    """Nodes whose name or definition holds the keyword, in any case."""
    k = F.lower(F.lit(keyword))
    return nodes.where(F.contains(F.lower("name"), k) | F.contains(F.lower("definition"), k))


def summary(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Totals by textbook; relations count for their source's textbook."""
    n = nodes.groupBy("textbook_id").agg(F.count("*").alias("total_nodes"))
    r = relations.join(nodes.select(F.col("id").alias("source"), "textbook_id"), "source").groupBy("textbook_id").agg(F.count("*").alias("total_relations"))
    return n.join(r, "textbook_id", "left").withColumn("total_relations", F.coalesce("total_relations", F.lit(0)))


def update(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the non-null values of ``updates`` (keys unique there) in matching rows; of several
    rows with a key only the first by seq is changed.  Columns that the table lacks are ignored."""
    changed = [c for c in updates.columns if c in table.columns and c not in keys]
    new = updates.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in changed])
    first = table.join(updates.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("seq").alias("__seq"))
    new = new.join(first.select(*[F.col(k).alias(f"__{k}") for k in keys], "__seq"), [f"__{k}" for k in keys])
    out = table.join(new, [table[k] == new[f"__{k}"] for k in keys] + [table["seq"] == new["__seq"]], "left")
    return out.select(*[F.coalesce(f"__{c}", table[c]).alias(c) if c in changed else table[c] for c in table.columns])


def characters(prefix: str = "") -> Column:
    return F.length(f"{prefix}name") + F.length(f"{prefix}definition")
