"""Queries on versions and overrides: parts and order lines as a log of changes, events as commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.operators import history
from inkmill.plans.tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark, d):
    """Every part is set at first; its order lines change it, and returned ones delete it."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("set").alias("op"), F.col("p_type").alias("definition"), F.col("p_size").cast("long").alias("frequency"), F.col("p_brand").alias("category"))
    lines = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.expr("if(l_returnflag = 'R', 'delete', 'set')").alias("op"), F.concat("l_returnflag", "l_linestatus").alias("definition"), F.col("l_quantity").cast("long").alias("frequency"), (F.col("l_suppkey") % 3).cast("string").alias("category"))
    # lines of one number and part are one change
    return parts.unionByName(lines.groupBy("id", "seq").agg(F.min(F.struct("op", "definition", "frequency", "category")).alias("c")).select("id", "seq", "c.*"))


def _version(spark, d, share):
    return int(read(spark, d, "lineitem").agg(F.max(F.col("l_orderkey") * 16)).first()[0] * share)


_LOG = """log AS (SELECT p_partkey AS id, 0::bigint AS seq, 'set' AS op, p_type AS definition, p_size::bigint AS frequency, p_brand AS category FROM part
    UNION ALL SELECT id, seq, c.op, c.definition, c.frequency, c.category FROM (SELECT l_partkey AS id, l_orderkey * 16 + l_linenumber AS seq,
        min({'op': CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'set' END, 'definition': l_returnflag || l_linestatus, 'frequency': l_quantity::bigint, 'category': (l_suppkey % 3)::varchar}) AS c FROM lineitem GROUP BY ALL)),
v AS (SELECT floor(max(l_orderkey) * 16 * 0.25)::bigint AS one, floor(max(l_orderkey) * 16 * 0.5)::bigint AS two FROM lineitem)"""


def _at(name, where):
    return f"{name} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM log, v WHERE {where}) WHERE r = 1 AND op = 'set')"


@query(f"WITH {_LOG}, {_at('s', 'seq <= two')} SELECT id, definition, frequency, category FROM s")
def graph_as_of(spark, d):
    return history.as_of(_log(spark, d), ["id"], _version(spark, d, 0.5))


@query(f"WITH {_LOG} SELECT id, seq AS valid_from, valid_to, definition FROM (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS valid_to FROM log) WHERE op = 'set'")
def graph_validity(spark, d):
    return history.validity(_log(spark, d), ["id"]).select("id", "valid_from", "valid_to", "definition")


_COMPARED = """c AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE array_to_string(list_filter(['definition', 'frequency', 'category'], lambda x, i: [a.definition IS DISTINCT FROM b.definition, a.frequency IS DISTINCT FROM b.frequency, a.category IS DISTINCT FROM b.category][i]), ',') END AS changed_fields
    FROM a FULL JOIN b ON a.id = b.id)"""


@query(f"WITH {_LOG}, {_at('a', 'seq <= one')}, {_at('b', 'seq <= two')}, {_COMPARED} SELECT * FROM c WHERE change <> 'changed' OR changed_fields <> ''")
def graph_compare(spark, d):
    log = _log(spark, d)
    return history.compare(log, ["id"], _version(spark, d, 0.25), _version(spark, d, 0.5)).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(f"WITH {_LOG}, {_at('a', 'seq <= one')}, {_at('b', 'true')}, {_COMPARED} SELECT c.id, 999999999::bigint AS seq, CASE WHEN change = 'added' THEN 'delete' ELSE 'set' END AS op, a.definition, a.frequency, a.category FROM c LEFT JOIN a ON a.id = c.id WHERE change <> 'changed' OR changed_fields <> ''")
def graph_rollback(spark, d):
    return history.rollback(_log(spark, d), ["id"], _version(spark, d, 0.25), 999_999_999)


@query(f"""WITH {_LOG} SELECT event_id, user_id AS id, event_id AS at, CASE WHEN op = 'set' THEN definition END AS definition, CASE WHEN op = 'set' THEN frequency END AS frequency
FROM events ASOF LEFT JOIN log ON events.user_id = log.id AND events.event_id >= log.seq""")
def graph_as_of_events(spark, d):
    """The state of the part of each event's user number when the event came."""
    asked = read(spark, d, "events").select("event_id", F.col("user_id").alias("id"), F.col("event_id").alias("at"))
    return history.as_of_each(asked, _log(spark, d), ["id"]).select("event_id", "id", "at", "definition", "frequency")


def _commands(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("decision_id"), F.col("event_id").alias("seq"), F.col("event_type").isin("view", "error").alias("undo"), F.col("event_type").alias("action"))


_STACKS = """e AS (SELECT user_id, event_id, event_type, event_type IN ('view', 'error') AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, 0::bigint AS n, []::bigint[] AS stack, NULL::bigint AS popped, NULL::bigint AS event_id FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT r.user_id, e.n, CASE WHEN undo THEN stack[1:len(stack) - 1] ELSE list_append(stack, e.event_id) END, CASE WHEN undo AND len(stack) > 0 THEN stack[len(stack)] END, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1),
l AS (SELECT e.*, NOT undo AND u.event_id IS NULL AS live, u.event_id AS undone_by FROM e LEFT JOIN (SELECT popped, event_id FROM r WHERE popped IS NOT NULL) u ON u.popped = e.event_id)"""


@query(f"WITH RECURSIVE {_STACKS} SELECT user_id AS decision_id, event_id AS seq, undo, live, undone_by FROM l")
def command_log(spark, d):
    return history.command_log(_commands(spark, d), ["decision_id"]).select("decision_id", "seq", "undo", "live", "undone_by")


@query(f"""WITH RECURSIVE {_STACKS} SELECT c_custkey AS decision_id, coalesce(arg_max(event_type, event_id) FILTER (live), 'merge') AS action, 'merge' AS original_action,
count(*) FILTER (live) AS live_commands, count(*) FILTER (NOT live AND NOT undo) AS undone_commands FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY c_custkey""")
def decision_overrides(spark, d):
    """Customers as decisions, events of their number as commands: views and errors undo."""
    decisions = read(spark, d, "customer").select(F.col("c_custkey").alias("decision_id"), F.lit("merge").alias("action"))
    return history.overridden(decisions, _commands(spark, d)).select("decision_id", "action", "original_action", "live_commands", "undone_commands")
