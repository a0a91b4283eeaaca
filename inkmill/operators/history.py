"""Versions of a table kept as a log of changes, and decisions that may be overridden and undone.

A log has the columns of its key, ``seq`` (a number; a key's changes differ in it), ``op`` (set or delete)
and fields; a set carries all fields.  The state at a version is each key's last change up to that seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.windows import following, running_last, running_min, running_total

#: Changes of one key within this many numbers of ``seq`` are ordered together; so a key with very many is many tasks.
SPAN = 1 << 16


def _fields(log: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in log.columns if c not in (*keys, "seq", "op")]


def as_of(log: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """(keys, fields) of the state at a version, or now: partial maxima, no order is made."""
    seen = log if version is None else log.where(F.col("seq") <= version)
    last = seen.groupBy(*keys).agg(F.max_by(F.struct("op", *_fields(log, keys)), "seq").alias("__last"))
    return last.where("__last.op = 'set'").select(*keys, *[F.col(f"__last.{c}").alias(c) for c in _fields(log, keys)])


def validity(log: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """Each set with ``valid_from`` (its seq) and ``valid_to`` (the seq of the key's next change, null if it is the last)."""
    rows = following(log.withColumn("__b", F.floor(F.col("seq") / span)), keys, "__b", "seq", "valid_to")
    return rows.where("op = 'set'").select(*keys, F.col("seq").alias("valid_from"), "valid_to", *_fields(log, keys))


def as_of_each(asked: DataFrame, log: DataFrame, keys: list[str], at: str = "at", span: int = SPAN) -> DataFrame:
    """As-of join: the rows of ``asked`` (keys, at, ...) with the fields that the key had then (a change at that
    very seq counts), null where it was not there.  Asked columns named like fields keep theirs."""
    fields = _fields(log, keys)
    kept = [c for c in asked.columns if c not in keys]
    changes = log.select(*keys, F.struct(F.col("seq").cast("long").alias("s"), F.lit(0).alias("asks")).alias("__o"), F.struct("op", *fields).alias("__v"), F.lit(None).cast(asked.select(F.struct(*kept)).schema[0].dataType).alias("__a"))
    none = F.lit(None).cast(changes.schema["__v"].dataType).alias("__v")
    asks = asked.select(*keys, F.struct(F.col(at).cast("long").alias("s"), F.lit(1).alias("asks")).alias("__o"), none, F.struct(*kept).alias("__a"))
    both = changes.unionByName(asks).withColumn("__b", F.floor(F.col("__o.s") / span))
    found = running_last(both, keys, "__b", "__o", "__v", "__found").where("__o.asks = 1")
    there = F.col("__found.op") == "set"
    return found.select(*keys, "__a.*", *[F.when(there, F.col(f"__found.{c}")).alias(c) for c in fields if c not in kept])


def compare(log: DataFrame, keys: list[str], before: int | None, after: int | None = None) -> DataFrame:
    """(keys, change, changed_fields): what was added, removed or changed between two versions."""
    fields = _fields(log, keys)
    sides = [as_of(log, keys, v).select(*[F.col(k).alias(f"{k}__{i}") for k in keys], F.struct(*fields).alias(f"__s{i}")) for i, v in enumerate((before, after))]
    both = sides[0].join(sides[1], [F.col(f"{k}__0") == F.col(f"{k}__1") for k in keys], "full_outer")
    change = F.when(F.col("__s0").isNull(), "added").when(F.col("__s1").isNull(), "removed").otherwise("changed")
    differ = F.filter(F.array(*[F.when(~F.col(f"__s0.{c}").eqNullSafe(F.col(f"__s1.{c}")), c) for c in fields]), lambda c: c.isNotNull())
    named = F.when(change == "changed", differ).otherwise(F.array().cast("array<string>"))
    out = both.select(*[F.coalesce(f"{k}__0", f"{k}__1").alias(k) for k in keys], change.alias("change"), named.alias("changed_fields"))
    return out.where("change <> 'changed' or size(changed_fields) > 0")


def rollback(log: DataFrame, keys: list[str], version: int, seq: int) -> DataFrame:
    """The changes, all of number ``seq``, that bring the state back to a version; history stays as it is.  Only
    keys whose state differs have one."""
    back = compare(log, keys, version).select(*keys, (F.col("change") == "added").alias("__gone"))
    old = back.join(as_of(log, keys, version), keys, "left")
    return old.select(*keys, F.lit(seq).cast(log.schema["seq"].dataType).alias("seq"), F.when(F.col("__gone"), "delete").otherwise("set").alias("op"), *_fields(log, keys))


def command_log(commands: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """``commands`` (keys, seq, undo, ...) with ``live`` and ``undone_by``: an undo cancels the last command of its
    key that is still live, further undos the ones before; with nothing left it does nothing.  Undos are never live;
    ``undone_by`` is the seq of the undo that cancelled a command.

    Commands raise a key's depth by one and undos lower it, to zero at least.  A command lies on the level that it
    raises the depth to, an undo on the one it takes away; on each level commands and undos alternate, so a
    command's undo is the next row of its level.  Depth is a running sum less its running minimum."""
    rows = commands.withColumns({"__step": F.when(F.col("undo"), -1).otherwise(1).cast("long"), "__b": F.floor(F.col("seq") / span)})
    rows = running_total(rows, keys, "__b", ["seq"], "__step", "__sum").withColumn("__prior", F.col("__sum") - F.col("__step"))
    rows = running_min(rows, keys, "__b", ["seq"], "__prior", "__least")
    rows = rows.withColumn("__depth", F.col("__prior") - F.col("__least")).withColumn("__level", F.when(~F.col("undo"), F.col("__depth") + 1).otherwise(F.col("__depth")))
    # undos of nothing are on level 0, where no command is
    rows = following(rows, [*keys, "__level"], "__b", "seq", "__next")
    out = rows.withColumns({"live": ~F.col("undo") & F.col("__next").isNull(), "undone_by": F.when(~F.col("undo"), F.col("__next"))})
    return out.select(*commands.columns, "live", "undone_by")


def overridden(decisions: DataFrame, commands: DataFrame, key: str = "decision_id", span: int = SPAN) -> DataFrame:
    """``decisions`` (key, action, ...) with the action of their last live command (key, seq, undo, action), if there is
    one, the action that was ``original_action``, and the numbers of commands that are live and undone."""
    told = command_log(commands, [key], span).where("not undo")
    last = told.groupBy(key).agg(F.max_by("action", F.when(F.col("live"), F.col("seq"))).alias("__new"), F.count_if("live").alias("__live"), F.count_if(~F.col("live")).alias("__undone"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = decisions.join(last, key, "left").withColumn("original_action", F.col("action"))
    return joined.withColumns({"action": F.coalesce("__new", "action"), "live_commands": zero(F.col("__live")), "undone_commands": zero(F.col("__undone"))}).drop("__new", "__live", "__undone")
