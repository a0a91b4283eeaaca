"""Prompts become text a few at a time, and what goes with them stays as it is."""

from pyspark.sql import functions as F

from inkmill.functions import hooks


def test_prompts_a_few_at_a_time(spark):
    big = (1 << 53) + 1
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id") + big).alias("n"), F.when(F.col("id") > 0, F.concat(F.lit("p"), "id")).alias("prompt"), F.array(F.lit(1.5)).alias("x")).coalesce(1)
    seen = hooks.answers(df, lambda prompts: [p if p is None else p.upper() for p in prompts]).collect()
    assert sorted(r["n"] for r in seen if r["n"] is not None) == [big + i for i in range(0, 1000, 2)]  # a long beside nulls stays a long
    assert all(r["answer"] == (r["prompt"] and r["prompt"].upper()) and r["error"] is None and r["x"] == [1.5] for r in seen)
    sizes = hooks.answers(df, lambda prompts: prompts).mapInArrow(_sizes, "n int").collect()
    assert len(seen) == 1000 and sum(r["n"] for r in sizes) == 1000


def _sizes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32())})
