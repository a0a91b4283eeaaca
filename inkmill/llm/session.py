"""What the operators need from the Spark session: shared storage and batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only a session without executors of its own (tests, a
    notebook) may leave it unset: there a temporary folder serves; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="inkmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there, and a
    lost executor costs only the tasks that it ran.  ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/inkmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what an Arrow batch holds: rows of text can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
