"""Intermediate results in the folder that all executors share, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only a session without executors of its own (tests, a notebook)
    may leave it unset: there a temporary folder serves; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="inkmill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as a checkpoint: what reads it several times does not compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Writers of rows that may be large look at what they hold after each row, not after a hundred, and keep no dictionary of values.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, of which readers take the columns that they need.  For
    rows that may be large: writing a checkpoint holds up to a hundred of them.  ``discard`` deletes it."""
    path = f"{shared_folder(df.sparkSession)}/inkmill-{uuid.uuid4().hex}"
    df.write.options(**LARGE_ROWS).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.written_at = path
    return read


def discard(table: DataFrame) -> None:
    """Delete what ``written`` wrote; nothing may read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
