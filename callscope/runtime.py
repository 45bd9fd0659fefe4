"""Session-level helpers: where lineage is cut and how big a broadcast may be."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes (rows, where an operator's rows are short); beyond it operators shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64_000_000
#: Bytes of a row as broadcast, besides its columns.
ROW_BYTES = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="callscope-checkpoint-")
        sc.setCheckpointDir(current)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a narrow table, so that a lost executor costs no recomputation of what is above it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill(df: DataFrame) -> DataFrame:
    """Write a wide table as Parquet in the shared folder and read it back."""
    return spill_to(df)[0]


def spill_to(df: DataFrame) -> tuple[DataFrame, str]:
    """spill, and the folder, which `remove` deletes."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/callscope/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that spill_to wrote, on whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def row_bytes(df: DataFrame) -> int | None:
    """Bytes of a row of fixed-width columns; None if one has no fixed width."""
    widths = {"bigint": 8, "int": 8, "double": 8, "boolean": 8, "date": 8, "timestamp": 8, "float": 8, "smallint": 8, "tinyint": 8}
    found = [widths.get(t) for _, t in df.dtypes]
    return None if None in found else ROW_BYTES + sum(found)


def beside(df: DataFrame) -> DataFrame:
    """A checkpointed table as the small side of a join: broadcast if its counted rows (128 bytes each, where a hash or a name has no fixed width) stay below the bound, else as it is."""
    width = row_bytes(df)
    most = BROADCAST_BYTES // (width or 128)
    return F.broadcast(df) if df.count() <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
