"""Session-level helpers: lineage cuts and size checks."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Upper bound of rows that one hash map or one window partition may hold.
ROWS_PER_TASK = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may go without that setting; it gets a temporary folder. Elsewhere
    that would scatter the rows over the machines, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


# Folders of the tables that ``materialize`` has written and nobody has dropped, oldest first.
_TABLES: list[str] = []


def stored_tables() -> list[str]:
    return list(_TABLES)


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete stored tables (all of them by default); frames that read them must not be used any more."""
    for path in stored_tables() if paths is None else paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _TABLES:
            _TABLES.remove(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the table to the shared folder once and read it back.

    The rows survive the loss of executors, and the planner knows the size of the stored table, so
    it broadcasts it by itself only while it is small.
    """
    path = f"{shared_folder(df.sparkSession)}/cellwire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` into all shuffle partitions, also where they are few.

    For rows that become many after their exchange: its size says nothing of the work behind it, and the
    planner would join small parts into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def exceeds(df: DataFrame, column: str, limit: int) -> bool:
    """Whether any row has ``column`` above ``limit``; one small job, one boolean to the driver."""
    return not df.where(df[column] > limit).isEmpty()


def guard_rows(df: DataFrame, limit: int | None, what: str) -> DataFrame:
    """Optional guard of the reference API: stop when a result is larger than allowed."""
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} exceeds the limit of {limit} rows")
    return df
