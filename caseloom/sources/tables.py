"""Parquet tables by name; Catalyst prunes columns and pushes filters into the scan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to all cores where its scan has too few splits to keep them busy, as with one small file;
    a scan with enough of them stays as it is, so nothing large is ever shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores, key)


#: Rows of a part in ``dealt``.
PART_ROWS = 250_000


def parts(df: DataFrame, rows: int | None = None) -> int:
    """How many parts give each about ``PART_ROWS`` of the ``rows`` of ``df`` (counted if not given); no fewer than the
    session's number."""
    return max(-(-(df.count() if rows is None else rows) // PART_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``key``, in so many parts that each has about ``PART_ROWS`` of its ``rows`` (counted if not given)
    where the session's number of parts would make them larger: what a task sorts, groups or collects of a key's rows then
    stays the same however large the table is, and later steps by ``key`` need no other shuffle."""
    parts = -(-(df.count() if rows is None else rows) // PART_ROWS)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work on their whole texts: on all cores also where they are one small file."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names for driver and executors; a temporary one stands in only where
    Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that what follows does not work it out again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
