"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session names it in ``spark.checkpoint.dir``; a temporary folder stands in only where that is
    unset and Spark runs in one process, which is the case in tests. On a cluster there is no such folder,
    so an unset name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    here = spark.sparkContext.getCheckpointDir()
    if here is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        here = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(here)
    return here.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.scratch_path = path
    return held


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``written`` once everything that reads them has itself been written."""
    for held in tables:
        session = held.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(held.scratch_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def joined_hot(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``few``, which has one row for each ``key``, when some keys may hold a large
    share of ``rows``: the rows of the keys in ``hot`` meet theirs by broadcast and are not shuffled, all others
    by a shuffle. ``hot`` must be short; see ``hot_keys``."""
    hot = F.broadcast(hot)
    return rows.join(F.broadcast(few.join(hot, key, "left_semi")), key).unionByName(rows.join(hot, key, "left_anti").join(few, key))


#: A key is hot if it has more than one in so many of all rows, so there are no more hot keys than that.
HOT_SHARE, HOT_ROWS = 10_000, 1000


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The keys of ``counts`` (key, number of rows) with more than ``HOT_ROWS`` rows and more than one row in
    ``HOT_SHARE``: at most ``HOT_SHARE`` of them, whatever the size of the input."""
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    return counts.filter(F.col(n) > max(HOT_ROWS, total // HOT_SHARE)).select(key)


def text_key():
    """Tells texts apart where one id came with several: 64 bits of hash of the text."""
    return F.xxhash64("text")
