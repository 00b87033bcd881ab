"""Readers for what cases arrive in: JSON lines, ZIP bundles, texts with page breaks; and an idempotent sink."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A member of a bundle is given in parts of so many bytes.
PART_BYTES = 64_000_000


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a fixed schema; a line that does not fit keeps its text in ``_corrupt`` and is not dropped."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def bundle_members(spark: SparkSession, path: str, most: int = PART_BYTES) -> DataFrame:
    """``path, member, part, n_bytes, content, status`` of every file in every ZIP bundle, unpacked as a stream.

    A member comes in parts of at most ``most`` bytes, numbered from 0; an empty one is one part. ``n_bytes`` is the
    size that the bundle states. A bundle that is no ZIP is one row with status BROKEN; a member whose content does
    not fit its checksum ends with a part DAMAGED without content, one that needs a password is ENCRYPTED, one packed
    by a method unknown here UNSUPPORTED; a name that would leave the bundle's folder is UNSAFE; these have no content.
    Bundles are opened where they lie and never read whole.
    """
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    names = ["path", "member", "part", "n_bytes", "content", "status"]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def parts(name: str, bundle: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[pa.RecordBatch]:
        number = 0
        try:
            with bundle.open(info) as member:
                while (content := member.read(most)) or not number:
                    yield row(name, info.filename, number, info.file_size, content, "OK")
                    number += 1
        except (zipfile.BadZipFile, zlib.error, EOFError):
            yield row(name, info.filename, number, info.file_size, None, "DAMAGED")
        except NotImplementedError:
            yield row(name, info.filename, number, info.file_size, None, "UNSUPPORTED")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(name) as source:
                    try:
                        bundle = zipfile.ZipFile(source)
                    except (zipfile.BadZipFile, ValueError):  # the latter where a file is too short to look for its end
                        yield row(name, None, 0, size, None, "BROKEN")
                        continue
                    for info in bundle.infolist():
                        if info.is_dir():
                            continue
                        if info.filename.startswith("/") or ".." in info.filename.split("/"):
                            yield row(name, info.filename, 0, info.file_size, None, "UNSAFE")
                        elif info.flag_bits & 1:
                            yield row(name, info.filename, 0, info.file_size, None, "ENCRYPTED")
                        else:
                            yield from parts(name, bundle, info)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names and sizes, no content
    return files.mapInArrow(unpacked, "path string, member string, part bigint, n_bytes bigint, content binary, status string")


def opened(path: str) -> pa.NativeFile:
    """A random-access handle of a file on any file system that both Spark and Arrow know."""
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def pages_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, page, content, content_id``: a text cut at its form feeds, pages numbered from 1; null has none."""
    cut = texts.select(key, F.posexplode(F.split(text, "\f")).alias("_at", "content"))
    return cut.select(key, (F.col("_at") + 1).alias("page"), "content", F.sha2("content", 256).alias("content_id"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that the partitions it holds are replaced and all others stay: a repeat changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; columns that are null are written as such, so that a reader finds every field."""
    df.write.option("ignoreNullFields", "false").json(path)


def store_objects(objects: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Add contents to a store where each is known by its SHA-256 and is never written twice or replaced.

    ``sha, content`` in Parquet under ``path``, a folder for each first two digits. Contents that the store has, and
    repeats among the new ones, are passed over; null is none. What was added is read back, and an error is raised if a
    name does not fit its content. Returns ``sha, n_bytes`` of the contents given, each once.
    """
    spark = objects.sparkSession
    own = objects.filter(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha"), F.col(content).cast("binary").alias("content"))
    new = own.dropDuplicates(["sha"])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
    new.withColumn("head", F.left("sha", F.lit(2))).write.mode("append").partitionBy("head").parquet(path)
    held = spark.read.parquet(path).join(own.select("sha").distinct(), "sha", "left_semi")
    if not held.filter(F.sha2("content", 256) != F.col("sha")).isEmpty():
        raise ValueError(f"a content in {path} does not fit its name")
    return held.select("sha", F.octet_length("content").cast("bigint").alias("n_bytes"))
