"""A stored table with real merges: snapshot folders of Parquet and a manifest that is written last.

``path/data/<run>/rows/bucket=<b>`` holds rows, ``path/manifests/<version>`` says which folder each bucket is read from,
what the run did and the marks that move with it. A run writes all buckets into a folder of its own, keeps those that it
changes, and then writes the manifest, which nobody may overwrite; a run that is cut short leaves folders that no manifest
names, and the table is as before. A run that changes nothing leaves nothing. Two runs that write one version at a time are told apart
by the file system: the later one fails and is repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from caseloom.sources.tables import PART_ROWS

CREATED, UPDATED = "created_version", "updated_version"
WRITTEN = ("INSERT", "UPDATE", "PRUNE")
#: What the run that wrote a row did to it; rows that it took out stay in its folder and are not read.
_DONE = "_action"


class Conflict(RuntimeError):
    """Another run wrote the version that this one was about to write."""


class StoredTable:
    """Rows by ``key``, each with a ``digest`` of what it says; ``buckets`` of keys are rewritten as a whole. Rows are dealt by
    ``by``, the key or a column that follows from it, so that rows which are looked at together stay together."""

    def __init__(self, spark: SparkSession, path: str, key: str, digest: str = "digest", buckets: int = 16, by: str | None = None):
        self.spark, self.path, self.key, self.digest, self.buckets, self.by = spark, path.rstrip("/"), key, digest, buckets, by or key
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        place = self._hadoop.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        place, system = self._at("manifests")
        return sorted(int(f.getPath().getName()) for f in system.listStatus(place)) if system.exists(place) else []

    def _manifest(self, number: int) -> dict | None:
        place, system = self._at(f"manifests/{number:012d}")
        stream = system.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None  # its writer was cut short
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest that is whole, or that of ``version``; version 0 is the table before its first run."""
        for number in reversed(self._numbers()):
            if version in (None, number) and (found := self._manifest(number)) is not None:
                return found
        if version:
            raise KeyError(f"{self.path} has no version {version}")
        return {"version": 0, "schema": None, "buckets": {}, "counts": {}, "marks": {}, "changes": None}

    def _commit(self, manifest: dict) -> None:
        place, system = self._at(f"manifests/{manifest['version']:012d}")
        try:
            out = system.create(place, False)
        except Exception as e:
            raise Conflict(f"{self.path} has a version {manifest['version']} already") from e
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    def _rows(self, manifest: dict) -> DataFrame:
        schema = manifest["schema"]
        places = [f"{self.path}/{folder}" for _, folder in sorted(manifest["buckets"].items())]
        if not places:
            return self.spark.createDataFrame([], schema)
        # a bucket also tells what its run took out of it
        return self.spark.read.schema(f"{schema}, {_DONE} string").parquet(*places).filter(~F.col(_DONE).eqNullSafe("PRUNE")).drop(_DONE)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of ``version``, with the versions that made and last changed each."""
        return self._rows(self.manifest(version))

    def marks(self) -> dict:
        return self.manifest()["marks"]

    def changes(self, version: int | None = None) -> DataFrame:
        """``key, action`` (INSERT, UPDATE, PRUNE) of the run that wrote a version."""
        found = self.manifest(version)
        rows = self.spark.read.schema(f"{found['schema']}, {_DONE} string").parquet(f"{self.path}/{found['changes']}")
        return rows.filter(F.col(_DONE).isin(*WRITTEN)).select(self.key, F.col(_DONE).alias("action"))

    def parts(self, rows: int = 0) -> int:
        """In how many parts a merge of ``rows`` deals: about ``PART_ROWS`` of them or of those stored in each, a multiple of
        ``buckets``. Spark deals rows by the hash that tells their bucket, so a part has rows of one bucket only."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.buckets * -(-max(least, -(-max(rows, self.manifest().get("rows", 0)) // PART_ROWS)) // self.buckets)

    def merge(self, desired: DataFrame, prune: bool = True, scope: tuple[str, DataFrame] | None = None, marks: dict | None = None, parts: int | None = None) -> dict:
        """Make the table say what ``desired`` says, and return the manifest.

        A key that is new is inserted, one whose digest differs is updated and keeps the version that made it, others are
        skipped. Stored keys that nobody desires go with ``prune``: all of them, or only those whose column ``scope[0]``
        has a value in ``scope[1]``, as when some cases are projected anew and the others are not looked at. Marks move
        with the rows or not at all. Rows without a key are no rows; of rows with one key the one of the least digest
        counts. An empty ``desired`` prunes what it may.

        Where ``parts`` is given, ``desired`` is dealt by ``by`` in so many parts already. Each row of either side is
        shuffled once at the most and written once.
        """
        key, by, old = self.key, self.by, self.manifest()
        rest = [c for c in desired.columns if c not in (key, by, self.digest)]
        n = parts or self.parts()
        stored = self._rows(old) if old["schema"] else None
        # a manifest that was cut short still holds its number
        version = max(self._numbers(), default=0) + 1
        schema = StructType([*desired.schema, StructField(CREATED, LongType()), StructField(UPDATED, LongType())])
        kinds = {f.name: f.dataType for f in schema}
        keys = list(dict.fromkeys((by, key)))

        def side(rows: DataFrame, new: bool, may_go) -> DataFrame:
            said = F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in (self.digest, *rest, CREATED, UPDATED)])
            return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys], F.lit(new).alias("_new"), may_go.alias("_go"), said.alias("_r"))

        both = side(desired.filter(F.col(key).isNotNull()), True, F.lit(False))
        both = both if parts else both.repartition(n, by)
        if stored is not None and not (scope and prune):
            both = both.unionByName(side(stored, False, F.lit(prune)).repartition(n, by))
        elif stored is not None:
            values = scope[1].select(F.col(scope[1].columns[0]).alias("_s")).distinct().withColumn("_in", F.lit(True)).repartition(n, "_s")
            held = stored.repartition(n, scope[0])
            held = side(held.join(values, F.col(scope[0]) == F.col("_s"), "left"), False, F.coalesce("_in", F.lit(False)))
            both = both.unionByName(held if scope[0] == by else held.repartition(n, by))
        one = both.groupBy(*keys).agg(F.min(F.when(F.col("_new"), F.col("_r"))).alias("_n"), F.min(F.when(~F.col("_new"), F.col("_r"))).alias("_o"), F.max("_go").alias("_go"))
        done = F.when(F.col("_o").isNull(), "INSERT").when(F.col("_n").isNull(), F.when(F.col("_go"), "PRUNE").otherwise("KEEP")).when(F.col(f"_o.{self.digest}").eqNullSafe(F.col(f"_n.{self.digest}")), "SKIP").otherwise("UPDATE")
        one = one.withColumn(_DONE, done)
        written = F.col(_DONE).isin("INSERT", "UPDATE")
        own = {CREATED: F.coalesce(f"_o.{CREATED}", F.lit(version)), UPDATED: F.when(written, F.lit(version)).otherwise(F.col(f"_o.{UPDATED}"))}
        said = [F.col(c) if c in keys else own.get(c, F.when(written, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))).cast(kinds[c]).alias(c) for c in kinds]
        run = f"data/{uuid.uuid4().hex}"
        one.select(*said, _DONE, F.pmod(F.hash(by), F.lit(self.buckets)).alias("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{run}/rows")
        told = self.spark.read.schema(f"{_DONE} string, bucket int").parquet(f"{self.path}/{run}/rows").groupBy("bucket", _DONE).count().collect()  # a few numbers for each bucket
        counts = {a: sum(r["count"] for r in told if r[_DONE] == a) for a in ("INSERT", "UPDATE", "SKIP", "PRUNE", "KEEP")}
        touched = {r["bucket"] for r in told if r[_DONE] in WRITTEN}
        moved = {**old["marks"], **(marks or {})}
        if not touched and moved == old["marks"] and old["schema"]:
            self._remove(run)
            return {**old, "counts": counts}
        folders = dict(old["buckets"])
        if "rows" not in old:  # written when buckets went by another hash: all of them are replaced
            folders, touched = {}, touched | {r["bucket"] for r in told}
        full = {r["bucket"] for r in told if r[_DONE] != "PRUNE"}
        for b in touched:
            folders.pop(str(b), None)
            if b in full:
                folders[str(b)] = f"{run}/rows/bucket={b}"
        for b in {r["bucket"] for r in told} - touched:
            self._remove(f"{run}/rows/bucket={b}")
        live = sum(counts[a] for a in counts if a != "PRUNE")
        manifest = {"version": version, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "buckets": folders, "rows": live, "counts": counts, "marks": moved, "changes": f"{run}/rows"}
        self._commit(manifest)
        return manifest

    def _remove(self, name: str) -> None:
        place, system = self._at(name)
        system.delete(place, True)

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the newest ``keep`` manifests names, and older manifests; returns how many folders went.
        Only where no run is under way."""
        whole = [m for n in self._numbers() if (m := self._manifest(n)) is not None]
        used = {folder.split("/")[1] for m in whole[-keep:] for folder in (*m["buckets"].values(), m["changes"])}
        gone = 0
        place, system = self._at("data")
        for f in system.listStatus(place) if system.exists(place) else []:
            if f.getPath().getName() not in used:
                gone += bool(system.delete(f.getPath(), True))
        for m in whole[:-keep]:
            old, system = self._at(f"manifests/{m['version']:012d}")
            system.delete(old, False)
        return gone
