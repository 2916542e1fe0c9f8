"""Keyed collections in versions, and a content-addressed cache: tables of Parquet files that are replaced by key, a part at a time.

A collection is dealt in buckets by a hash of its key. A merge writes new files for the buckets that it touches, then the manifest of
the next version, which says for each bucket where its rows are; the manifest is renamed into place as the last step, and only
one can take the next number. So a reader sees the version before or the one after, a merge that dies leaves the version as it
was, and of two merges at once one is told to try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark.operators.tables import delete, exists, written

#: Keys of a merge are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Taken(RuntimeError):
    """Another merge has made this version."""


class Collection:
    """Rows by ``key`` beneath ``folder``; ``buckets`` holds from the first version on."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 16):
        self.spark, self.folder, self.key, self._buckets = spark, folder, key, buckets

    def manifest(self) -> dict | None:
        """That of the latest version: its number, the schema, buckets and where their rows are."""
        if not exists(self.spark, f"{self.folder}/manifests"):
            return None
        fs, p = _fs(self.spark, f"{self.folder}/manifests")
        names = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{names[-1]}").collect())) if names else None

    def rows(self, manifest: dict | None = None) -> DataFrame | None:
        """All rows of the latest version, or of ``manifest``'s; None if there is no version."""
        m = manifest or self.manifest()
        if m is None:
            return None
        schema = StructType.fromJson(m["schema"])
        paths = sorted(set(m["paths"].values()))
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def ids(self) -> DataFrame | None:
        own = self.rows()
        return None if own is None else own.select(self.key).distinct()

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """The next version: ``rows`` in place of all that have their keys, and without the keys of ``gone``. Its number.

        Rows of one key all stay. Rows and keys that are null are left out. A merge that changes nothing makes no version.
        """
        now = self.manifest() or {"version": 0, "buckets": self._buckets, "paths": {}}
        n, version = now["buckets"], now["version"] + 1
        new = None if rows is None else written(rows.where(F.col(self.key).isNotNull()), "merge")
        keys = [k.select(self.key) for k in (new, gone) if k is not None]
        if not keys:
            return now["version"]
        keys = keys[0].union(keys[1]) if len(keys) > 1 else keys[0]
        keys = written(keys.where(F.col(self.key).isNotNull()).distinct().withColumn("_bucket", self._bucket(n)), "merge-keys")
        touched = sorted(r[0] for r in keys.select("_bucket").distinct().collect())  # no more than there are buckets
        before = [p for b in touched if (p := now["paths"].get(str(b)))]
        if not touched or new is None and not before:
            return now["version"]
        schema = new.schema if new is not None else StructType.fromJson(now["schema"])
        out = new
        if before:
            old = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in before])
            side = keys.select(self.key)
            old = old.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("merge"), self.key, "left_anti").select(*schema.names)
            out = old if out is None else out.unionByName(old)
        data = f"data/{uuid.uuid4().hex}"
        out.withColumn("_bucket", self._bucket(n)).repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{data}")
        paths = dict(now["paths"])
        for b in touched:
            path = f"{data}/_bucket={b}"
            paths.pop(str(b), None)
            if exists(self.spark, f"{self.folder}/{path}"):
                paths[str(b)] = path
        self._commit({"version": version, "buckets": n, "schema": json.loads(schema.json()), "paths": paths})
        return version

    def _commit(self, manifest: dict) -> None:
        name = f"{self.folder}/manifests/{manifest['version']:010}.json"
        fs, p = _fs(self.spark, name)
        aside = f"{self.folder}/manifests/.{uuid.uuid4().hex}"
        out = fs.create(_fs(self.spark, aside)[1])
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(_fs(self.spark, aside)[1], p):
            delete(self.spark, aside)
            raise Taken(f"version {manifest['version']} has been made by another merge")

    def add_missing(self, rows: DataFrame) -> bool:
        """Merges ``rows`` unless all their keys are there already; whether it did."""
        have = self.ids()
        if have is not None and rows.select(self.key).distinct().join(have, self.key, "left_anti").isEmpty():
            return False
        self.merge(rows if have is None else rows.join(have, self.key, "left_anti").select(*rows.columns))
        return True

    def vacuum(self) -> None:
        """Deletes the data that the latest version doesn't have; for when no reader of an older one is left."""
        m = self.manifest()
        if m and exists(self.spark, f"{self.folder}/data"):
            used = {p.split("/")[1] for p in m["paths"].values()}
            fs, p = _fs(self.spark, f"{self.folder}/data")
            for s in fs.listStatus(p):
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)


def replace_uploads(uploads: Collection, artifacts: Collection, new: DataFrame, made: DataFrame) -> None:
    """``new(filename, job, …)`` in place of uploads of the same names, whose jobs' artifacts go; ``made(job, …)`` are the new jobs' artifacts.

    Artifacts change first, so an upload never shows without its own; a run that dies between the two can be done again.
    """
    old = uploads.rows()
    gone = None
    if old is not None:
        gone = written(old.join(new.select("filename").distinct(), "filename").select("job").join(new.select("job").distinct(), "job", "left_anti"), "replaced-jobs")
    artifacts.merge(made, gone)
    uploads.merge(new)


class Cache:
    """Results by the SHA-256 of what they were made of, in folders of its first two digits; ``kind`` is the schema of a result."""

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder, self.schema = spark, folder, f"sha string, result {kind}, prefix string"

    def stored(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(self.folder)

    def put(self, results: DataFrame) -> None:
        """Adds ``results(sha, result)``; folders that get rows are written anew as a whole, the others stay as they are."""
        new = written(results.select("sha", "result", F.substring("sha", 1, 2).alias("prefix")).dropDuplicates(["sha"]), "cache-new")
        touched = [r[0] for r in new.select("prefix").distinct().collect()]  # 256 at most
        if not touched:
            return
        old = self.stored().where(F.col("prefix").isin(touched)).join(new.select("sha"), "sha", "left_anti").select("sha", "result", "prefix")
        whole = written(new.unionByName(old), "cache-whole")  # what is read can't be overwritten
        whole.repartition(F.col("prefix")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(self.folder)

    def through(self, rows: DataFrame, content: str, make) -> DataFrame:
        """``rows`` with ``sha``, ``result`` and ``hit``: from the cache where it has the content, else by ``make`` and put there.

        ``make`` takes ``(sha, content)``, each content once, and gives ``(sha, result)``. A null content has no result.
        """
        keyed = written(rows.withColumn("sha", F.sha2(content, 256)), "cache-keys")
        asked = keyed.where("sha is not null").select("sha", content).dropDuplicates(["sha"])
        known = written(asked.select("sha").join(self.stored().select("sha", "result"), "sha"), "cache-hits")
        fresh = written(make(asked.join(known.select("sha"), "sha", "left_anti")).select("sha", "result"), "cache-misses")
        self.put(fresh)
        every = known.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False)))
        return keyed.join(every, "sha", "left")
