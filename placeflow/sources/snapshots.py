"""Versioned Parquet snapshots in buckets by key: read, patch only the buckets that change, and commit if nobody else did."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer committed the version first."""


class Store:
    """Tables under a folder that all executors share, each cut into buckets by a hash of its key.

    A version is a small file that names, for each bucket, the folder of its rows. A writer writes the buckets that it
    changes to a folder of its own, then creates the next version's file if it is absent: of several writers of one
    version one succeeds, and the others find a conflict. Buckets that a write doesn't touch keep their folder, so two
    versions differ in the buckets whose folders differ, and nowhere else. Nothing is renamed.

    A table without a key has one bucket. Give a large one as many buckets as it has rows by the million.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        """The numbers of all versions that are whole; one that a writer left unfinished doesn't count."""
        at = self._path(f"{self.root}/{table}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit() and s.getLen() > 0)

    def version(self, table: str) -> int:
        return max(self.versions(table), default=0)

    def manifest(self, table: str, version: int | None = None) -> dict:
        """key (null: none), buckets (how many), schema, and folders by bucket; a bucket without rows has none."""
        at = self._fs.open(self._path(f"{self.root}/{table}/versions/{version or self.version(table)}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8"))
        finally:
            at.close()

    def read(self, table: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some of its buckets."""
        m = self.manifest(table, version)
        schema = StructType.fromJson(m["schema"])
        folders = [f"{self.root}/{table}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, table: str, rows: DataFrame, base: int, key: str | None = None, buckets: int | None = None) -> int:
        """Writes rows as version base + 1, unless another writer has. A first version fixes the key and the number of buckets."""
        if self.version(table) != base:
            raise Conflict(f"{table} is at version {self.version(table)}, not {base}")
        old = self.manifest(table, base) if base else {}
        m = {"key": key or old.get("key"), "buckets": buckets or old.get("buckets", 1), "schema": json.loads(rows.schema.json()), "folders": {}, "notes": old.get("notes", {})}
        return self._put(table, rows, base, m)

    def commit_buckets(self, table: str, rows: DataFrame, base: int, buckets: set[int], notes: dict) -> int:
        """Puts rows in place of some buckets as version base + 1, with notes that stand or fall with them; later versions keep notes until they are replaced."""
        if self.version(table) != base:
            raise Conflict(f"{table} is at version {self.version(table)}, not {base}")
        m = self.manifest(table, base)
        m["folders"] = {b: f for b, f in m["folders"].items() if int(b) not in buckets}
        m["notes"] = {**m.get("notes", {}), **notes}
        return self._put(table, rows, base, m)

    def _put(self, table: str, rows: DataFrame, base: int, m: dict) -> int:
        """Writes the rows of some buckets, and a version with them; m holds the other buckets' folders."""
        folder = f"rows-{uuid.uuid4().hex}"
        at = f"{self.root}/{table}/{folder}"
        if m["buckets"] == 1:
            rows.write.parquet(at)
            m["folders"]["0"] = folder
        else:
            # a large bucket is several tasks and files: Spark cuts it by its size
            rows.withColumn(BUCKET, bucket(F.col(m["key"]), m["buckets"])).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(at)
            for s in self._fs.listStatus(self._path(at)):
                if (name := s.getPath().getName()).startswith(f"{BUCKET}="):
                    m["folders"][name.removeprefix(f"{BUCKET}=")] = f"{folder}/{name}"
        path = self._path(f"{self.root}/{table}/versions/{base + 1}")
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            self._fs.delete(self._path(at), True)
            if self._fs.exists(path):
                raise Conflict(f"{table} version {base + 1} is there already") from e
            raise
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        return base + 1

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], tries: int = 3) -> int:
        """Re-reads and re-derives the whole table until a commit succeeds."""
        return self._tried(tries, lambda: self.commit(table, change(self.read(table, base := self.version(table))), base))

    def patch(self, table: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 3) -> int:
        """A version in which change(current rows, rows) takes the place of the buckets that the rows' keys fall into.

        Rows bring the table's key column; k keys rewrite k buckets at most. No rows, no new version.
        """
        rows = rows.persist()

        def once() -> int:
            base = self.version(table)
            m = self.manifest(table, base)
            touched = {r[0] for r in rows.select(bucket(F.col(m["key"]), m["buckets"]) if m["buckets"] > 1 else F.lit(0)).distinct().collect()}  # numbers of buckets
            if not touched:
                return base
            current = self.read(table, base, touched)
            m["folders"] = {b: f for b, f in m["folders"].items() if int(b) not in touched}
            return self._put(table, change(current, rows), base, m)

        try:
            return self._tried(tries, once)
        finally:
            rows.unpersist()

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Merges rows, one per key: columns that aren't null win, new keys are added."""
        return self.patch(table, rows, lambda now, new: merge(now, new, self.manifest(table)["key"]))

    def delete(self, table: str, keys: DataFrame) -> int:
        """Removes the rows of keys."""
        return self.patch(table, keys, lambda now, gone: without(now, gone, self.manifest(table)["key"]))

    def _tried(self, tries: int, write: Callable[[], int]) -> int:
        for k in range(tries):
            try:
                return write()
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def changes(self, table: str, old: int, new: int) -> DataFrame:
        """(key, op, before, after) of the rows that differ between two versions: created, changed or removed. Version 0 is empty.

        Reads the buckets whose folders differ, on either side, and joins them by key.
        """
        after = self.manifest(table, new)
        before = self.manifest(table, old) if old else {"folders": {}, "schema": after["schema"]}
        differ = {int(b) for b in {**before["folders"], **after["folders"]} if before["folders"].get(b) != after["folders"].get(b)}
        key = after["key"]
        side = lambda v, name: (self.read(table, v, differ) if v else self.spark.createDataFrame([], StructType.fromJson(after["schema"]))).select(F.col(key).alias(f"_{name}"), F.struct("*").alias(name))
        both = side(old, "before").join(side(new, "after"), F.col("_before") == F.col("_after"), "full_outer")
        op = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        return both.select(F.coalesce("_after", "_before").alias(key), op.alias("op"), "before", "after").filter("op is not null")

    def vacuum(self, table: str, keep: int, older_than_s: float = 3600) -> list[str]:
        """Deletes all but the newest `keep` versions, and folders and unfinished versions that no kept version needs, once they have rested."""
        kept = self.versions(table)[-keep:]
        named = {f.split("/")[0] for v in kept for f in self.manifest(table, v)["folders"].values()}
        gone = []
        for part, needed in (("", named), ("/versions", {str(v) for v in kept})):
            for s in self._fs.listStatus(self._path(f"{self.root}/{table}{part}")):
                name = s.getPath().getName()
                old = s.getModificationTime() / 1000 <= time.time() - older_than_s
                if name not in needed and old and (name.startswith("rows-") if not part else name.isdigit()):
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return sorted(gone)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the patch's columns that aren't null win. Columns of current."""
    p = patch.select(*[F.col(c).alias(f"p_{c}") for c in patch.columns])
    both = current.join(p, current[key] == F.col(f"p_{key}"), "full_outer")
    return both.select(*[F.coalesce(f"p_{c}", current[c]).alias(c) if c in patch.columns else current[c] for c in current.columns])


def without(current: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return current.join(keys, key, "left_anti")


def with_id(rows: DataFrame, *columns: str, name: str = "id") -> DataFrame:
    """Rows with an id derived from columns, the same on every run."""
    return rows.withColumn(name, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256))


def seed_flags(flags: DataFrame, stored: DataFrame) -> DataFrame:
    """What seeding each boolean flag (flag) does: created, field_added, left_malformed or no_op.

    `stored` (flag, value) holds the control rows that are there, with the field's value as JSON text (null: the field is
    missing); of rows that repeat a flag, one that has a value counts.
    """
    held = stored.groupBy("flag").agg(F.max("value").alias("_value"), F.lit(True).alias("_there"))
    v = F.try_parse_json("_value")
    action = F.when(F.col("_there").isNull(), "created").when(F.col("_value").isNull(), "field_added").when(F.schema_of_variant(v) == "BOOLEAN", "no_op").otherwise("left_malformed")
    return flags.select("flag").distinct().join(held, "flag", "left").select("flag", action.alias("action"))
