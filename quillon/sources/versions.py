"""Tables that change together, kept in versions (K11, K14, K16): a change rewrites the touched parts only, and readers see one
version until the next is whole.

Rows are dealt to a fixed number of parts by a hash of a key column. A commit writes the changed parts as new files, then adds
one small file to the folder's list of commits: for each table and part the path that holds it. That file's appearance is the
change; what no commit names is never read. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "version long, note string, name string, part int, path string"


class Store:
    """The tables of a folder. tables: name to (schema, key column)."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]], parts: int = 16):
        self.spark, self.folder, self.tables, self.parts = spark, folder.rstrip("/"), tables, parts

    def part(self, name: str) -> Column:
        """The part of a table's row."""
        return F.pmod(F.xxhash64(F.col(self.tables[name][1]).cast("string")), F.lit(self.parts)).cast("int")

    def _commit_rows(self, version: int | None) -> list:
        """The commit's rows: one for each table and part at most, and one of no table."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits")
        except AnalysisException:  # nothing was committed yet
            return []
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == version).collect()

    def latest(self) -> tuple[int, str | None]:
        """The latest version (0: none) and its note."""
        rows = self._commit_rows(None)
        return (rows[0]["version"], rows[0]["note"]) if rows else (0, None)

    def read(self, name: str, parts: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version (the latest by default), or some of its parts."""
        wanted = None if parts is None else set(parts)
        paths = [r["path"] for r in self._commit_rows(version) if r["name"] == name and (wanted is None or r["part"] in wanted)]
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The parts of a table where rows' keys are."""
        return sorted(r[0] for r in rows.select(self.part(name)).distinct().collect())

    def commit(self, changes: dict[str, tuple[DataFrame, Iterable[int] | None]], note: str | None = None) -> int:
        """A new version. changes: for a table the rows that its given parts (None: all) hold from now on; the other parts stay
        the files that they are."""
        was = self._commit_rows(None)
        version = was[0]["version"] + 1 if was else 1
        paths = {(r["name"], r["part"]): r["path"] for r in was if r["name"]}
        for name, (rows, parts) in changes.items():
            schema = self.tables[name][0]
            gone = range(self.parts) if parts is None else list(parts)
            for part in gone:
                paths.pop((name, part), None)
            if not len(gone):
                continue
            # A large part is split into several files, each by a task of its own.
            folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            columns = self.spark.createDataFrame([], schema).columns
            rows.select(*columns, self.part(name).alias("_part")).hint("rebalance", "_part").write.partitionBy("_part").parquet(folder)
            try:
                full = [r[0] for r in self.spark.read.schema("_part int").option("basePath", folder).parquet(folder).select("_part").distinct().collect()]
            except AnalysisException:  # no rows, no files
                full = []
            paths |= {(name, part): f"{folder}/_part={part}" for part in full}
        listed = [(version, note, None, None, None), *((version, note, name, part, path) for (name, part), path in sorted(paths.items()))]
        self.spark.createDataFrame(listed, _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return version

    def change(self, name: str, keys: DataFrame, how: Callable[[DataFrame], DataFrame], note: str | None = None) -> int:
        """A new version in which the parts where keys' rows are hold how(what they held)."""
        parts = self.touched(name, keys)
        return self.commit({name: (how(self.read(name, parts)), parts)}, note)


class Cache:
    """Results by reader with an expiry, as a table of a Store. schema has `user_id` and `expires_at`."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], parts: int = 16):
        self.keys, self.store = keys, Store(spark, folder, {"cache": (schema, "user_id")}, parts)

    def write(self, rows: DataFrame) -> int:
        """Rows put in, in place of those of equal keys (null keys are equal)."""
        fresh = rows.select(*self.keys)

        def merged(old: DataFrame) -> DataFrame:
            same = [old[k].eqNullSafe(fresh[k]) for k in self.keys]
            return old.join(fresh, same, "left_anti").unionByName(rows)

        return self.store.change("cache", rows, merged)

    def invalidate(self, users: DataFrame) -> int:
        """All rows of some readers (user_id) deleted."""
        return self.store.change("cache", users, lambda old: old.join(users.select("user_id"), "user_id", "left_anti"))

    def delete_expired(self, as_of: Column) -> int:
        """Expired rows deleted; only parts that hold any are rewritten."""
        gone = self.store.read("cache").where(F.col("expires_at") <= as_of)
        return self.store.change("cache", gone, lambda old: old.where(F.col("expires_at") > as_of))

    def read(self, as_of: Column, version: int | None = None) -> DataFrame:
        """The rows that have not expired, as of a version."""
        return self.store.read("cache", version=version).where(F.col("expires_at") > as_of)
