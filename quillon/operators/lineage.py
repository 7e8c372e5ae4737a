"""Lineage cuts for iterative operators, and derived tables that are written once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_tables: dict[tuple, tuple[str, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where that is unset, in local mode, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


#: Spark's setting by which a query's shuffle files go when it has ended, not when the driver's garbage collector gets to it.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind: the table is there, so none would be read again."""
    was = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, was)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df, written to the shared folder and read back: later steps neither grow its lineage nor repeat its work, and a lost
    executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/quillon/{label}-{uuid.uuid4().hex}"
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df (written or otherwise cheap to count), broadcast if it has so few rows; else as it is, and its join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that is never broadcast, as its rows grow with the input: the planner goes by the size of files,
    which can be a small part of that of the rows in memory."""
    return df.hint("merge")


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Into how many partitions so many rows are dealt: a partition has about `each` at most, whatever the session's number of
    shuffle partitions, and all cores have some as soon as there is work for them."""
    return max(1 + rows // each, min(spark.sparkContext.defaultParallelism, 1 + rows * 20 // each))


def manifest(spark: SparkSession, source: str) -> DataFrame:
    """path, length, modificationTime of every file under a folder. No file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length", "modificationTime")


def fingerprint(spark: SparkSession, source: str) -> str:
    """Changes whenever a file under a folder comes, goes, or is written anew."""
    rows = manifest(spark, source).agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{rows[0]}-{rows[1]}"


def table(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of a source folder: built when an application first asks for it, and again when the source's files have
    changed since or its own are gone."""
    key, now = (spark.sparkContext.applicationId, source, name), fingerprint(spark, source)
    if key in _tables and _tables[key][1] == now:
        try:
            return spark.read.parquet(_tables[key][0])
        except AnalysisException:
            pass
    path = f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    rows = build()
    with _tidy(spark):
        rows.write.parquet(path)
    _tables[key] = (path, now)
    return spark.read.parquet(path)


def files(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """A folder that write(path) fills when an application first asks for it, and again when the source's files have changed since
    or its own are gone."""
    key, now = (spark.sparkContext.applicationId, source, name), fingerprint(spark, source)
    if key in _tables and _tables[key][1] == now:
        try:
            if not manifest(spark, _tables[key][0]).isEmpty():
                return _tables[key][0]
        except AnalysisException:
            pass
    path = f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    write(path)
    _tables[key] = (path, now)
    return path
