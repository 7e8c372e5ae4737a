"""What the operators share: the folder that all executors see, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: What operators keep in a worker process from task to task: a function for each operator that drops it.
_kept: dict[str, Callable[[], None]] = {}


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Called by an operator's tasks that keep caches: what other operators have kept in this worker process is dropped, so a
    pipeline's workers hold one operator's caches at a time."""
    others = [x for x in _kept if x != owner]
    for name in others:
        _kept.pop(name)()
    _kept[owner] = drop
    if others:
        gc.collect()
        release()


def release() -> None:
    """Give freed memory of this process back to the system, as far as the allocators can; idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Largest Arrow batch that goes to a worker, in bytes; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, for mapInArrow: its session's Arrow batches are held to BATCH_BYTES, whatever texts' lengths. A smaller setting
    stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df

#: Longer words are not kept in a worker's caches, so that entries bound their bytes.
CACHED_LENGTH = 256

#: Row groups of tables in the shared folder.
ROW_GROUP_BYTES = 32 << 20

#: Broadcast a side only up to so many rows of a few longs each (about 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/quillon/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: df written as Parquet to the shared folder and read back. It survives lost executors. Row groups are
    small, so that writers and readers of long texts hold little."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: White space in the sense of str.split() that is none in ours.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SPACES = re.compile("[ \\t-\\r]+")


def ascii_words(text: str | None) -> list[str]:
    """Runs of characters other than ASCII white space, as quality_rules.words_of has them on columns."""
    if not text:
        return []
    if _OTHER_SPACE.search(text):
        return [x for x in _SPACES.split(text) if x]
    return text.split()


def filesystem(uri: str):
    """pyarrow's file system for a path or URI of any store that it knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if its counted rows are within BROADCAST_ROWS; else as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def quantile_of(steps: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys, limit, _n: the smallest step of each key with a share of at least q of its n at or below it, and the sum of n.
    steps: keys, step, n, few rows."""
    by = Window.partitionBy(*keys)
    rows = steps.withColumns({"_up": F.sum("n").over(by.orderBy("step")), "_n": F.sum("n").over(by)})
    return rows.where(F.col("_up") >= q * F.col("_n")).groupBy(*keys).agg(F.min("step").alias("limit"), F.max("_n").alias("_n"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, less those that close a cycle, batch by batch (bounded memory)."""
    for batch in batches:
        u, v = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns[:2])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], ["u", "v"])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) that connect what the edges u-v connect."""
    if not len(u):
        return u.astype(np.int64), v.astype(np.int64)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        was = low.copy()
        small = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], small)
        np.minimum.at(low, low[b], small)
        low = low[low]
        if (low == was).all():
            break
    keep = low != np.arange(len(nodes))
    return nodes[keep].astype(np.int64), nodes[low[keep]].astype(np.int64)


#: Parts into which a hot key's rows are dealt; its partner row in a unique table is repeated as often.
SALTS = 64


def with_partner(rows: DataFrame, key: str, salt_by: str, table: DataFrame, partial: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with the columns of table, whose rows are unique by key, where rows may hold one key very often.

    Rows are dealt by (key, salt) and table is repeated for the salts that occur with a key, SALTS of them at most, so a key
    of a third of all rows is spread over that many groups. partial: a table that holds each occurring (key, salt) once.
    """
    salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int").alias("_salt")
    if partial is None:
        partial = rows.select(key, salt).distinct()
    wide = partial.select(key, "_salt").join(table, key)
    return rows.select("*", salt).join(wide, [key, "_salt"], how).drop("_salt")


def _lowest(edges: DataFrame, itself: bool) -> tuple[DataFrame, DataFrame]:
    """The smallest v of each u (or u itself): (u, _salt) once each, and u, m. The minimum is taken by (u, salt) first."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("_salt")
    parts = edges.groupBy("u", salt).agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.min("m").alias("m"))
    return parts, low.select("u", F.least("u", "m").alias("m")) if itself else low


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, component (smallest node reachable) of each node that an edge u-v touches.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, so no lineage grows. Repeated
    edges go first. A node's minimum is taken in two aggregates and goes back to its edges by salted joins
    (with_partner), so a hub that a third of all edges touch is dealt to many tasks. Null ends and loops are left out. No
    edge: an empty table.
    """
    e = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v"))
    e = materialize(e.where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), f"{label}-edges")
    was = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parts, low = _lowest(both, True)
        large = with_partner(both.where("v > u"), "u", "v", low, parts).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{label}-large")
        parts, low = _lowest(large, False)
        small = with_partner(large, "u", "v", low, parts).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was = now
