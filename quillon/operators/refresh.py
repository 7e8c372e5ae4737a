"""Derived tables kept up to date by differences (K16, S27): list pairs from the rows that came and went, not from all lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.collaborative import PAIRS_EACH, pairs_at_most, pairs_of
from quillon.operators.lineage import cut, fingerprint, parts
from quillon.sources.versions import Store

PAIR_TABLES = {
    "seeds": ("list_id long, work_id long", "list_id"),
    "sizes": ("work_id long, lists long", "work_id"),
    "overlaps": ("a long, b long, overlap long", "a"),
}


def states(old: DataFrame, new: DataFrame) -> DataFrame:
    """list_id, work_id, was, now (0 or 1 each) of every row of either; both have distinct rows, without nulls."""
    flag = lambda rows, was, now: rows.select("list_id", "work_id", F.lit(was).alias("was"), F.lit(now).alias("now"))
    return flag(old, 1, 0).unionByName(flag(new, 0, 1)).groupBy("list_id", "work_id").agg(F.max("was").alias("was"), F.max("now").alias("now"))


def _merged(old: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts with signed differences added; what comes to 0 goes. Both are written tables, so counting their rows is cheap."""
    if old.isEmpty():
        return delta.where(F.col(value) > 0)
    rows = old.unionByName(delta.select(*old.columns))
    n = parts(rows.sparkSession, rows.count(), PAIRS_EACH)
    return rows.repartition(n, *keys).groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def refresh_pairs(store: Store, seeds: DataFrame, note: str | None = None) -> int:
    """Bring store's list pairs to the state of seeds (list_id, work_id): its new version, or the one there is if nothing
    changed.

    A pair's change in a list is now_a * now_b - was_a * was_b, so only lists with a difference are looked at; a first run has
    all lists there. Of the stored counts only the parts that the changes touch are rewritten. Lists are brought together as in
    list_pairs: the reader of dumps bounds a list's length.
    """
    new = cut(seeds.select(F.col("list_id").cast("long"), F.col("work_id").cast("long")).dropna().distinct(), "refresh-seeds")
    rows = cut(states(store.read("seeds"), new), "refresh-states")
    delta = rows.where("was <> now")
    if delta.isEmpty():
        return store.latest()[0]
    rows = cut(rows.join(delta.select("list_id").distinct(), "list_id", "left_semi"), "refresh-lists")
    n = parts(store.spark, pairs_at_most(rows), PAIRS_EACH)
    change = F.col("x.now") * F.col("y.now") - F.col("x.was") * F.col("y.was")
    pairs = cut(pairs_of(rows, n, ["was", "now"], change).where("overlap <> 0"), "refresh-pairs")
    sizes = cut(delta.groupBy("work_id").agg(F.sum(F.col("now") - F.col("was")).alias("lists")), "refresh-sizes")
    out = {}
    for name, changed, keys, value in (("overlaps", pairs, ["a", "b"], "overlap"), ("sizes", sizes, ["work_id"], "lists")):
        touched = store.touched(name, changed)
        out[name] = (_merged(store.read(name, touched), changed, keys, value), touched)
    touched = store.touched("seeds", delta)
    return store.commit(out | {"seeds": (new.where(store.part("seeds").isin(*touched)), touched)}, note)


def stored_pairs(store: Store, min_overlap: int = 2) -> DataFrame:
    """a, b, overlap, jaccard as list_pairs gives them, from the stored counts."""
    sizes = store.read("sizes")
    pairs = store.read("overlaps").where(F.col("overlap") >= min_overlap)
    sized = pairs.join(sizes.select(F.col("work_id").alias("a"), F.col("lists").alias("na")), "a").join(sizes.select(F.col("work_id").alias("b"), F.col("lists").alias("nb")), "b")
    return sized.select("a", "b", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).cast("decimal(6,5)").alias("jaccard"))


def refresh_from(spark: SparkSession, folder: str, source: str, seeds: DataFrame) -> tuple[Store, bool]:
    """The pairs of a source in a folder, brought up to date if the source's files (path, size, time) are not those that
    they were made from. The store, and whether there was work to do."""
    store, now = Store(spark, folder, PAIR_TABLES), fingerprint(spark, source)
    if store.latest()[1] == now:
        return store, False
    was = store.latest()[0]
    if refresh_pairs(store, seeds, now) == was:
        store.commit({}, now)
    return store, True
