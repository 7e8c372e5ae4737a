"""Co-reading, lists and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lineage import cut, parts

#: Pairs that a task counts.
PAIRS_EACH = 1_000_000


def keep_top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key. The rank limit is pushed below the shuffle, so a task sends k rows a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def also_read(log: DataFrame, work_id: int, least: int = 2, k: int = 20) -> DataFrame:
    """Works of the readers of one work, by number of shared readers."""
    pairs = log.select("work_id", "user_id").distinct()
    readers = pairs.where(F.col("work_id") == work_id).select("user_id")
    counts = pairs.where(F.col("work_id") != work_id).join(readers, "user_id", "left_semi").groupBy("work_id").agg(F.count("*").alias("co_readers"))
    return counts.where(F.col("co_readers") >= least).orderBy(F.col("co_readers").desc(), "work_id").limit(k)


def also_read_jaccard(log: DataFrame, work_id: int, least: int = 2, k: int = 20) -> DataFrame:
    """The same by Jaccard similarity of the readers. Only the candidates' readers are counted in full."""
    pairs = log.select("work_id", "user_id").distinct()
    readers = pairs.where(F.col("work_id") == work_id).select("user_id")
    shared = pairs.where(F.col("work_id") != work_id).join(readers, "user_id", "left_semi").groupBy("work_id").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    sizes = pairs.join(shared.select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(F.count("*").alias("size"))
    own = readers.agg(F.count("*").alias("own"))  # one row
    j = F.col("overlap") / (F.col("own") + F.col("size") - F.col("overlap"))
    return shared.join(sizes, "work_id").crossJoin(F.broadcast(own)).select("work_id", "overlap", F.round(j, 6).alias("jaccard")).orderBy(F.col("jaccard").desc(), "work_id").limit(k)


def reading_pairs(log: DataFrame) -> DataFrame:
    """work_id, user_id, once each: what co-reading is counted from."""
    return log.select("work_id", "user_id").distinct()


def list_mates(seeds: DataFrame, work_id: int, k: int = 20) -> DataFrame:
    """Works that share lists with one work."""
    lists = seeds.where(F.col("work_id") == work_id).select("list_id")
    counts = seeds.where(F.col("work_id") != work_id).join(lists, "list_id", "left_semi").groupBy("work_id").agg(F.count("*").alias("shared_lists"))
    return counts.orderBy(F.col("shared_lists").desc(), "work_id").limit(k)


def pairs_at_most(seeds: DataFrame) -> int:
    """How many pairs the lists of seeds have, repeats counted."""
    lengths = seeds.groupBy("list_id").agg(F.count("*").alias("n"))
    return lengths.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0


def dealt(rows: DataFrame, n: int, key: str = "list_id") -> DataFrame:
    """rows with _chunk, a hash of key, in n partitions by it: what is grouped by _chunk and more needs no further shuffle."""
    return rows.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(16 * n)).cast("int")).repartition(n, "_chunk")


def pairs_of(rows: DataFrame, n: int, fields: list[str], value: Column, name: str = "overlap") -> DataFrame:
    """a < b and the sum of value over the lists that hold both works. rows: list_id, work_id, once a list, and fields, which value
    sees as x.field and y.field. Lists are brought together once, in n partitions; pairs are added up there before they are
    shuffled, and then by pair, again in n partitions: both hold a bounded number of pairs, whatever the session's settings."""
    entry = F.struct("work_id", *fields)
    lists = dealt(rows.where("list_id is not null and work_id is not null"), n).groupBy("_chunk", "list_id").agg(F.array_sort(F.collect_list(entry)).alias("w"))
    firsts = lists.select("_chunk", "w", F.posexplode("w").alias("i", "x"))
    pairs = firsts.select("_chunk", "x", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("y"))
    pairs = pairs.select("_chunk", F.col("x.work_id").alias("a"), F.col("y.work_id").alias("b"), value.alias(name)).where((F.col("a") < F.col("b")) & (F.col(name) != 0))
    within = pairs.groupBy("_chunk", "a", "b").agg(F.sum(name).alias(name))
    return within.select("a", "b", name).repartition(n, "a", "b").groupBy("a", "b").agg(F.sum(name).alias(name))


def list_pairs(seeds: DataFrame, min_lists: int = 2, min_overlap: int = 2) -> DataFrame:
    """Works a < b with their overlap of lists and its Jaccard similarity. Works on too few lists go before the
    self-join; pairs are counted before the shuffle, in as many tasks as their number asks for. A list has at most 1,000 seeds,
    as the reader of dumps keeps them (S12), so the pairs of one list are bounded."""
    seeds = cut(seeds.select("list_id", "work_id"), "list-seeds")
    n = parts(seeds.sparkSession, pairs_at_most(seeds), PAIRS_EACH)
    sizes = cut(seeds.groupBy("work_id").agg(F.count("*").alias("lists")).where(F.col("lists") >= min_lists), "list-sizes")
    kept = seeds.join(sizes.select("work_id"), "work_id", "left_semi")
    pairs = pairs_of(kept, n, [], F.lit(1)).where(F.col("overlap") >= min_overlap)
    sized = pairs.join(sizes.select(F.col("work_id").alias("a"), F.col("lists").alias("na")), "a").join(sizes.select(F.col("work_id").alias("b"), F.col("lists").alias("nb")), "b")
    return sized.select("a", "b", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).cast("decimal(6,5)").alias("jaccard"))


def author_pairs(work_author: DataFrame, low: int = 2, high: int = 100) -> DataFrame:
    """Works a < b of an author of low to high works; score min(1, 5 shared / larger number of authors)."""
    prolific = work_author.groupBy("author_id").agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).select("author_id")
    kept = work_author.join(prolific, "author_id", "left_semi")
    sizes = work_author.groupBy("work_id").agg(F.count("*").alias("authors"))
    left, right = kept.select("author_id", F.col("work_id").alias("a")), kept.select("author_id", F.col("work_id").alias("b"))
    pairs = left.join(right, "author_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    sized = pairs.join(sizes.select(F.col("work_id").alias("a"), F.col("authors").alias("na")), "a").join(sizes.select(F.col("work_id").alias("b"), F.col("authors").alias("nb")), "b")
    score = F.least(F.lit(1.0), F.col("overlap") * 5.0 / F.greatest("na", "nb"))
    return sized.select("a", "b", "overlap", score.cast("decimal(6,5)").alias("jaccard"))


def cooccurrence(seeds: DataFrame, work_author: DataFrame, top: int = 100) -> DataFrame:
    """G4 whole: list pairs in both directions; author pairs raise what is there in one direction (GREATEST) and add the
    reverse only where it is missing; the top entries of each work stay."""
    lists = list_pairs(seeds)
    both = lists.unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap", "jaccard"))
    authors = author_pairs(work_author)
    forward = authors.withColumn("kind", F.lit(1))
    back = authors.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap", "jaccard").withColumn("kind", F.lit(2))
    rows = both.withColumn("kind", F.lit(0)).unionByName(forward).unionByName(back)
    # A reverse row counts only where nothing else stands.
    best = rows.groupBy("a", "b").agg(*[F.max(F.when(F.col("kind") < 2, F.col(c))).alias(c) for c in ("overlap", "jaccard")], *[F.max(F.when(F.col("kind") == 2, F.col(c))).alias(f"r_{c}") for c in ("overlap", "jaccard")])
    merged = best.select("a", "b", F.coalesce("overlap", "r_overlap").alias("overlap"), F.coalesce("jaccard", "r_jaccard").alias("jaccard"))
    return keep_top(merged, ["a"], [F.col("jaccard").desc(), F.col("overlap").desc(), "b"], top)


def neighbours(co: DataFrame) -> DataFrame:
    """Both directions of every row; a pair that is stored both ways comes twice, as readers of the table see it."""
    return co.select(F.col("a").alias("work_id"), F.col("b").alias("related_id"), "overlap", "jaccard").unionAll(co.select(F.col("b").alias("work_id"), F.col("a").alias("related_id"), "overlap", "jaccard"))


def similar_works(co: DataFrame, work_id: int, least: int = 1, k: int = 20) -> DataFrame:
    """R5."""
    rows = neighbours(co).where((F.col("work_id") == work_id) & (F.col("overlap") >= least))
    return rows.select("related_id", "overlap", "jaccard").orderBy(F.col("jaccard").desc(), "related_id").limit(k)


def similar_works_batch(co: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """K neighbours of each asked work, those of at least two shared lists first."""
    rows = neighbours(co).join(ids, "work_id", "left_semi")
    return keep_top(rows, ["work_id"], [F.when(F.col("overlap") >= 2, 0).otherwise(1), F.col("jaccard").desc(), "related_id"], k)


def similar_tiered(co: DataFrame, log: DataFrame, work_id: int, k: int = 20) -> DataFrame:
    """The stored neighbours of overlap 2, else of overlap 1, else those by readers; the first tier that has any."""
    tiers = similar_works(co, work_id, 2, k).withColumn("tier", F.lit(1)).unionByName(similar_works(co, work_id, 1, k).withColumn("tier", F.lit(2)))
    live = also_read_jaccard(log, work_id, 3, k).select(F.col("work_id").alias("related_id"), "overlap", F.col("jaccard").cast("decimal(6,5)").alias("jaccard")).withColumn("tier", F.lit(3))
    rows = cut(tiers.unionByName(live), "tiers")  # 3 * k rows, read twice
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("tier"))), "tier").select("related_id", "overlap", "jaccard", "tier")
