"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.collaborative import keep_top
from quillon.operators.lineage import cut


def two_hops(edges: DataFrame, work_id: int) -> DataFrame:
    """Works that share a node (author or subject) with one work. edges: work_id, node."""
    mid = edges.where(F.col("work_id") == work_id).select("node")
    return edges.join(mid, "node", "left_semi").where(F.col("work_id") != work_id).select("work_id").distinct()


def user_features(events: DataFrame, works: DataFrame, work_author: DataFrame, work_subject: DataFrame, user_id: int) -> DataFrame:
    """For works that the reader has no event with: share of their authors that the reader likes, Jaccard similarity of
    their subjects with the reader's, whether the reader has read of their series, and the mean of the first two.

    Likes come from works read and not rated below 4; series from all works read.
    """
    own = events.where(F.col("user_id") == user_id)
    read = own.where("shelf = 'read'").select("work_id", "rating").distinct()
    liked = read.where("rating is null or rating >= 4").select("work_id").distinct()
    authors = work_author.join(liked, "work_id", "left_semi").select("author_id").distinct().withColumn("hit", F.lit(1))
    subjects = work_subject.join(liked, "work_id", "left_semi").select("subject").distinct().withColumn("hit", F.lit(1))
    series = works.join(read.select("work_id"), "work_id", "left_semi").where("series is not null").select("series").distinct().withColumn("same", F.lit(True))
    new = works.join(own.select("work_id").distinct(), "work_id", "left_anti").select("work_id", "series")
    total = subjects.agg(F.count("*").alias("liked"))  # one row
    by_author = work_author.join(authors, "author_id", "left").groupBy("work_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("affinity"))
    by_subject = work_subject.join(subjects, "subject", "left").groupBy("work_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("both"), F.count("*").alias("own")).crossJoin(F.broadcast(total))
    by_subject = by_subject.select("work_id", (F.col("both") / (F.col("own") + F.col("liked") - F.col("both"))).alias("overlap"))
    rows = new.join(by_author, "work_id", "left").join(by_subject, "work_id", "left").join(series, "series", "left")
    a, o = F.coalesce("affinity", F.lit(0.0)), F.coalesce("overlap", F.lit(0.0))
    return rows.select("work_id", F.round(a, 6).alias("author_affinity"), F.round(o, 6).alias("subject_overlap"), F.coalesce("same", F.lit(False)).alias("same_series"), ((a + o) / 2).alias("prox"))


def strong_edges(co: DataFrame, least: float = 0.05) -> DataFrame:
    """A, b, weight of the stored co-occurrences of at least so much similarity, in both directions; a pair that is stored
    both ways counts twice."""
    rows = co.where(F.col("jaccard") >= least).select("a", "b", F.col("jaccard").alias("weight"))
    return rows.unionAll(rows.select("b", "a", "weight"))


def label_propagation(edges: DataFrame, rounds: int = 15) -> DataFrame:
    """G5, synchronous and deterministic: every node takes the label with the largest weight among its neighbours, ties to
    the smallest label, for so many rounds. edges: a, b, weight, in both directions, the weights decimal, so that sums are
    exact. node, label.

    Rounds end when nothing changes, or when all labels are those of two rounds before: two works that only have each other
    swap labels for ever, and what the last round would give is known. The edges are written once, the labels after each round.
    """
    edges = cut(edges, "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    before = labels
    for k in range(1, rounds + 1):
        votes = edges.join(labels, edges["b"] == labels["node"]).groupBy("a", "label").agg(F.sum("weight").alias("w"))
        fresh = votes.groupBy(F.col("a").alias("node")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"))
        one, two = labels.select("node", F.col("label").alias("one")), before.select("node", F.col("label").alias("two"))
        before, labels = labels, cut(fresh.join(one, "node").join(two, "node"), "labels")
        changed, moved = labels.agg(F.count_if(F.col("label") != F.col("one")), F.count_if(F.col("label") != F.col("two"))).first()
        labels = labels.select("node", "label")
        if not changed:
            break
        if k > 1 and not moved:
            return labels if (rounds - k) % 2 == 0 else before
    return labels


def communities(labels: DataFrame, least: int = 5) -> DataFrame:
    """Labels of at least so many nodes."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "label").select("node", "label", "size")


def community_top(found: DataFrame, named: DataFrame, name: str, out: str, k: int = 5) -> DataFrame:
    """Each community's size and k most frequent names (of a column of named, with work_id), ties by name."""
    counts = found.join(named, found["node"] == named["work_id"]).groupBy("label", "size", name).agg(F.count("*").alias("n"))
    top = keep_top(counts, ["label"], [F.col("n").desc(), name], k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), name)))
    return top.groupBy("label", "size").agg(F.array_join(F.transform(ordered, lambda s: s[name]), ", ").alias(out))


def seeded(node: str, seed: int = 7) -> Column:
    """A key that puts rows in a random order, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(node).cast("string")).cast("binary"))


def community_candidates(found: DataFrame, works: DataFrame, k: int = 100) -> DataFrame:
    """K other works of the community of each of some works (work_id), in a seeded order: anchor, work_id. The
    order is the same for all works of a community, so only its first k + 1 are joined."""
    first = keep_top(found.select("node", "label", seeded("node").alias("_key")), ["label"], ["_key", "node"], k + 1)
    own = found.join(works.select(F.col("work_id").alias("anchor")), F.col("node") == F.col("anchor")).select("anchor", F.col("label").alias("_label"))
    rows = first.join(own, F.col("label") == F.col("_label")).where(F.col("node") != F.col("anchor"))
    return keep_top(rows.select("anchor", F.col("node").alias("work_id"), "_key"), ["anchor"], ["_key", "work_id"], k).drop("_key")


def resolve_redirects(redirects: DataFrame, hops: int = 10) -> DataFrame:
    """Where each old key ends, at most so many hops on, and the hops taken. Unrolled joins on the redirects' key; a key
    without a further redirect stays."""
    rows = redirects.select("old_key", F.col("new_key").alias("at"), F.lit(1).alias("hops"))
    step = redirects.select(F.col("old_key").alias("at"), F.col("new_key").alias("next"))
    for _ in range(hops - 1):
        rows = rows.join(step, "at", "left").select("old_key", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return rows.select("old_key", F.col("at").alias("final_key"), "hops")
