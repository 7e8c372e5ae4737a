"""Popularity, ratings and quality of works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scoring


def popularity(log: DataFrame) -> DataFrame:
    """A1: counts of each status and of readers for each work."""
    count = lambda s: F.count_if(F.col("status") == s)
    return log.groupBy("work_id").agg(count("already-read").alias("read_count"), count("currently-reading").alias("reading_count"), count("want-to-read").alias("want_count"), F.count_distinct("user_id").alias("unique_users"), F.count("*").alias("total_logs"))


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """A2: ratings of 1 to 5, their number and mean to two decimals."""
    stars = [F.count_if(F.col("rating") == k).alias(f"stars_{k}") for k in range(1, 6)]
    return ratings.groupBy("work_id").agg(F.count("*").alias("n_ratings"), (F.sum("rating").cast("decimal(18,0)") / F.count("*")).cast("decimal(4,2)").alias("avg_rating"), *stars)


def popularity_scores(log: DataFrame) -> DataFrame:
    """P8 for each work."""
    p = popularity(log)
    return p.select("work_id", F.round(scoring.popularity(F.col("read_count"), F.col("reading_count"), F.col("want_count")), 6).alias("popularity"))


def trending(log: DataFrame, k: int = 50) -> DataFrame:
    """The k works of the largest trend, ties by id."""
    p = popularity(log)
    t = scoring.trending(F.col("read_count"), F.col("reading_count"), F.col("want_count"))
    return p.select("work_id", F.round(t, 6).alias("trend")).orderBy(F.col("trend").desc(), "work_id").limit(k)


def quality(ratings: DataFrame) -> DataFrame:
    """Blended mean and Wilson bound of each work over its sources. ratings: work_id, source, avg, n."""
    w = scoring.source_weight(F.col("source")) * F.col("n")
    sums = ratings.groupBy("work_id").agg(F.sum(w * F.col("avg")).alias("s"), F.sum(w).alias("w"), F.sum("n").alias("total_ratings"))
    mean = scoring.bayes_mean(F.col("s"), F.col("w"), F.col("total_ratings"))
    share = scoring.clamp((F.col("s") / F.col("w") - 1.0) / 4.0, 0.0, 1.0)
    return sums.select("work_id", mean.alias("blended_avg"), scoring.wilson(share, F.col("total_ratings")).alias("wilson"), "total_ratings")


def graded(q: DataFrame) -> DataFrame:
    """P3, P6, P7 for rows of quality()."""
    s = scoring.quality(F.col("blended_avg"), F.col("wilson"), F.col("total_ratings"))
    return q.select("work_id", F.round(s, 6).alias("quality_score"), scoring.grade(F.round(s, 6)).alias("grade"), scoring.browse_grade(F.round("blended_avg", 6), F.col("total_ratings")).alias("browse_grade"), F.round(scoring.browse_confidence(F.col("total_ratings")), 6).alias("confidence"))


def page_medians(editions: DataFrame) -> DataFrame:
    """Exact median page count of each work, halves to the even number."""
    return editions.where("page_count is not null").groupBy("work_id").agg(F.rint(F.percentile("page_count", 0.5)).cast("int").alias("page_count_median"))


def embedding_queue(works: DataFrame, log: DataFrame, ratings: DataFrame, k: int = 100) -> DataFrame:
    """Works with at least two readers or a rating: most popular first, then those with a description, then those
    with more ratings. works: work_id, title, description, embedding."""
    readers = log.groupBy("work_id").agg(F.count_distinct("user_id").alias("readers"))
    rated = ratings.groupBy("work_id").agg(F.count("*").alias("n_ratings"))
    both = readers.join(rated, "work_id", "full").select("work_id", F.coalesce("readers", F.lit(0)).alias("readers"), F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"))
    both = both.where("readers >= 2 or n_ratings >= 1")
    missing = works.where(F.col("embedding").isNull()).select("work_id", "title", F.col("description").isNotNull().alias("has_description"))
    return missing.join(both, "work_id").orderBy(F.col("readers").desc(), F.col("has_description").desc(), F.col("n_ratings").desc(), "work_id").limit(k)

