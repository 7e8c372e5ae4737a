"""Candidates, fusion, re-ranking and diversity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scoring, vectors

#: What a later hit of each source adds for each unit of its similarity (a book's graph hit: 0.15 for its 0.5).
BOOSTS_GENERAL = {"vector": 0.0, "graph": 0.2, "readers": 0.3, "community": 0.15}
BOOSTS_BOOK = {"vector": 0.0, "graph": 0.3, "readers": 0.4, "lists": 0.2}
#: Fixed values of the greedy re-ranking.
LAMBDA, NOVELTY, REPEAT = 0.3, 0.15, 0.1


def all_of(*conditions: Column | None) -> Column:
    """the conjunction of those conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def works_by_subject(works: DataFrame, work_subject: DataFrame, include: list[str], exclude: list[str] = (), year_min: int | None = None, year_max: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Works with any of the subjects and none of the excluded ones, within the years, not seen."""
    year = F.col("first_publish_year")
    rows = works.where(all_of(year >= year_min if year_min is not None else None, year <= year_max if year_max is not None else None))
    rows = rows.join(work_subject.where(F.col("subject").isin(*include)), "work_id", "left_semi")
    if exclude:
        rows = rows.join(work_subject.where(F.col("subject").isin(*exclude)), "work_id", "left_anti")
    return rows.join(seen.select("work_id"), "work_id", "left_anti") if seen is not None else rows


def category_candidates(rows: DataFrame, profile: DataFrame | None, k: int = 100) -> DataFrame:
    """By dot product with the profile's vector (works without one go), or 0.5 each without a profile. profile: one row."""
    if profile is None:
        scored = rows.select("work_id", F.lit(0.5).alias("score"))
    else:
        scored = rows.where(F.col("embedding").isNotNull()).crossJoin(F.broadcast(profile.select("vector"))).select("work_id", F.round(vectors.dot("embedding", "vector"), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "work_id").limit(k)


def fuse(hits: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """One score for each work from its hits (work_id, source, seq, sim), in the order of boosts' sources, seq and sim: the
    first hit's similarity, to which later hits add their boost times theirs, at most 1 then. As no hit takes away, adding
    up and one clamp equal clamping after each."""
    order, boost = F.lit(0), F.lit(0.0)
    for k, (name, b) in enumerate(boosts.items()):
        order = F.when(F.col("source") == name, k).otherwise(order)
        boost = F.when(F.col("source") == name, b).otherwise(boost)
    rows = hits.withColumns({"o": order, "add": boost * F.col("sim")})
    first = F.min_by(F.struct("sim", "add", "source"), F.struct("o", "seq", -F.col("sim"))).alias("first")
    one = rows.groupBy("work_id").agg(first, F.sum("add").alias("total"), F.count("*").alias("hits"))
    score = F.when(F.col("hits") == 1, F.col("first.sim")).otherwise(F.least(F.lit(1.0), F.col("first.sim") + F.col("total") - F.col("first.add")))
    return one.select("work_id", F.round(score, 9).alias("score"), F.col("first.source").alias("source"), "hits")


def without_blocked(rows: DataFrame, work_author: DataFrame, works: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """Rows less blocked works, and, where given, works of blocked authors (general mode only)."""
    if works is not None:
        rows = rows.join(works.select("work_id"), "work_id", "left_anti")
    if authors is not None:
        rows = rows.join(work_author.join(authors.select("author_id"), "author_id", "left_semi").select("work_id"), "work_id", "left_anti")
    return rows


def base_scores(candidates: DataFrame, quality: DataFrame, features: DataFrame, engagement: DataFrame, as_of: Column) -> DataFrame:
    """Base score from stored roundings of the candidate's score, quality and graph nearness."""
    rows = candidates.join(quality, "work_id", "left").join(features.select("work_id", "prox"), "work_id", "left").join(engagement, "work_id", "left")
    kept = lambda c, p, s: F.col(c).cast(f"decimal({p},{s})").cast("double")
    q = scoring.quality(kept("blended_avg", 4, 3), kept("wilson", 4, 3), F.col("total_ratings"))
    age = F.datediff(as_of, F.col("last_read_at"))
    e = F.when(F.col("total_ms").isNull(), 0.0).otherwise(scoring.engagement(F.col("total_ms") / 3_600_000.0, F.col("last30_ms") > 0, age))
    relevance, graph = kept("score", 6, 4), F.coalesce(kept("prox", 5, 4), F.lit(0.0))
    rows = rows.select("work_id", relevance.alias("relevance"), q.alias("quality"), graph.alias("graph"), e.alias("engagement"))
    base = scoring.base_score(F.col("relevance"), F.col("quality"), F.col("graph"), F.col("engagement"))
    return rows.select("work_id", *[F.round(c, 6).alias(c) for c in ("relevance", "quality", "graph", "engagement")], F.round(base, 6).alias("base"))


def greedy_rerank(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """R14 for one reader: take the best of (1 - LAMBDA) base + LAMBDA novelty NOVELTY - REPEAT authors already taken, one
    after another; ties to the first in base order. Novelty: 1 less the mean cosine with those taken, 1 without a vector.
    pdf: work_id, base, embedding (unit length or null), authors; in any order."""
    pdf = pdf.sort_values(["base", "work_id"], ascending=[False, True]).head(2 * limit).reset_index(drop=True)
    dims = max((len(v) for v in pdf["embedding"] if v is not None), default=1)
    x = np.array([np.zeros(dims) if v is None else np.asarray(v, float) for v in pdf["embedding"]]).reshape(len(pdf), dims)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    has = length[:, 0] > 0
    base, authors = pdf["base"].to_numpy(float), [list(a) if a is not None else [] for a in pdf["authors"]]
    total, n, used, free, out = np.zeros(dims), 0, set(), np.ones(len(pdf), bool), []
    for _ in range(min(limit, len(pdf))):
        novelty = np.where(has & (n > 0), 1 - (x @ total) / max(n, 1), 1.0)
        repeat = np.array([sum(a in used for a in own) for own in authors], float)
        score = np.where(free, (1 - LAMBDA) * base + LAMBDA * novelty * NOVELTY - REPEAT * repeat, -np.inf)
        k = int(np.argmax(np.round(score, 12)))
        free[k] = False
        out.append((len(out) + 1, int(pdf["work_id"][k]), float(0.7 * base[k] + NOVELTY * novelty[k]), float(novelty[k])))
        used.update(authors[k])
        if has[k]:
            total, n = total + x[k], n + 1
    return pd.DataFrame(out, columns=["position", "work_id", "final_score", "novelty"])


def rerank(scored: DataFrame, limit: int = 20, key: str = "user_id") -> DataFrame:
    """R14 for every reader (key) of scored: work_id, base, embedding, authors. A reader's rows are cut to twice the limit
    before they are brought together, so a group is of bounded size."""
    from quillon.operators.collaborative import keep_top

    top = keep_top(scored, [key], [F.col("base").desc(), "work_id"], 2 * limit)

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = greedy_rerank(pdf, limit)
        out.insert(0, key, k[0])
        return out

    kind = dict(scored.dtypes)[key]
    return top.groupBy(key).applyInPandas(one, f"{key} {kind}, position long, work_id long, final_score double, novelty double")


def diversity(rows: DataFrame) -> DataFrame:
    """Mean of 1 - cosine over the pairs of a list that have vectors (of the Jaccard distance of authors over all pairs
    where none has one; 1 without a pair), its number of distinct authors and share of repeats. rows: work_id, embedding,
    authors; a list of a page or so."""
    one = rows.select(F.col("work_id").alias("i"), F.col("embedding").alias("x"), F.coalesce("authors", F.array()).alias("p"))
    two = rows.select(F.col("work_id").alias("j"), F.col("embedding").alias("y"), F.coalesce("authors", F.array()).alias("q"))
    union = F.size(F.array_union("p", "q"))
    far = F.when(union > 0, 1 - F.size(F.array_intersect("p", "q")) / union).otherwise(1.0)
    pairs = one.join(two, F.col("i") < F.col("j")).agg(F.avg(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1 - vectors.cosine("x", "y"))).alias("d"), F.avg(far).alias("a"))
    any_ = rows.agg(F.count("embedding").alias("vectors"))  # one row
    ild = pairs.crossJoin(any_).select(F.coalesce(F.when(F.col("vectors") > 0, F.col("d")).otherwise(F.col("a")), F.lit(1.0)).alias("ild"))
    names = rows.select(F.explode("authors").alias("author")).agg(F.count_distinct("author").alias("unique_authors"), F.count("*").alias("n"))
    repeat = F.when(F.col("n") > 0, 1 - F.col("unique_authors") / F.col("n")).otherwise(0.0)
    return ild.crossJoin(names).select(F.round("ild", 6).alias("ild"), "unique_authors", F.round(repeat, 6).alias("repeat_rate"))
