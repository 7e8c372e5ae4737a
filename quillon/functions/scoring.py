"""Scores of works, events and recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rating blend.
SOURCE_WEIGHTS = {"openlibrary": 1.2, "googlebooks": 1.0}
PRIOR_MEAN, PRIOR_WEIGHT = 3.5, 10.0
Z95 = 1.96


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def source_weight(source: Column) -> Column:
    out = F.lit(1.0)
    for name, w in SOURCE_WEIGHTS.items():
        out = F.when(source == name, w).otherwise(out)
    return out


def wilson(p: Column, n: Column, z: float = Z95) -> Column:
    """Lower bound of a share p of n; 0 without any."""
    n = n.cast("double")
    inner = (p * (1 - p) + z * z / (4 * n)) / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(inner)) / (1 + z * z / n)).otherwise(0.0)


def bayes_mean(weighted_sum: Column, weight: Column, n: Column) -> Column:
    """The weighted mean drawn to the prior by an unweighted count."""
    mean = weighted_sum / weight
    return (PRIOR_MEAN * PRIOR_WEIGHT + mean * n) / (n + PRIOR_WEIGHT)


def quality(avg: Column, wilson_: Column, n: Column) -> Column:
    """P3."""
    base = (avg - 1.0) / 4.0 * 0.6 + wilson_ * 0.4
    trust = 0.5 + 0.5 * F.least(F.lit(1.0), F.log10(n + 1.0) / 4.0)
    return F.when(avg.isNull() | n.isNull(), 0.5).otherwise(base * trust)


def engagement(hours: Column, active: Column, age_days: Column) -> Column:
    """P4."""
    base = F.least(F.lit(1.0), F.log10(hours + 1.0) / 2.0)
    fresh = F.when(age_days.isNotNull(), 0.2 * F.greatest(F.lit(0.0), 1.0 - age_days / 90.0)).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.when(active, 0.1).otherwise(0.0) + fresh)


def base_score(relevance: Column, quality_: Column, graph: Column, engagement_: Column) -> Column:
    """P5."""
    return relevance * 0.4 + quality_ * 0.25 + graph * 0.2 + engagement_ * 0.1


def ladder(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    out = F.lit(rest)
    for low, name in reversed(steps):
        out = F.when(x >= low, name).otherwise(out)
    return out


#: Least score of each grade.
GRADES = [(0.85, "A+"), (0.75, "A"), (0.65, "A-"), (0.55, "B+"), (0.45, "B")]


def grade(x: Column) -> Column:
    """P6."""
    return ladder(x, GRADES, "B-")


def browse_grade(avg: Column, n: Column) -> Column:
    """P7."""
    steps = F.when((avg >= 4.5) & (n >= 100), "A+").when(avg >= 4.2, "A").when(avg >= 4.0, "A-").when(avg >= 3.7, "B+").when(avg >= 3.4, "B").otherwise("B-")
    return F.when(avg.isNull() | n.isNull() | (n < 5), "B-").otherwise(steps)


def browse_confidence(n: Column) -> Column:
    """P7."""
    return F.least(F.lit(0.95), 0.6 + 0.1 * F.log10(F.greatest(n, F.lit(1)).cast("double")))


def popularity(read: Column, reading: Column, want: Column) -> Column:
    """P8."""
    return F.when(read + reading + want == 0, 0.0).otherwise(10.0 * F.log10(read + 0.8 * reading + 0.3 * want + 1.0))


def trending(read: Column, reading: Column, want: Column) -> Column:
    """P9."""
    return read + 0.5 * reading + 0.2 * want


def rating_multiplier(rating: Column) -> Column:
    """A doubling for each two stars from 3, and twice for 5."""
    return F.when(rating.isNull(), 1.0).otherwise(F.pow(F.lit(2.0), (rating - 3) / 2.0)) * F.when(rating == 5, 2.0).otherwise(1.0)


def event_weight(e: dict[str, Column], as_of: Column) -> Column:
    """P1. e: rating, finished_at, last_read_at, total_ms, completions, avg_minutes, max_minutes, last30_ms, author_works,
    days_since_previous, origin, shelf."""
    hours = F.coalesce(e["total_ms"], F.lit(0)) / 3_600_000.0
    many = F.coalesce(e["completions"], F.lit(0))
    avg, most = F.coalesce(e["avg_minutes"], F.lit(0.0)), F.coalesce(e["max_minutes"], F.lit(0.0))
    half_life = F.when((many >= 3) | (avg >= 15) | (most >= 120), 4.0).otherwise(2.0)
    when = F.coalesce(e["finished_at"], e["last_read_at"])
    years = F.greatest(F.lit(0.0), (F.unix_seconds(as_of) - F.unix_seconds(when.cast("timestamp"))) / (365.0 * 86400.0))
    recency = F.when(when.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), years / half_life))
    time = 1.0 + F.least(F.lit(1.0), F.log10(hours + 1.0))
    lately = F.when(F.coalesce(e["last30_ms"], F.lit(0)) > 0, 1.1).otherwise(1.0)
    again = F.when(many >= 2, F.least(F.lit(3.0), F.pow(F.lit(1.5), many - 1.0))).otherwise(1.0)
    long = (1.0 + F.least(F.lit(0.5), avg / 30.0)) * (1.0 + F.least(F.lit(0.5), most / 240.0))
    n = F.coalesce(e["author_works"], F.lit(0))
    loyal = F.when(n >= 3, F.least(F.lit(2.0), 1.0 + (n - 2) * 0.25)).otherwise(1.0)
    quick = F.when(e["days_since_previous"].between(0, 3), 1.3).otherwise(1.0)
    bought = F.when(e["origin"] == "Purchase", 1.15).otherwise(1.0)
    shelf = F.when(e["shelf"] == "read", 1.0).when(e["shelf"] == "currently-reading", 0.8).when(e["shelf"] == "to-read", 0.3)
    shelf = shelf.when((e["shelf"] == "dnf") & (hours >= 6), 0.0).when(e["shelf"] == "dnf", -0.5).otherwise(1.0)
    return rating_multiplier(e["rating"]) * recency * time * lately * again * long * loyal * quick * bought * shelf


def search_score(similarity: Column, title: Column, q: str) -> Column:
    """P11."""
    t = F.lower(title)
    return F.greatest(similarity, F.when(t.startswith(q.lower()), 0.9).otherwise(0.0), F.when(t.contains(q.lower()), 0.7).otherwise(0.0))


#: The texts of reasons.
REASON_ANCHOR = ('Similar to "', '" which you enjoyed')
REASON_MATCH = "Strongly matches your reading preferences"
REASON_RATED = "Highly rated by readers with similar taste"
REASON_OTHER = "Recommended based on your reading history"


def quick_reasons(anchor: Column, relevance: Column, quality_: Column) -> Column:
    """P12."""
    found = F.array(
        F.when(anchor.isNotNull(), F.concat(F.lit(REASON_ANCHOR[0]), anchor, F.lit(REASON_ANCHOR[1]))),
        F.when(relevance > 0.8, F.lit(REASON_MATCH)).when(quality_ > 0.7, F.lit(REASON_RATED)),
    )
    kept = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit(REASON_OTHER))).otherwise(kept)


#: P14. Confidence of each resolution path, and the least one that is no stub.
PATH_CONFIDENCE = {
    "isbn_ol": 0.98,
    "isbn_gb": 0.85,
    "isbn_local": 0.75,
    "gbid": 0.82,
    "title_gb": 0.80,
    "asin": 0.65,
    "royalroad": 0.60,
    "goodreads": 0.55,
    "manual": 0.40,
}
STUB_BELOW = 0.70
