"""A trigram index for titles (F5, F7, R18): stored postings by trigram, of which a search reads its own grams' rarest lists.

A posting is a row's id with the number of its grams. Postings are written by buckets of grams, sorted by gram, so a search
prunes files by bucket and row groups by gram; hot grams are spread over many files. Each list's length is stored beside
them. What a search takes from lists are candidates: the title itself decides.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scoring, text

BUCKETS = 32


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, path: str, id_col: str = "work_id", title: str = "title") -> None:
    """Write the postings of rows' titles (gram, id, n) and the grams' counts (gram, df). Null titles, and those without a letter
    or digit, have no postings."""
    grams = rows.select(F.col(id_col).cast("long").alias("id"), text.trigrams(title).alias("g"))
    posted = grams.select("id", F.size("g").alias("n"), F.explode("g").alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # By range of (bucket, gram, id): a hot gram's list goes to several files instead of one task.
    posted.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    posted.groupBy("bucket", "gram").agg(F.count("*").alias("df")).repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")


class Index:
    """Postings that build() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _of(self, what: str, grams: list[str]) -> DataFrame:
        """A table's rows of some grams; their buckets are literals, so other files are not listed."""
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"))).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/{what}").where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams))

    def lists(self, grams: list[str]) -> list[tuple[str, int]]:
        """Grams with the length of their lists, rarest first (0: not in the index)."""
        known = {r["gram"]: r["df"] for r in self._of("grams", grams).select("gram", "df").collect()} if grams else {}
        return sorted(((g, known.get(g, 0)) for g in set(grams)), key=lambda x: (x[1], x[0]))

    def postings(self, grams: list[str]) -> DataFrame:
        return self._of("postings", grams)


def grams_of(spark: SparkSession, q: str) -> list[str]:
    """The trigrams of a text, as the index has them."""
    return spark.range(1).select(text.trigrams(F.lit(q))).first()[0] or []


def similar_ids(index: Index, q: str, threshold: float) -> DataFrame:
    """id: candidates for a similarity of at least threshold to q. Of q's m grams such a title has at least threshold * m, so it
    has one of the m - ceil(threshold * m) + 1 rarest, whose lists are read; its own number of grams is within threshold * m
    and m / threshold."""
    lists = index.lists(grams_of(index.spark, q))
    m = len(lists)
    rare = [g for g, df in lists[: m - math.ceil(threshold * m - 1e-9) + 1] if df]
    if not rare:
        return index.spark.createDataFrame([], "id long")
    fits = (F.col("n") >= threshold * m - 1e-9) & (F.col("n") * threshold <= m + 1e-9)
    return index.postings(rare).where(fits).select("id").distinct()


def pattern_grams(pattern: str, escape: str = "\\") -> list[str]:
    """The trigrams that every text like a pattern (% any text, _ any character, escape before a literal one) must have: those of
    its literal words, without the padding where a wildcard touches a word. pattern: in lower case."""
    pieces: list[tuple[str, bool, bool]] = []  # literal run, whether a wildcard stands before it, after it
    run, open_, k = "", False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            run, k = run + pattern[k + 1], k + 2
            continue
        if c in "%_":
            pieces.append((run, open_, True))
            run, open_ = "", True
        else:
            run += c
        k += 1
    pieces.append((run, open_, False))
    out = set()
    for literal, before, after in pieces:
        words, start = [], None
        for at, c in enumerate([*literal, " "]):
            held = unicodedata.category(c)[0] in "LN"
            if held and start is None:
                start = at
            elif not held and start is not None:
                words.append((start, at))
                start = None
        for a, b in words:
            padded = ("" if before and a == 0 else "  ") + literal[a:b] + ("" if after and b == len(literal) else " ")
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return sorted(out)


def like_ids(index: Index, pattern: str, lists: int = 4, escape: str = "\\") -> DataFrame | None:
    """id: rows that hold the pattern's rarest grams (so many lists are read at most); None where the pattern has no gram, and
    every title must be looked at."""
    low = index.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    found = index.lists(pattern_grams(low, escape))
    if not found:
        return None
    if not found[0][1]:
        return index.spark.createDataFrame([], "id long")
    rare = [g for g, _ in found[:lists]]
    held = index.postings(rare)
    return held.select("id") if len(rare) == 1 else held.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") == len(rare)).select("id")


def matching(works: DataFrame, index: Index, pattern: str, id_col: str = "work_id", title: str = "title") -> DataFrame:
    """works whose title is like a pattern, whatever the case; `\\` before %, _ or itself stands for that character."""
    ids = like_ids(index, pattern)
    some = works if ids is None else works.join(ids, works[id_col] == ids["id"], "left_semi")
    return some.where(F.ilike(title, F.lit(pattern)))


def literal_pattern(q: str) -> str:
    """The pattern of texts that hold q as it is."""
    return "%" + "".join("\\" + c if c in "%_\\" else c for c in q) + "%"


def search(works: DataFrame, index: Index, q: str, threshold: float = 0.3) -> DataFrame:
    """Works whose title is like q (trigrams) or holds it, with similarity and score. Only candidates of the index
    are scored; a q without a gram looks at every title."""
    near, holds = similar_ids(index, q, threshold), like_ids(index, literal_pattern(q))
    some = works
    if holds is not None:
        ids = near.unionByName(holds).distinct()
        some = works.join(ids, works["work_id"] == ids["id"], "left_semi")
    rows = some.withColumn("similarity", F.coalesce(text.trigram_similarity("title", F.lit(q)), F.lit(0.0)))
    rows = rows.where((F.col("similarity") > threshold) | F.contains(F.lower("title"), F.lit(q.lower())))
    return rows.withColumn("score", F.round(scoring.search_score(F.col("similarity"), F.col("title"), q), 6))
