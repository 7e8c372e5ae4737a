"""Operator 4. Quality rules, native: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Words and pairs of neighbouring words are hashed to buckets. Two multinomials over the buckets are counted, one of trusted
documents and one of all; a document's score is the mean over its n-grams of the log ratio of the two. The threshold is a
quantile of the scores of trusted documents that the target was not counted from, so every document is judged alike and
reruns agree. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import materialize, quantile_of, small_side

# Fixed values of the base rules.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Log ratios are whole numbers of 2^-30; scores are compared in whole steps of 1/10,000.
PARTS, STEPS = 1 << 30, 10_000


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _next(a: str, step: int):
    """Hash of each element with the one step after it (alone if there is none)."""
    return F.transform(F.col(a), lambda x, i: F.xxhash64(x, F.get(F.col(a), i + step)))


def _with_repeat_words(rows: DataFrame, h8: str) -> DataFrame:
    """rows with n_repeat_words: words in the windows whose hash occurs twice or more; h8: hashes of all windows by position.
    Each step is a column of its own, as a function's body is evaluated anew for every element."""
    pairs = F.sort_array(F.transform(F.col(h8), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct(h8)) < F.size(h8)
    rows = rows.withColumn("_pairs", F.when(twice, pairs))
    here = lambda k: F.get(F.col("_pairs"), k)["h"]
    marked = F.transform(F.col("_pairs"), lambda p, k: F.when((p["h"] == here(k - 1)) | (p["h"] == here(k + 1)), p["i"]))
    rows = rows.withColumn("_at", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(F.col("_at"), start, lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")))
    return rows.withColumn("n_repeat_words", F.coalesce(covered["total"], F.lit(0)).cast("long"))


def hashed(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep, words, w1 (hash of each word), w2 (of each word and the next)."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("w1", F.transform("words", lambda x: F.xxhash64(x)))
    return rows.withColumn("w2", _next("w1", 1))


def bucket(buckets: int) -> Column:
    """Bucket of an exploded hash `h` (after the explode, as generated code then does it)."""
    return F.pmod(F.col("h"), F.lit(buckets)).cast("int").alias("bucket")


def grams() -> Column:
    """Hashes of a document's words and pairs of neighbouring words (the last word has no pair)."""
    return F.concat("w1", F.slice("w2", F.lit(1), F.greatest(F.size("w2") - 1, F.lit(0))))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smooth: float = 1.0) -> DataFrame:
    """bucket, llr: log ratio (in PARTS) of the smoothed shares of each bucket in the trusted ids' documents and in all. docs:
    _id, _text. Counts are added up before the shuffle; a row for each bucket at most comes out."""
    marked = docs.join(small_side(trusted, trusted.count()), docs["_id"] == trusted["trusted_id"], "left")
    rows = hashed(marked.withColumn("_in", F.col("trusted_id").isNotNull().cast("long")), "_text", ["_in"])
    counts = rows.select("_in", F.explode(grams()).alias("h")).select("_in", bucket(buckets)).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_in").alias("target"))
    counts = materialize(counts, "rules-counts")
    total = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = (total[0] or 0) + smooth * buckets, (total[1] or 0) + smooth * buckets
    llr = F.log(((F.col("target") + smooth) / target) / ((F.col("raw") + smooth) / raw))
    return counts.select("bucket", F.round(llr * PARTS).cast("long").alias("llr"))


def base_measures(rows: DataFrame) -> DataFrame:
    """rows of hashed() with the base rules' measures."""
    text = F.coalesce("_text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"), "_lines": lines})
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    rows = rows.withColumn("_w4", _next("w2", 2))
    rows = rows.withColumn("_w8", F.slice(_next("_w4", 4), F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    return _with_repeat_words(rows, "_w8")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, quantile: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base measures, base_failed, score, kept for each row of docs.

    trusted: a column of ids whose documents are the target (null ids don't count). Even halves by crc32 of the id: the
    target is counted from one half, the threshold is the given quantile of the other half's scores. kept: the base rules
    hold and the score is not below the threshold; scores are compared in whole STEPS-ths. Ratios are added up as whole
    numbers and the quantile is exact, so rows don't depend on partitions. A null, empty or wordless text scores 0 and fails
    the base rules. Without trusted documents in either half only the base rules decide. Very long texts count whole, rows
    repeat as in docs, an empty table gives an empty result, and extra columns, whatever their names, don't matter.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted_id")).where("trusted_id is not null").distinct()
    half = F.pmod(F.crc32(F.col("trusted_id").cast("string").cast("binary")), F.lit(2))
    ids = materialize(ids.withColumn("half", half), "rules-trusted")
    llr = log_ratios(docs, ids.where("half = 0").select("trusted_id"), buckets)
    rows = base_measures(hashed(docs.withColumn("_row", F.monotonically_increasing_id()), "_text", ["_row", "_id"]))
    rows = rows.select("_row", "_id", *MEASURES, F.explode_outer(grams()).alias("h")).select("_row", "_id", *MEASURES, bucket(buckets))
    # The table of ratios has at most `buckets` rows, a parameter: it is broadcast.
    scored = rows.join(F.broadcast(llr), "bucket", "left").groupBy("_row", "_id", *MEASURES).agg(F.coalesce(F.sum("llr") / F.count("llr") / PARTS, F.lit(0.0)).alias("score"))
    scored = materialize(scored.drop("_row").withColumn("_step", F.floor(F.col("score") * STEPS)), "rules-scores")
    held = ids.where("half = 1").select("trusted_id")
    held = scored.join(small_side(held, held.count()), scored["_id"] == held["trusted_id"], "left_semi")
    # A bounded number of steps, however many documents.
    low = quantile_of(held.groupBy(F.col("_step").alias("step")).agg(F.count("*").alias("n")), [], quantile).first()[0]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = F.lit(True) if low is None else F.col("_step") >= F.lit(low)
    return scored.select(F.col("_id").alias(id_col), *MEASURES, failed.alias("base_failed"), "score", (~failed & good).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents against the documents labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return judge(docs, trusted)
