"""Operator 13. Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A relational pipeline over words: words are exploded, rows are grouped by (document, word) and then by document for totals
and distinct words; the other filters' flags are joined, and one aggregate of 32 conditional counts a part (one for each set
of failed filters) answers all 120 orders.

A document is whole within an Arrow batch, so explode and both groupings run batch by batch by Arrow's kernels, next to the
scan: neither texts nor words are shuffled. What is shuffled are digests, flags and a row of counts for each part and task.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import bounded_batches, materialize, with_partner

FILTERS = "ABCDE"
#: Sets of failed filters, one bit a filter.
SETS = 1 << len(FILTERS)


def word_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text: explode, group by (document, word), group by document. Words are runs of other
    than ASCII white space."""
    words = pc.ascii_split_whitespace(text)
    pairs = pa.table({"doc": pc.list_parent_indices(words), "word": pc.list_flatten(words)})
    pairs = pairs.filter(pc.not_equal(pairs["word"], ""))
    by_word = pairs.group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")])
    by_doc = by_word.group_by("doc", use_threads=False).aggregate([([], "count_all"), ("count_all", "sum")])
    totals, distinct = np.zeros((2, len(text)), np.int64)
    at = by_doc["doc"].to_numpy()
    totals[at], distinct[at] = by_doc["count_all_sum"].to_numpy(), by_doc["count_all"].to_numpy()
    return totals, distinct


def upper_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Characters A-Z between neighbouring offsets of UTF-8 data."""
    upto = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.fill_null(batch.column(3).cast(pa.large_string()), "")
        words, distinct = word_counts(text)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        raw = memoryview(text.buffers()[2] or b"")[first:last]
        at = offsets - first
        digests = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(at.tolist())]
        columns = [*batch.columns[:3], words, distinct, upper_counts(at, np.frombuffer(raw, np.uint8)), pc.utf8_length(text), pc.match_substring_regex(text, "[#$%&*|]"), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["_row", "_id", "_part", "n_words", "n_distinct", "n_upper", "n_chars", "symbol", "digest"])


def measured(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """_row (unique), _id, _part (null: ''), the five filters' measures and the text's SHA-256 of each row, by one scan."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.col(text_col).alias("_text"))
    return bounded_batches(rows).mapInArrow(_measures, "_row long, _id long, _part string, n_words long, n_distinct long, n_upper long, n_chars long, symbol boolean, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with `copy`: whether a row of a smaller _id has the same digest. Smallest ids are taken by digest before the shuffle,
    and go back by salted joins, so a text that a third of all rows have is dealt out."""
    first = rows.groupBy("digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_first")
    return with_partner(rows, "digest", "_row", first, how="left").withColumn("copy", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))).drop("_first")


def flagged(docs: DataFrame, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """_row, _id, _part, n_words, n_distinct and `failed`, the set of filters that each row fails (bit 0: A ... bit 4: E).

    A: under min_words words; B: 100 * distinct words < distinct_percent * words; C: 100 * characters A-Z > upper_percent *
    code points; D: any of #$%&*|; E: a row of a smaller id has the same text, in any part. A null text counts as empty and
    fails A (and E behind another empty one); a null id is never a copy and makes none; rows of one id and text are no copies
    of each other. Very long texts count whole. Columns of other names don't matter. An empty table gives no rows.
    """
    rows = with_copies(materialize(measured(docs, id_col, part_col, text_col), "audit-measures"))
    fails = [
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        100 * F.col("n_upper") > upper_percent * F.col("n_chars"),
        F.col("symbol"),
        F.col("copy"),
    ]
    return rows.select("_row", "_id", "_part", "n_words", "n_distinct", sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0)).alias("failed"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether a label row of the id has quality 1, toxic 1. Rows of null ids have neither and skip
    the join, which would bring them together."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.where("_id is not null").join(one, "_id", "left").select(*rows.columns, "good", "toxic")
    joined = joined.unionByName(rows.where("_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    return joined.fillna(False, ["good", "toxic"])


def set_counts(rows: DataFrame) -> DataFrame:
    """_part and, for each of rows, good rows and toxic rows, an array of SETS counts by set of failed filters: one aggregate of
    conditional counts, added up before the shuffle."""
    one = lambda m, also: F.count_if((F.col("failed") == m) & also)
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = rows.groupBy("_part").agg(*(one(m, also).alias(f"{k}_{m}") for k, also in kinds.items() for m in range(SETS)))
    return wide.select("_part", *(F.array(*(f"{k}_{m}" for m in range(SETS))).alias(k) for k in kinds))


def _over(counts: str, holds) -> Column:
    """Sum of an array of counts over the sets that hold."""
    return F.aggregate(F.transform(F.col(counts), lambda n, m: F.when(holds(m), n).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, n: a + n)


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """filter_order, step, bit of the step's filter, set of the filters before it: for every order."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        for step, f in enumerate(order):
            out.append(("".join(filters[x] for x in order), step + 1, 1 << f, sum(1 << x for x in order[:step])))
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """set_counts() to a row for each part, order and step. What a step does hangs on its filter and the set of those before it
    only: 80 such cases a part are worked out and then joined to the 600 steps (a fixed table)."""
    cases = sorted({(bit, before) for _, _, bit, before in orders()})
    each = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in cases))).alias("case")
    rows = counts.select("*", each).select("_part", "n", "good", "toxic", "case.*")
    has, clear = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: has(m) & clear(m)
    # How many of all orders have exactly these filters before this one.
    size = F.bit_count("before")
    ways = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), size + 1)
    rows = rows.select(
        "_part", "bit", "before", ways.alias("ways"),
        _over("n", lambda m: ~has(m) & clear(m)).alias("kept"),
        _over("n", removed).alias("removed"),
        _over("n", lambda m: has(m) & ~clear(m)).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"),
        _over("good", removed).alias("good_lost"),
        _over("toxic", removed).alias("toxic_lost"),
    )
    shapley = rows.groupBy("_part", "bit").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    steps = counts.sparkSession.createDataFrame(orders(), "filter_order string, step int, bit int, before int")
    return rows.drop("ways").join(shapley, ["_part", "bit"]).join(F.broadcast(steps), ["bit", "before"]).drop("bit", "before")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text", **limits: int) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (flagged() has the
    filters and their limits): 600 rows for each value of part_col, null as ''.

    labels: doc_id, quality, toxic; an id with several rows is good or toxic if one of them says so. Empty documents: no rows.
    """
    rows = with_labels(flagged(docs, id_col=id_col, part_col=part_col, text_col=text_col, **limits), labels)
    return interactions(materialize(set_counts(rows), "audit-counts")).withColumnRenamed("_part", "part")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents, five filters, 120 orders."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    out = audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
