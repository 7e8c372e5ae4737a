"""Operator 6. Quality classifier: interpolated modified Kneser-Ney character n-grams of trusted text.

A text is one stream of characters, a blank between words, so contexts run over word borders and order and repetition of
words count. The n-grams of trusted texts are counted and summed by shards; the lower orders count distinct left neighbours.
To score, the distinct n-grams of each block of an input file's rows are joined with the sharded counts, order by order, and
the answers are written next to each other for that block; the scan of the documents then reads its own blocks' answers. So
texts are never shuffled, and no task or driver holds the whole model. A document's perplexity is judged by a quantile of
its language's trusted documents that the model was not trained on.

Probabilities are added up as whole numbers of 2^-36, counts and quantiles are exact, so rows don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import ascii_words, bounded_batches, claim, filesystem, materialize, quantile_of, release, shared_dir, small_side

PAD = "\x02"  # stands before a text
#: Log probabilities and steps of log perplexity are whole numbers of these parts.
LP_PARTS, STEPS = 1 << 36, 10_000
#: Characters that are worked on at once; longer texts go piece by piece.
PIECE = 1 << 20


def stream(text: str | None, order: int) -> str:
    """The characters that a text's n-grams are of: words with a blank after each, behind the padding; none without words.
    A control character 2 in a text is left out, as it is the padding."""
    words = ascii_words(text.replace(PAD, "")) if text else []
    return PAD * (order - 1) + " ".join(words) + " " if words else ""


def codes_of(text: str, order: int) -> np.ndarray:
    """64-bit codes of the n-grams of a string, one for each of its windows of `order` characters."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(chars) - order + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += chars[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pieces_of(texts: list[str | None], order: int) -> Iterator[tuple[str, list[int], list[int]]]:
    """Runs of streams of about PIECE characters: the characters, the texts that they are of, and where each starts. A long
    stream is cut; each further part repeats the order - 1 characters that its first n-grams need."""
    held, owner, start, size = [], [], [], 0
    for k, text in enumerate(texts):
        s = stream(text, order)
        for lo in range(0, max(0, len(s) - order + 1), PIECE):
            part = s[lo : lo + PIECE + order - 1]
            held.append(part)
            owner.append(k)
            start.append(size)
            size += len(part)
            if size >= PIECE:
                yield "".join(held), owner, start
                held, owner, start, size = [], [], [], 0
    if held:
        yield "".join(held), owner, start


def inside(size: int, start: list[int], order: int) -> np.ndarray:
    """Which of the windows of a run's characters lie within one stream."""
    good = np.ones(max(0, size - order + 1), bool)
    for k in range(1, order):
        good[np.array(start[1:], np.int64) - k] = False
    return good


def count_grams(trusted: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """gram, n: occurrences of each n-gram of the highest order in the texts, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("perplexity", lambda: None)
        for batch in batches:
            for text, _, start in pieces_of(batch.column(0).to_pylist(), order):
                good = np.flatnonzero(inside(len(text), start, order))
                _, first, n = np.unique(codes_of(text, order)[good], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([text[k : k + order] for k in good[first].tolist()], pa.string()), pa.array(n)], ["gram", "n"])
        release()

    return bounded_batches(trusted.select(text_col)).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _orders(top: DataFrame, order: int) -> dict[int, DataFrame]:
    """Counts of every order: below the highest, the number of distinct left neighbours."""
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"kn-order{k}")
    return tables


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and above from the counts of counts."""
    n = {int(r[0]): r[1] for r in table.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def probabilities(requests: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """gram, lp (natural log, in LP_PARTS) of each requested n-gram of the highest order, interpolated down to the uniform
    distribution. Each order is two joins by key with the sharded counts."""
    order = max(tables)
    kinds = tables[1].count() + 1  # characters known, and one for all others
    asked = {order: requests.select("gram")}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(tables[k])
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        freed = ones * d1 + twos * d2 + (F.count("*") - ones - twos) * d3
        context = tables[k].groupBy(F.substring("gram", 1, k - 1).alias("ctx")).agg(F.sum("n").alias("total"), freed.alias("freed"))
        rows = asked[k].join(tables[k].select("gram", "n"), "gram", "left").withColumn("ctx", F.substring("gram", 1, k - 1)).join(context, "ctx", "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / kinds))
        else:
            rows = rows.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
        own = F.coalesce((F.col("n") - d) / F.col("total"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(own + F.col("freed") / F.col("total") * F.col("below"))
        lower = materialize(rows.select("gram", p.alias("p")), f"kn-p{k}")
    return lower.select("gram", F.round(F.log("p") * LP_PARTS).cast("long").alias("lp"))


def _distinct_grams(order: int):
    """file, block, gram: the n-grams of each block of rows, once for a task that reads of it. Codes are worked out anew where
    they are needed, as they would be most of what is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("perplexity", lambda: None)
        at, seen = None, np.empty(0, np.uint64)
        for batch in batches:
            for key, lo, hi in _runs(batch):
                if key != at:
                    at, seen = key, np.empty(0, np.uint64)
                for text, _, start in pieces_of(batch.column(2).slice(lo, hi - lo).to_pylist(), order):
                    good = np.flatnonzero(inside(len(text), start, order))
                    codes = codes_of(text, order)[good]
                    first = np.flatnonzero(~pd.Series(codes).duplicated().to_numpy())
                    codes, good = codes[first], good[first]
                    if len(seen):
                        new = seen[np.minimum(np.searchsorted(seen, codes), len(seen) - 1)] != codes
                        codes, good = codes[new], good[new]
                    seen = np.sort(np.concatenate([seen, codes]))
                    grams = pa.array([text[k : k + order] for k in good.tolist()], pa.string())
                    n = len(codes)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), grams], ["file", "block", "gram"])
        release()

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows of one file and block (the first two columns)."""
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    lo = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or files[k] != files[lo] or blocks[k] != blocks[lo]:
            yield (files[lo], blocks[lo]), lo, k
            lo = k


class _Answers:
    """The answers for one block: a hash index of codes and their log probabilities."""

    def __init__(self, fs, folder: str, order: int):
        t = pq.read_table(folder, filesystem=fs, columns=["gram", "lp"], partitioning=None)
        parts = [codes_of("".join(c.to_pylist()), order)[::order] for c in t.column("gram").chunks if len(c)]
        codes, lp = np.concatenate(parts or [np.empty(0, np.uint64)]).view(np.int64), t.column("lp").to_numpy()
        codes, first = np.unique(codes, return_index=True)
        self.index, self.lp = pd.Index(codes), lp[first]

    def total(self, texts: list[str | None], order: int) -> tuple[list[int], list[int]]:
        """Summed log probabilities of each text's n-grams, and their numbers."""
        sums, sizes = [0] * len(texts), [0] * len(texts)
        for text, owner, start in pieces_of(texts, order):
            good = inside(len(text), start, order)
            lp = self.lp[self.index.get_indexer(codes_of(text, order)[good].view(np.int64))]
            ends = [*start[1:], len(text)]
            counts = [e - s - order + 1 for s, e in zip(start, ends, strict=True)]
            each = np.add.reduceat(lp, np.concatenate([[0], np.cumsum(counts)[:-1]]))
            for k, x, n in zip(owner, each.tolist(), counts, strict=True):
                sums[k] += x
                sizes[k] += n
        return sums, sizes


def _placed(docs: DataFrame, block_rows: int) -> tuple[DataFrame, list[Column]]:
    """docs, read from files with row numbers, and the columns file and block of its rows. Rows that don't come straight
    from such files are written to the shared folder first."""
    place = [F.md5(F.col("_metadata.file_path")).alias("_file"), F.floor(F.col("_metadata.row_index") / block_rows).alias("_block")]
    if docs.inputFiles():
        try:
            docs.select(*place)
            return docs, place
        except AnalysisException:  # files without row numbers, or rows that were joined or grouped
            pass
    return materialize(docs, "kn-documents"), place


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1 << 16) -> DataFrame:
    """id and perplexity (a character; null without words) for each row of docs under the model of trusted's texts. docs'
    other columns follow. A task holds the distinct n-grams of one block of block_rows rows of a file, whatever the file's
    size and splits. Codes of n-grams are 64 bits: two of a block's fall together with a probability of about their number's
    square over 2^65."""
    spark = docs.sparkSession
    docs, place = _placed(docs, block_rows)
    tables = _orders(materialize(count_grams(trusted, order, text_col), f"kn-order{order}"), order)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    asked = bounded_batches(docs).select(*place, F.col(text_col).alias("_text")).mapInArrow(_distinct_grams(order), "file string, block long, gram string")
    asked = materialize(asked, "kn-asked")
    lp = probabilities(asked.select("gram").distinct(), tables)
    path = shared_dir(spark, "kn-answers")
    asked.join(lp, "gram").select("file", "block", "gram", "lp").repartition("file", "block").write.partitionBy("file", "block").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        claim("perplexity", lambda: None)
        at, answers = None, None
        for batch in batches:
            for key, lo, hi in _runs(batch):
                part = batch.slice(lo, hi - lo)
                texts = part.column(2).to_pylist()
                if key != at and any(stream(x, 1) for x in texts):
                    answers = None
                    at, answers = key, _Answers(fs, f"{base}/file={key[0]}/block={key[1]}", order)
                sums, sizes = answers.total(texts, order) if key == at else ([0] * len(texts), [0] * len(texts))
                out = [float(np.exp(min(700.0, -x / n / LP_PARTS))) if n else None for x, n in zip(sums, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(out, pa.float64())], [*part.schema.names[3:], "perplexity"])
        answers = None
        release()

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(id_col, *others).dtypes)
    return docs.select(*place, F.col(text_col).alias("_text"), id_col, *others).mapInArrow(run, f"{fields}, perplexity double")


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = 5, quantile: float = 0.993, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, perplexity, threshold, kept for each row of docs.

    The model is trained on half of the trusted documents (by crc32 of the id). The threshold of a language is the quantile
    of the other half's perplexities (of their logs, in whole STEPS-ths, rounded up; of a few, their largest). Languages without
    trusted documents there, and null, take that of all.
    kept: the perplexity is not above it. Null, empty and wordless texts have none and are not kept. Without trusted
    documents all texts with words are kept. Very long texts count whole. Rows repeat as in docs, equal perplexities are
    judged alike; an empty table gives an empty result; extra columns, whatever their names, don't matter.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = materialize(ids.withColumn("half", F.pmod(F.crc32(F.col("trusted_id").cast("string").cast("binary")), F.lit(2))), "kn-trusted")
    n = ids.count()
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col))
    one = ids.where("half = 0")
    train = rows.join(small_side(one, n), rows[id_col] == one["trusted_id"], "left_semi")
    seen = materialize(perplexities(rows, train, order, id_col, text_col), "kn-scores")
    two = ids.where("half = 1")
    held = seen.join(small_side(two, n), seen[id_col] == two["trusted_id"], "left_semi").where("perplexity is not null")
    # Steps are a bounded number, however many documents there are, so exact quantiles come from a small table.
    steps = materialize(held.groupBy(F.col(lang_col).alias("_lang"), F.ceil(F.log("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n")), "kn-steps")
    each = quantile_of(steps, ["_lang"], quantile)
    whole = quantile_of(steps.groupBy("step").agg(F.sum("n").alias("n")), [], quantile).first()[0]
    # A row for each language.
    limits = each.where("_lang is not null").select("_lang", "limit")
    found = seen.join(F.broadcast(limits), seen[lang_col] == limits["_lang"], "left")
    limit = F.exp(F.coalesce(F.col("limit"), F.lit(whole).cast("double")) / STEPS)
    good = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return found.select(id_col, lang_col, "perplexity", limit.alias("threshold"), good.alias("kept"))


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """docs' rows whose id classify() keeps, as they are (a null id goes with the rows of null ids)."""
    kept = classify(docs, trusted_ids, id_col=id_col, **more).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    kept = materialize(kept, "kn-kept")
    side = small_side(kept, kept.count())
    return docs.join(side, docs[id_col].eqNullSafe(side["_kept_id"]), "left_semi")


def op6_perplexity(spark, sf_dir: str) -> DataFrame:
    """All documents against those labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return classify(docs, trusted)
