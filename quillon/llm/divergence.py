"""Operator 11. Source divergence audit: distances between term distributions of sources, by inclusion-exclusion over supports.

Smoothed shares are p = 1 + floor(scale * (count + add) / (N + add * V)), so a term that a group lacks has the group's one
share p0. The distance sum |p - q| over all V terms of a language is split by which of two groups have the term:

- one-sided terms: a group's histogram of counts prices sum |p - q0| over its own terms, for every other group at once: the
  other groups' q0 are merged into the histogram in order, and running sums give each;
- terms of both: postings of a term, joined in memory, correct by |p - q| - |p - q0| - |p0 - q| + |p0 - q0|;
- terms of neither: a constant, (V - terms of one - terms of the other) * |p0 - q0|, which also offsets terms of both.

All sums are of whole numbers. Nothing is of the size terms x groups but the postings that occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import bounded_batches, materialize, small_side, with_partner

#: ASCII letters in lower case, bytes from 0x80 as they are, all others a space: on UTF-8 the runs of the pattern
#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: A task's counts go on to the shuffle when so many terms or bytes of text are behind them.
HELD_TERMS, HELD_BYTES = 200_000, 64 << 20
#: Groups of a language are compared in tiles of so many by as many; a tile's postings in shards of about so many.
TILE, SHARD_ROWS = 256, 50_000


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch], held_terms: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (rows with it), added up over many rows; a row of term '' for each group."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = read = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = list(docs)
            columns = [pa.array([lang] * len(found), pa.binary()), pa.array([source] * len(found), pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(x.cast(pa.string()) for x in columns), pa.array([n[x] for x in found], pa.int64()), pa.array(list(docs.values()), pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.large_binary()).to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            was, found = len(docs), terms(text)
            n.update(found)
            docs.update({b"", *found})
            size, read = size + len(docs) - was, read + len(text)
            if size > held_terms or read > HELD_BYTES:
                yield from flush()
                size = read = 0
    yield from flush()


def postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n (in the language), first (one source of each term has it), of terms in at least min_docs
    documents of their language; and a row of term '' for each group. docs: lang, source, text without nulls."""
    held = HELD_TERMS
    rows = bounded_batches(docs.select("lang", "source", "text")).mapInArrow(lambda batches: _count(batches, held), "lang string, source string, term string, n long, docs long")
    rows = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A row for each source at most stands behind a (lang, term).
    by = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"_docs": F.sum("docs").over(by), "lang_n": F.sum("n").over(by), "first": (F.col("source") == F.min("source").over(by)) & (F.col("term") != "")})
    return materialize(rows.where((F.col("term") == "") | (F.col("_docs") >= min_docs)).drop("docs", "_docs"), "divergence-postings")


def share(n: str | Column, total: str, v: str, scale: int, add: int) -> Column:
    """1 + floor(scale * (n + add) / (total + add * v)), exact for any counts; 0 where a language has no terms."""
    wide = lambda x: x.cast("decimal(20,0)")
    n = F.col(n) if isinstance(n, str) else n
    top, below = F.lit(scale).cast("decimal(10,0)") * wide(n + add), wide(F.nullif(F.col(total) + add * F.col(v), F.lit(0)))
    return F.coalesce(F.call_function("div", top, below) + 1, F.lit(0).cast("long"))


def groups_of(posted: DataFrame, scale: int, add: int) -> DataFrame:
    """A row for each group: lang, source, idx (its place in the language), total, support, v, lang_total, p0, tiles, shards."""
    each = posted.groupBy("lang", "source").agg(
        F.sum("n").alias("total"),
        F.count_if(F.col("term") != "").alias("support"),
        F.count_if("first").alias("_v"),
        F.coalesce(F.sum(F.when(F.col("first"), F.col("lang_n"))), F.lit(0)).alias("_n"),
    )
    # Of a row for each group; ids and sums of a language's groups.
    by = Window.partitionBy("lang")
    each = each.withColumns({"v": F.sum("_v").over(by), "lang_total": F.sum("_n").over(by), "idx": (F.row_number().over(by.orderBy("source")) - 1).cast("long"), "_k": F.count("*").over(by), "_posted": F.sum("support").over(by)})
    each = each.withColumns({"p0": share(F.lit(0).cast("long"), "total", "v", scale, add), "tiles": F.ceil(F.col("_k") / TILE).cast("int"), "shards": (F.col("_posted") / SHARD_ROWS).cast("int") + 1})
    return materialize(each.drop("_v", "_n", "_k", "_posted"), "divergence-groups")


def _both(key: tuple, table: pa.Table, tile: int) -> pa.Table:
    """Corrections for terms that two groups have, summed by pair; postings of one shard and tile. Postings of a term stand
    side by side in order of idx; those at distance 1, 2, ... within a term are taken at once."""
    across = key[1].as_py() != key[2].as_py()
    idx, p, p0 = (table[x].to_numpy() for x in ("idx", "p", "p0"))
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((idx, term))
    idx, p, p0, term = idx[order], p[order], p0[order], term[order]
    known, at = np.unique(idx, return_inverse=True)
    sums = np.zeros(len(known) ** 2, np.int64)
    for step in range(1, len(idx)):
        i = np.flatnonzero(term[step:] == term[:-step])
        if not len(i):
            break
        if across:
            i = i[idx[i] // tile != idx[i + step] // tile]
        a, b, a0, b0 = p[i], p[i + step], p0[i], p0[i + step]
        np.add.at(sums, at[i] * len(known) + at[i + step], np.abs(a - b) - np.abs(a - b0) - np.abs(a0 - b) + np.abs(a0 - b0))
    some = np.flatnonzero(sums)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(some), pa.string()), "lo": known[some // len(known)], "hi": known[some % len(known)], "value": sums[some]})


def corrections(shares: DataFrame) -> DataFrame:
    """lang, lo, hi, value: what terms of both groups of a pair add, by shards. A posting goes to the tiles of its block of
    groups; a term of every group meets in a task with 2 * TILE postings at most."""
    block = (F.col("idx") / TILE).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = shares.select("lang", "term", "idx", "p", "p0", block.alias("_own"), other.alias("_other"), F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"))
    rows = rows.select("lang", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), "shard", "term", "idx", "p", "p0")
    tile = TILE
    return rows.groupBy("lang", "a", "b", "shard").applyInArrow(lambda key, table: _both(key, table, tile), "lang string, lo long, hi long, value long")


def pairs_of(groups: DataFrame) -> DataFrame:
    """Every other group of each group's language (the result's own rows), met by blocks, so that no language is one task."""
    here = groups.select("lang", "source", "idx", "p0", "v", "support", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_block"))
    there = groups.select("lang", (F.col("idx") / TILE).cast("int").alias("_block"), F.col("idx").alias("idx2"), F.col("p0").alias("q0"), F.col("support").alias("support2"))
    return here.join(there, ["lang", "_block"]).where("idx <> idx2").drop("_block")


def distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, lo, hi (lo < hi), value: the distance of each pair of groups."""
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    asked = pairs_of(groups)
    none = {c: F.lit(None).cast("long") for c in ("idx", "idx2", "p0", "v", "support", "support2")}
    marks = histogram.select("lang", "source", F.col("p").alias("at"), "k", *(x.alias(c) for c, x in none.items())).unionByName(asked.select("lang", "source", F.col("q0").alias("at"), F.lit(0).cast("long").alias("k"), *none))
    by = Window.partitionBy("lang", "source")
    upto = by.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k, s = F.col("k"), F.col("k") * F.col("at")
    marks = marks.withColumns({"k_low": F.sum(k).over(upto), "s_low": F.sum(s).over(upto), "k_all": F.sum(k).over(by), "s_all": F.sum(s).over(by)})
    one_sided = F.expr("at * k_low - s_low + (s_all - s_low) - at * (k_all - k_low)")
    constant = F.when(F.col("idx") < F.col("idx2"), F.expr("(v - support - support2) * abs(p0 - at)")).otherwise(0)
    sides = marks.where("idx is not null").select("lang", F.least("idx", "idx2").alias("lo"), F.greatest("idx", "idx2").alias("hi"), (one_sided + constant).alias("value"))
    return sides.unionByName(corrections(shares)).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, add: int = 5, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) group of docs.

    Part `pair`: the sum of |p - q| over the language's terms for each other source (item). Part `term`: the terms of the group
    whose share is above the language's, with the excess, the `top` first. Ranks run from 1 by value descending, then item
    ascending. Null text, lang and source count as ''; a group without terms has rows of part pair only (value 0 in a language
    without terms), a language's only group none. Repeated rows count each; very long texts count whole; extra columns don't
    matter; an empty table gives no rows.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    posted = postings(docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text")), min_docs)
    groups = groups_of(posted, scale, add)
    n_groups = groups.count()
    words = posted.where("term <> ''")
    facts = groups.select("lang", "source", "idx", "total", "v", "lang_total", "p0", "tiles", "shards")
    if small_side(facts, n_groups) is not facts:
        shares = words.join(small_side(facts, n_groups), ["lang", "source"])
    else:  # more groups than are broadcast: postings of one are dealt by salts
        one = F.struct("lang", "source").alias("_group")
        shares = with_partner(words.select("*", one), "_group", "term", facts.select(one, *facts.columns[2:])).drop("_group")
    shares = shares.withColumns({"p": share("n", "total", "v", scale, add), "q": share("lang_n", "lang_total", "v", scale, add)})

    names = groups.select("lang", "source", "idx")
    name = lambda c, at: small_side(names.select("lang", F.col("source").alias(c), F.col("idx").alias(at)), n_groups)
    both = F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b"))))
    pairs = distances(shares, groups).select("lang", "value", both.alias("_")).select("lang", "value", "_.a", "_.b").join(name("source", "a"), ["lang", "a"]).join(name("item", "b"), ["lang", "b"])
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= top))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents: terms in at least 30 documents of a language, 50 terms a group."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
