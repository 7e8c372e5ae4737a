"""An approximate index of vectors (V5c): an inverted file of lists by nearest centre, with product-quantised residuals.

A search reads a few lists: a request's product with a row is worked out from the row's code (one byte for each group of
dimensions), the best by codes are ranked again by their vectors. There are so many lists that each has about LIST_ROWS rows,
however many rows come. How many lists a search must read is measured when the index is fit, against the true neighbours
among all rows; where that would be more than a set share of all rows, the vectors have no structure that lists could use, and
the search compares with every row instead, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors
from quillon.operators.collaborative import keep_top

#: Rows of a list on average; SAMPLE_MOST / 8 lists at most.
LIST_ROWS = 4_096
#: Vectors that a fit takes at most.
SAMPLE_MOST = 100_000
#: Rows of a list that are scored in one group, and requests of it; longer ones are dealt to several.
SHARD, ASKED = 16_384, 16_384
#: The same where every row is compared.
EXACT_SHARD, EXACT_ASKED = 32_768, 65_536
#: Products that are held at once.
CELLS = 1 << 21


@dataclass
class Codebook:
    """What a search needs of the fit: centres (unit length), for each group of dimensions the values of its codes, the lists to
    read, and the share of the sample that these held."""

    centres: np.ndarray
    codes: np.ndarray  # groups x values x dimensions of a group
    probes: int
    share: float
    exact: bool

    @property
    def groups(self) -> int:
        return len(self.codes)


def _means(x: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """k means of rows (first k rows as a start); on the sphere if unit."""
    centres = x[: min(k, len(x))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        scale = np.linalg.norm(total, axis=1) if unit else np.bincount(own, minlength=len(centres)).astype(float)
        centres = np.where(scale[:, None] > 0, total / np.maximum(scale, 1e-12)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the centre at the least distance of each row."""
    half, step = 0.5 * (centres**2).sum(axis=1), max(1, CELLS // max(1, len(centres)))
    return np.concatenate([(x[k : k + step] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), step)] or [np.empty(0, np.int64)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow column (of one length, without nulls) as unit rows."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, centres: np.ndarray, k: int, id_col: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """The places in ids of a bounded number of sampled vectors x, and the list of each of their k nearest among all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rest = _rows(batch.column(1))
                sims = x @ rest.T
                own = batch.column(0).to_numpy(zero_copy_only=False)
                sims[ids[:, None] == own[None, :]] = -np.inf
                at = np.argpartition(-sims, min(k, len(rest)) - 1, axis=1)[:, :k]
                score = np.take_along_axis(sims, at, axis=1).ravel()
                good = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), at.shape[1])[good]), pa.array(_nearest(rest[at.ravel()], centres)[good]), pa.array(score[good]), pa.array(own[at.ravel()][good])], ["at", "list", "score", "other"])

    near = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    found = keep_top(near.mapInArrow(run, "at long, list long, score double, other long"), ["at"], [F.col("score").desc(), "other"], k).toArrow()
    return found["at"].to_numpy(), found["list"].to_numpy()


def fit(rows: DataFrame, lists: int, groups: int = 8, sample: int = 20_000, recall: float = 0.95, most: float = 0.1, k: int = 10, id_col: str = "work_id", vector: str = "embedding", seed: int = 7) -> Codebook:
    """Centres, codes and the number of lists to read, from a sample of the vectors by a hash of the id: `sample` of them, or 16 a
    list if that is more, SAMPLE_MOST at most. There are `lists` lists, or one for LIST_ROWS rows if that is more. 200 of the
    sample's vectors ask for their k nearest among all rows: as many lists are read as bring `recall` of them, in lists that hold
    at most the share `most` of the sample; else the index is `exact`. The driver gets the sample and the lists of those
    neighbours. Ids are whole numbers."""
    held = rows.where(F.col(vector).isNotNull())
    n = held.count()
    lists = min(max(lists, n // LIST_ROWS), SAMPLE_MOST // 8)
    sample = min(max(sample, 16 * lists), SAMPLE_MOST)
    part = min(1.0, 1.2 * sample / max(1, n))  # so that vectors of a part of the rows alone are looked at
    some = held.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 20)) < part * (1 << 20)).select(F.col(id_col).cast("long").alias(id_col), vector).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample).toArrow()
    if not some.num_rows:
        return Codebook(np.empty((0, 0)), np.empty((0, 0, 0)), 0, 1.0, True)
    x = _rows(some[vector].combine_chunks())
    centres = _means(x, lists, 10, True)
    own = _nearest(x, centres)
    groups = max(1, min(groups, x.shape[1]))
    width = -(-x.shape[1] // groups)
    rest = np.pad((x - centres[own])[:20_000], ((0, 0), (0, groups * width - x.shape[1])))
    codes = np.stack([_means(rest[:, g * width : (g + 1) * width], 256, 6, False) for g in range(groups)])
    asked = np.arange(0, len(x), max(1, len(x) // 200))[:200]
    order = np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    at, found = _neighbours(rows, some[id_col].to_numpy()[asked], x[asked], centres, k, id_col, vector)
    needed = place[at, found]  # the probe that brings each neighbour
    sizes = np.bincount(own, minlength=len(centres))
    for probes in range(1, len(centres) + 1):
        share = float(sizes[order[:, :probes]].sum(axis=1).mean() / len(x))
        if share > most or not len(needed):
            break
        if (needed < probes).mean() >= recall:
            return Codebook(centres, codes, probes, share, False)
    return Codebook(centres, codes, len(centres), 1.0, True)


def build(rows: DataFrame, book: Codebook, path: str, id_col: str = "work_id", vector: str = "embedding") -> DataFrame:
    """Every row with a vector in the list of its nearest centre: id, code, vector, list, shard; written by list, so that a
    search reads some lists, and of most of their rows the codes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1))
                own = _nearest(x, book.centres)
                width = book.codes.shape[2]
                rest = np.pad(x - book.centres[own], ((0, 0), (0, book.groups * width - x.shape[1])))
                code = np.column_stack([_nearest(rest[:, g * width : (g + 1) * width], book.codes[g]) for g in range(book.groups)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(own.astype(np.int32))], [id_col, vector, "code", "list"])

    kept = rows.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias(vector))
    dealt = kept.mapInArrow(run, f"{id_col} {dict(kept.dtypes)[id_col]}, {vector} array<double>, code binary, list int")
    salts = max(1, 4_096 // len(book.centres)) if len(book.centres) else 1  # so that there are few files, and some for a list of many rows
    dealt.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(min(64, salts)))).sortWithinPartitions("list", id_col).write.partitionBy("list").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _dealt(rows: DataFrame, name: str, each: int) -> DataFrame:
    """list and into how many groups of about `each` rows a list's rows are dealt."""
    return rows.groupBy("list").agg(((F.count("*") / each).cast("int") + 1).alias(name))


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row by products to nine digits, then by id, as the ranking has them."""
    k = min(k, sims.shape[1])
    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    at, col = np.nonzero(sims >= least[:, None] - 2e-9)
    order = np.lexsort((ids[col], -np.round(sims[at, col], 9), at))
    at, col = at[order], col[order]
    start = np.searchsorted(at, np.arange(len(sims)))
    keep = np.arange(len(at)) - start[at] < k
    return at[keep], col[keep]


def _scored(id_col: str, vector: str, k: int, ready, by_code: int = 0):
    """A cogroup's function: the k rows with the best product for each request of a group, requests in blocks of CELLS products.
    ready(key, rows): what gives the products of requests with codes; of these the by_code best are multiplied by vectors."""

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            ids, x = rows[id_col].to_numpy(), _rows(rows[vector].combine_chunks())
            coarse = ready(key, rows) if by_code and by_code < len(ids) else None
            step = max(1, CELLS // max(len(ids), by_code * x.shape[1]))
            for lo in range(0, asked.num_rows, step):
                part = asked.slice(lo, step).combine_chunks()
                q, own = _rows(part["asked_vector"].combine_chunks()), part["asked"].to_numpy()
                if coarse is None:
                    sims = q @ x.T
                    sims[own[:, None] == ids[None, :]] = -np.inf
                    at, col = _best(sims, ids, k)
                    other, score = ids[col], sims[at, col]
                else:
                    rough = coarse(q)
                    rough[own[:, None] == ids[None, :]] = -np.inf
                    some = np.argpartition(-rough, by_code - 1, axis=1)[:, :by_code]
                    sims = np.einsum("rkd,rd->rk", x[some], q)
                    sims[own[:, None] == ids[some]] = -np.inf
                    place = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(len(q)), place.shape[1])
                    other, score = ids[np.take_along_axis(some, place, axis=1).ravel()], np.take_along_axis(sims, place, axis=1).ravel()
                good = np.isfinite(score)
                out.append((own[at][good], other[good], score[good]))
        joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"asked": joined[0].astype(np.int64), id_col: joined[1].astype(np.int64), "score": joined[2]})

    return run


def search(index: DataFrame, asked: DataFrame, book: Codebook, k: int = 10, again: int = 10, id_col: str = "work_id", vector: str = "embedding") -> DataFrame:
    """asked, id_col, similarity: the k nearest rows of each asked vector (id_col, vector), itself left out, ties by id. Ids are
    whole numbers.

    Requests meet the codes of their lists, dealt by shards of SHARD rows and blocks of ASKED requests; in each the again * k best
    by codes are ranked by their vectors, which lie beside the codes. An exact book: every request meets every row, by shards.
    """
    asked = asked.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("asked"), F.col(vector).cast("array<double>").alias("asked_vector"))
    if book.exact:
        return exact(index, asked, k, id_col, vector)
    probes = book.probes

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                best = np.argsort(-(_rows(batch.column(1)) @ book.centres.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(batch.num_rows), best.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(best.ravel().astype(np.int32))], ["asked", "asked_vector", "list"])

    def coded(key: tuple, rows: pa.Table):
        """Products with the centre and, from tables by group and code, with the coded residuals."""
        code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        width = book.codes.shape[2]

        def products(q: np.ndarray) -> np.ndarray:
            wide = np.pad(q, ((0, 0), (0, book.groups * width - q.shape[1])))
            sims = np.repeat((q @ book.centres[key[0].as_py()])[:, None], len(code), axis=1)
            for g in range(book.groups):
                sims += (wide[:, g * width : (g + 1) * width] @ book.codes[g].T)[:, code[:, g]]
            return sims

        return products

    wanted = asked.mapInArrow(nearest, "asked long, asked_vector array<double>, list int")
    # A row for each list.
    sizes = F.broadcast(_dealt(index, "shards", SHARD).join(_dealt(wanted, "blocks", ASKED), "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    wanted = wanted.join(sizes, "list").select("list", every("shards").alias("shard"), place("asked", "blocks").alias("block"), "asked", "asked_vector")
    rows = index.join(sizes, "list").select("list", place(id_col, "shards").alias("shard"), every("blocks").alias("block"), F.col(id_col).cast("long").alias(id_col), "code", vector)
    by = ["list", "shard", "block"]
    found = rows.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(_scored(id_col, vector, k + 1, coded, again * k), f"asked long, {id_col} long, score double")
    best = keep_top(found, ["asked"], [F.round("score", 9).desc(), id_col], k + 1).select("asked", id_col)
    return _ranked(best.join(index.select(F.col(id_col).cast("long").alias(id_col), vector), id_col).join(asked, "asked"), k, id_col, vector)


def _ranked(pairs: DataFrame, k: int, id_col: str, vector: str) -> DataFrame:
    rows = pairs.select("asked", id_col, F.round(vectors.cosine(vector, "asked_vector"), 9).alias("similarity"))
    return keep_top(rows, ["asked"], [F.col("similarity").desc(), id_col], k)


def exact(rows: DataFrame, asked: DataFrame, k: int = 10, id_col: str = "work_id", vector: str = "embedding") -> DataFrame:
    """The same over all rows: shards of EXACT_SHARD rows meet blocks of EXACT_ASKED requests, a matrix product each, and give
    k + 1 candidates by the product to nine digits and the id. A task's memory hangs on neither number."""
    kept = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias(vector))
    shards, blocks = kept.count() // EXACT_SHARD + 1, asked.count() // EXACT_ASKED + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = kept.select("*", place(id_col, shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("*", place("asked", blocks).alias("block"), every(shards).alias("shard"))
    by = ["shard", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scored(id_col, vector, k + 1, None), f"asked long, {id_col} long, score double")
    best = keep_top(found, ["asked"], [F.round("score", 9).desc(), id_col], k + 1).select("asked", id_col)
    return _ranked(best.join(kept, id_col).join(asked, "asked"), k, id_col, vector)
