"""Operator 2. Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned by the principal axes of all of them, largest variance first; a rotation keeps
every cosine. A tree of median splits over the axes deals them to tiles of near vectors. Two tiles are compared only if
their boxes are near enough; their leading dimensions are multiplied first, then block after block of twice as many, and after
each the rest's product is bounded by the suffix norms: a pair goes on only while its cosine can still reach the threshold.
Pairs near the threshold are decided on the given vectors, all in double precision. Which tiles are near is found by a walk down the tree, level by level.

A task reads its tiles from the shared folder; no pair of rows is shuffled. Out come counts and the edges of a spanning
forest for each tile pair, never all links.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import components, filesystem, materialize, shared_dir, stars, with_partner

#: Rows of the sample that fits the tree of tiles; every row is dealt and compared.
TREE_SAMPLE = 200_000
#: Bytes of the vectors of a tile, about, of the tiles that a task keeps at hand, and of what it gathers of pairs at once.
TILE_BYTES, HELD_BYTES, GATHERED_BYTES = 8 << 20, 64 << 20, 16 << 20
#: While more than this share of pairs go on, blocks of dimensions are multiplied for all pairs.
DENSE = 0.25


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of double): the rows whose vector is not null, not zero and has finite components only."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            m = np.column_stack([x, np.ones(len(x))])
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})


def principal_axes(vectors: DataFrame) -> np.ndarray | None:
    """Columns: axes of all unit vectors by falling variance. A matrix for each partition is summed by Spark."""
    parts = vectors.select("v").mapInArrow(_moments, "m array<double>")
    rows = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toArrow()  # (dims + 1)^2 numbers
    if not rows.num_rows:
        return None
    m = np.zeros(rows.num_rows)
    m[rows["k"].to_numpy()] = rows["x"].to_numpy()
    d = math.isqrt(len(m))
    m = m.reshape(d, d)
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    values, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, np.argsort(-values)]


def _turn(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes


def split_tree(sample: np.ndarray, leaves: int, dims: int) -> list[tuple[int, float]]:
    """A complete binary tree of median splits: (axis, cut) of each inner node, in heap order; the axis is the widest of the
    leading dims."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    nodes: list[tuple[int, float]] = []
    level = [sample]
    for _ in range(depth):
        below = []
        for part in level:
            if len(part) < 2:
                nodes.append((0, 0.0))
                below += [part, part[:0]]
                continue
            lead = part[:, :dims]
            axis = int(np.argmax(lead.var(axis=0)))
            cut = float(np.median(lead[:, axis]))
            nodes.append((axis, cut))
            below += [part[lead[:, axis] < cut], part[lead[:, axis] >= cut]]
        level = below
    return nodes


def leaf_of(x: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    axes, cuts = np.array([a for a, _ in nodes], np.int64), np.array([c for _, c in nodes])
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (x[np.arange(len(x)), axes[at]] >= cuts[at])
    return at - len(nodes)


class Tile:
    """A tile's vectors, read from the shared folder."""

    def __init__(self, fs, path: str, lead: int):
        table = pq.read_table(path, filesystem=fs)
        self.ids = table.column("id").to_numpy()
        self.weight = table.column("copies").to_numpy()
        self.given = _matrix(table.column("v").combine_chunks())
        self.x = _matrix(table.column("x").combine_chunks())
        self.measure(lead)

    def measure(self, lead: int) -> None:
        """Dimensions are added up in blocks that double; suffix: lengths of what lies behind each block's end."""
        self.ends = block_ends(self.x.shape[1], lead)
        self.head = np.ascontiguousarray(self.x[:, : self.ends[0]], dtype=np.float32)
        squares = np.cumsum((self.x**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = [np.sqrt(squares[:, e]) if e < self.x.shape[1] else np.zeros(len(self.x)) for e in self.ends]
        self.bytes = self.given.nbytes + self.x.nbytes + self.head.nbytes


def block_ends(dims: int, lead: int) -> list[int]:
    """Ends of the blocks of dimensions: lead, 3 * lead, 7 * lead, ..., dims."""
    ends, width = [], lead
    while not ends or ends[-1] < dims:
        ends.append(min(dims, (ends[-1] if ends else 0) + width))
        width *= 2
    return ends


def near_tiles(tiles: DataFrame, depth: int, dims: int, reach: float, top: int = 8) -> DataFrame:
    """a, b: each pair of tiles (and each tile with itself) whose boxes are within reach, once.

    tiles: tile, leaf, low, high (corners of its box). The tree of splits is walked from level `top`, where all of its at
    most 2^top nodes are paired, down to the leaves: only the children of nodes within reach of each other go on. Boxes of
    inner nodes have the leading dims; two tiles are judged by all dimensions. No task holds all boxes.
    """
    corners = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(dims)]).alias(c)
    boxes = {depth: materialize(tiles.groupBy(F.col("leaf").alias("node")).agg(corners(F.min, "low"), corners(F.max, "high")), "vectors-nodes")}
    top = min(top, depth)
    for level in range(depth - 1, top - 1, -1):
        boxes[level] = materialize(boxes[level + 1].groupBy(F.shiftright("node", 1).alias("node")).agg(corners(F.min, "low"), corners(F.max, "high")), "vectors-nodes")

    def within(pairs: DataFrame, level: int) -> DataFrame:
        one, two = (boxes[level].select(F.col("node").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high")) for x in ("x", "y"))
        gap = sum((F.greatest(F.lit(0.0), F.col("x_low")[k] - F.col("y_high")[k], F.col("y_low")[k] - F.col("x_high")[k]) ** 2 for k in range(dims)), F.lit(0.0))
        return materialize(pairs.join(one, "x").join(two, "y").where(gap <= reach**2).select("x", "y"), "vectors-near")

    first = boxes[top].select(F.col("node").alias("x"), F.explode(F.sequence("node", F.lit((1 << top) - 1).cast("long"))).alias("y"))
    near = within(first, top)
    for level in range(top + 1, depth + 1):
        left = near.select(F.explode(F.array(2 * F.col("x"), 2 * F.col("x") + 1)).alias("x"), "y")
        near = within(left.select("x", F.explode(F.array(2 * F.col("y"), 2 * F.col("y") + 1)).alias("y")).where("x <= y"), level)
    one, two = (tiles.select(F.col("tile").alias(x), F.col("leaf").alias(y), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high")) for x, y in (("a", "x"), ("b", "y")))
    side = lambda lo, hi: F.zip_with(lo, hi, lambda p, q: F.greatest(F.lit(0.0), p - q))
    gaps = F.zip_with(side("a_low", "b_high"), side("b_low", "a_high"), lambda p, q: F.greatest(p, q))
    gap = F.aggregate(gaps, F.lit(0.0), lambda total, p: total + p * p)
    return near.join(one, "x").join(two, "y").where((F.col("x") < F.col("y")) | (F.col("a") <= F.col("b"))).where(gap <= reach**2).select("a", "b")


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a and j of b; GATHERED_BYTES of them are gathered at once, whatever their length."""
    rows = max(1, GATHERED_BYTES // (16 * max(1, a.shape[1])))
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[i[k : k + rows]], b[j[k : k + rows]]) for k in range(0, len(i), rows))])


def compare(a: Tile, b: Tile, threshold: float, same: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions i in a, j in b of the pairs with cosine >= threshold (i < j if a and b are one tile).

    The leading dimensions are multiplied in single precision with room for its error. Then products grow block by block, of
    all pairs while many go on, of the listed ones once few do; after each block those out of reach stop.
    """
    found_i, found_j = [], []
    for lo in range(0, len(a.ids), step):
        x, suffix = a.x[lo : lo + step], [s[lo : lo + step] for s in a.suffix]
        reach = lambda k, i, j: suffix[k][i] * b.suffix[k][j]  # noqa: B023, E731
        alive = a.head[lo : lo + step] @ b.head.T + suffix[0][:, None] * b.suffix[0][None, :] >= threshold - 1e-5
        if same:
            alive &= np.arange(lo, lo + len(x))[:, None] < np.arange(len(b.ids))[None, :]
        total, k, begun = None, 0, 0
        while k < len(a.ends) and np.count_nonzero(alive) > DENSE * alive.size:
            part = x[:, begun : a.ends[k]] @ b.x[:, begun : a.ends[k]].T
            total = part if total is None else total + part
            alive &= total + suffix[k][:, None] * b.suffix[k][None, :] >= threshold - 1e-9
            begun, k = a.ends[k], k + 1
        i, j = np.nonzero(alive)
        cos = np.zeros(len(i)) if total is None else total[i, j]
        for at in range(k, len(a.ends)):
            cos += dots(x[:, begun : a.ends[at]], b.x[:, begun : a.ends[at]], i, j)
            go = np.flatnonzero(cos + reach(at, i, j) >= threshold - 1e-9)
            i, j, cos, begun = i[go], j[go], cos[go], a.ends[at]
        near = np.flatnonzero(np.abs(cos - threshold) < 2e-9)
        if len(near):
            u, v = i[near] + lo, j[near]
            cos[near] = dots(a.given, b.given, u, v) / (np.sqrt(dots(a.given, a.given, u, u)) * np.sqrt(dots(b.given, b.given, v, v)))
        hit = cos >= threshold
        found_i.append(i[hit] + lo)
        found_j.append(j[hit])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each vector's numbers (-0.0 as 0.0) beside it."""
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0
        ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        keys = [hashlib.sha256(flat[lo:hi].tobytes()).digest() for lo, hi in itertools.pairwise(ends)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["id", "v", "key"])


def near_vectors(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", lead: int = 16, tile_rows: int = 1024, split_dims: int = 12, top: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of table.

    Links: pairs of vectors with cosine >= threshold in double precision. Vectors that are null, zero or hold null or
    non-finite components, and null ids, link with nothing. Equal vectors become one class first. Vectors of another length than most link
    only with their like (each length is compared on its own). Ids should be unique. Extra columns don't matter; an empty
    table gives an empty result.
    """
    spark = table.sparkSession
    valid = valid_vectors(table, id_col, vec_col)
    links, edges = [], []
    # Classes of equal vectors by their digests; a vector travels once, with the first of its copies that a task has.
    keyed = materialize(valid.mapInArrow(_digested, "id long, v array<double>, key binary"), "vectors-keyed")
    classes = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialize(classes, "vectors-classes")
    for (d,) in classes.select(F.size("v")).distinct().collect():  # lengths of vectors: one, or a few
        some = _compare_all(spark, classes.where(F.size("v") == d), threshold, lead, tile_rows, split_dims, top)
        links.append(some.where("v is null").select(F.col("u").alias("id"), "n"))
        edges.append(some.where("v is not null").select("u", "v"))
    out = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    if not links:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counted = links[0]
    joined = edges[0]
    for x, y in zip(links[1:], edges[1:], strict=True):
        counted, joined = counted.unionByName(x), joined.unionByName(y)
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(joined, "vectors")
    named = classes.join(counted, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    ids = with_partner(keyed.select("id", "key"), "key", "id", named).select("id", "n_links", "component_id")
    found = out.select("vec_id").join(ids.dropDuplicates(["id"]), F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _compare_all(spark, classes: DataFrame, threshold: float, lead: int, tile_rows: int, split_dims: int, top: int) -> DataFrame:
    """Rows (u, null, n): u has n links to other classes' vectors; rows (u, v, 0): edges that connect what is linked."""
    axes = principal_axes(classes)
    n = classes.count()
    share = min(1.0, 1.2 * TREE_SAMPLE / n)
    # The sample is fit on the driver: TREE_SAMPLE rows at most, by a hash of the id.
    picked = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("id", "v")
    lead, split_dims = min(lead, len(axes)), min(split_dims, len(axes))
    tile_rows = max(16, min(tile_rows, TILE_BYTES // (8 * len(axes))))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _turn(_matrix(batch.column(1)), axes)[:, :split_dims]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "x"])

    # Turned and cut to split_dims numbers on the executors.
    sample = _matrix(picked.mapInArrow(leading, "id long, x array<double>").orderBy(F.xxhash64("id")).limit(TREE_SAMPLE).toArrow()["x"].combine_chunks())
    nodes = split_tree(sample, math.ceil(n / tile_rows), split_dims)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _turn(_matrix(batch.column(2)), axes)
                arrays = [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), pa.array(leaf_of(x, nodes))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "copies", "v", "x", "leaf"])

    dealt = classes.select("id", "copies", "v").mapInArrow(deal, "id long, copies long, v array<double>, x array<double>, leaf long")
    path = shared_dir(spark, "vectors-tiles")
    kinds = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float64())), ("x", pa.list_(pa.float64()))])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by leaf to files of one leaf and at most 4 * tile_rows rows; their boxes come out."""
        import uuid

        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        held, at = [], None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).select(["id", "copies", "v", "x"]).cast(kinds)
            name = f"{uuid.uuid4().hex}.parquet"
            pq.write_table(t, f"{base}/{name}", filesystem=fs)
            x = _matrix(t.column("x").combine_chunks())
            return pa.RecordBatch.from_pydict({"tile": [name], "leaf": [int(at)], "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()]})

        for batch in batches:
            leaves = batch.column(4).to_numpy()
            cuts = np.flatnonzero(np.diff(leaves)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaves)], strict=True):
                for k in range(lo, hi, 4 * tile_rows):
                    part = batch.slice(k, min(4 * tile_rows, hi - k))
                    if held and (leaves[k] != at or sum(x.num_rows for x in held) + part.num_rows > 4 * tile_rows):
                        yield flush()
                        held = []
                    if part.num_rows:
                        at = leaves[k]
                        held.append(part)
        if held:
            yield flush()

    # A leaf has about tile_rows rows; ones far beyond that (sample error) are cut into several tiles.
    ordered = dealt.repartition("leaf").sortWithinPartitions("leaf", "id")
    tiles = materialize(ordered.mapInArrow(store, "tile string, leaf long, low array<double>, high array<double>"), "vectors-boxes")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    depth = int(math.log2(len(nodes) + 1))
    todo = materialize(near_tiles(tiles, depth, split_dims, reach, top), "vectors-pairs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        kept: dict[str, Tile] = {}

        def tile(name: str) -> Tile:
            if name not in kept:
                while kept and sum(x.bytes for x in kept.values()) > HELD_BYTES:
                    kept.pop(next(iter(kept)))
                kept[name] = Tile(fs, f"{base}/{name}", lead)
            return kept[name]

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = tile(x), tile(y)
                i, j = compare(a, b, threshold, x == y)
                if len(i):
                    one, two = np.bincount(i, b.weight[j], len(a.ids)), np.bincount(j, a.weight[i], len(b.ids))
                    p, q = np.flatnonzero(one), np.flatnonzero(two)
                    u, v = stars(a.ids[i], b.ids[j])
                    ids = np.concatenate([a.ids[p], b.ids[q], u])
                    n = np.concatenate([one[p], two[q], np.zeros(len(u))]).astype(np.int64)
                    ends = np.concatenate([np.zeros(len(p) + len(q), np.int64), v])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ends, mask=n > 0), pa.array(n)], ["u", "v", "n"])

    # Runs of pairs with one first tile stay together, so that a task reads few tiles.
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = todo.repartitionByRange(tasks, "a", "b").sortWithinPartitions("a", "b")
    return materialize(spread.mapInArrow(work, "u long, v long, n long"), "vectors-links")


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)
