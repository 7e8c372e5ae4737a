"""Operator 3. MinHash near-dedup with tensored banding and exact verification.

Two small collections of hashes, each of `rows` minima, are computed for every document; a table's key is a pair, one hash
of either collection. With a and b hashes there are a*b tables of 2*rows minima each, for (a+b)*rows minima computed.
Documents that share a key are candidates; a link is a candidate pair whose full shingle sets are similar enough.

Equal sets become one class first. Then each class is verified against the best of its buckets' smallest members, the
links' components are formed, and only what shares a bucket but not yet a component goes on. Sketches (all minima) tell which of
these pairs can be similar enough; such pairs only join clusters, they are never emitted. Within a cluster every pair of
different components that the sketches let pass is verified on full sets. Buckets and clusters of any size are cut into
blocks that meet block by block, so no task holds a whole one, and a task gives the edges of a forest, not all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import CACHED_LENGTH, bounded_batches, claim, components, materialize, release, small_side, stars, with_partner

#: Distinct words whose hashes a worker keeps.
WORD_CACHE = 200_000


class _Words(dict):
    """Word to 64-bit hash; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) > WORD_CACHE:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text in UTF-8, A-Z lower-cased, words parted by ASCII white
    space. Fewer words than n: the whole sequence as one. No word: none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    m = min(n, len(words))
    key = _odd_numbers(n, 5)
    total = np.full(len(words) - m + 1, m, np.uint64)
    for k in range(m):
        total = total * key[k] + h[k : len(words) - m + 1 + k]
    return np.unique(_mix(total))


def minima(items: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """count minima of random functions of the items, 32 bits each."""
    a, b = _odd_numbers(count, seed), _odd_numbers(count, seed + 1)
    out = np.empty(count, np.uint32)
    for k in range(count):
        out[k] = ((items * a[k] + b[k]).min()) >> np.uint64(32)
    return out


def needed_matches(threshold: float, count: int, miss: float = 1e-6) -> int:
    """The most equal minima of count that a pair at the threshold has with a probability of all but miss."""
    total = 0.0
    for k in range(count + 1):
        total += math.comb(count, k) * threshold**k * (1 - threshold) ** (count - k)
        if total > miss:
            return k
    return count


def _table_keys(sig: np.ndarray, a: int, b: int, rows: int) -> np.ndarray:
    """64-bit keys of the a*b tables of each signature (one a row)."""
    weights = _odd_numbers(rows, 9)
    parts = (sig.reshape(len(sig), a + b, rows).astype(np.uint64) * weights).sum(axis=2)
    parts = _mix(parts + np.arange(a + b, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    keys = parts[:, :a, None] * np.uint64(0xA24BAED4963EE407) + parts[:, None, a:]
    return _mix(keys.reshape(len(sig), a * b)).view(np.int64)


def signatures(docs: DataFrame, n: int, count: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (128-bit digest of the set; null if empty), sig binary of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash", _words.clear)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                sizes, d1, d2, sigs = [], [], [], []
                for text in batch.column(1):
                    s = shingles(text.as_py(), n)
                    sizes.append(len(s))
                    if len(s):
                        h = xxhash.xxh3_128_digest(s.tobytes())
                        d1.append(int.from_bytes(h[:8], "little", signed=True))
                        d2.append(int.from_bytes(h[8:], "little", signed=True))
                        sigs.append(minima(s, count).tobytes())
                    else:
                        d1.append(None), d2.append(None), sigs.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])
        release()

    return bounded_batches(docs).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _keyed(classes: DataFrame, a: int, b: int, rows: int) -> DataFrame:
    """key, id: a row for each class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4000):
                batch = whole.slice(k, 4000)
                if batch.num_rows:
                    sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                    keys = _table_keys(sig, a, b, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of equal (key, low, high) of sorted rows: these, and the columns' values. A run is two blocks, of bounded rows."""
    at, held = None, None
    for batch in batches:
        names = batch.schema.names
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:3] != at:
                if held:
                    yield at, held
                at, held = row[:3], {x: [] for x in names}
            for x, v in zip(names, row, strict=True):
                held[x].append(v)
    if held:
        yield at, held


def _possible(group: dict, at: tuple, matches: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Position i of a group's row and those of the others, of another component, that can be similar enough by their sizes
    and minima."""
    comp, n, block = (np.array(group[x]) for x in ("comp", "n", "block"))
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(comp), -1)
    left, right = np.flatnonzero(block == at[1]), np.flatnonzero(block == at[2])
    for i in left.tolist():
        j = right[right > i] if at[1] == at[2] else right
        j = j[(comp[j] != comp[i]) & (den * np.minimum(n[j], n[i]) >= num * np.maximum(n[j], n[i]))]
        if len(j):
            j = j[(sig[j] == sig[i]).sum(axis=1) >= matches]
        if len(j):
            yield i, j


def _candidates(matches: int, num: int, den: int):
    """id, comp, top of the rows of a group that have a possible partner: edges comp-top connect the components of possible pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in _groups(batches):
            ids, comp = np.array(group["id"]), np.array(group["comp"])
            found = [(np.full(len(j), i), j) for i, j in _possible(group, at, matches, num, den)]
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                rows = np.unique(np.concatenate([i, j]))
                node, low = stars(comp[i], comp[j])
                place = np.minimum(np.searchsorted(node, comp[rows]), len(node) - 1)
                top = np.where(node[place] == comp[rows], low[place], comp[rows])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[rows], comp[rows], top)], ["id", "comp", "top"])

    return run


def _similar(matches: int, num: int, den: int, shingle: int):
    """Edges a, b that connect the components of a group's rows whose full sets are similar enough. Components that links
    join within the group count as one from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in _groups(batches):
            sets = [shingles(x, shingle) for x in group["text"]]
            size = np.array([len(x) for x in sets])
            top: dict[int, int] = {}

            def root(x: int) -> int:
                while x in top:
                    x = top[x]
                return x

            comp, out = group["comp"], []
            for i, js in _possible(group, at, matches, num, den):
                own = root(comp[i])
                js = [j for j in js.tolist() if root(comp[j]) != own]
                for k in range(0, len(js), 256):
                    some = [j for j in js[k : k + 256] if root(comp[j]) != root(comp[i])]
                    if not some:
                        continue
                    flat = np.concatenate([sets[j] for j in some])
                    place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                    ends = np.cumsum(size[some])
                    both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.concatenate([[0], ends[:-1]]))
                    for j in np.array(some)[den * both >= num * (size[i] + size[some] - both)].tolist():
                        a, b = root(comp[i]), root(comp[j])
                        if a != b:
                            out.append((comp[i], comp[j]))
                            top[max(a, b)] = min(a, b)
            if out:
                yield _pairs(out)

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, size of the key's group, id, ...) dealt to pairs of blocks of a group: key, low, high, block, id, ..."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    rest = [c for c in rows.columns if c not in ("key", "size")]
    rows = rows.select("key", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), *rest, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *rest)


#: Shingles of a usual row: blocks of rows are made smaller where rows have more on average.
ROW_SHINGLES = 1_000


def _pairs(out: list) -> pa.RecordBatch:
    a = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int, label: str) -> DataFrame:
    """Pairs a, b whose full sets have den * intersection >= num * union.

    Pairs are dealt by (a, salt), a salt for each 200 of a's pairs; a's text comes first in its group, so a task holds one
    set and compares the others as they pass.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / 200).cast("int").alias("salts"))
    dealt = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = dealt.join(texts, dealt["b"] == texts["id"]).select("a", "salt", "b", "text")
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts, F.col("a") == texts["id"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for whole in batches:
            out = []
            for a, b, text in zip(whole.column(0).to_pylist(), whole.column(2).to_pylist(), whole.column(3), strict=True):
                s = shingles(text.as_py(), n)
                if b is None:
                    head = s
                    continue
                both = len(np.intersect1d(head, s, assume_unique=True))
                if den * both >= num * (len(head) + len(s) - both):
                    out.append((a, b))
            if out:
                yield _pairs(out)

    ordered = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(ordered.mapInArrow(run, "a long, b long"), label)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, a: int = 8, b: int = 8, rows: int = 2, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    A document's set: its distinct n-word shingles (see shingles). Links: Jaccard similarity of the full sets of at least
    threshold (hundredths). component_id: the smallest id reachable. A pair at 0.85 meets in no table with a probability
    of 7e-5 (at 0.8, 5e-4) with the defaults. Null, empty and wordless texts: n_shingles 0, linked with nothing. Null ids
    are linked with nothing and kept. Ids should be unique: rows of one id count as one document. Other columns don't
    matter. An empty table gives an empty result.
    """
    num, den = round(100 * threshold), 100
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sigs = materialize(signatures(rows_in, n, (a + b) * rows), "minhash-signatures")
    known = sigs.where("d1 is not null and doc_id is not null")
    digests = materialize(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "minhash-classes")
    classes = known.join(digests.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "id"), (F.col("doc_id") == F.col("id")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("id", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["id"])
    classes = materialize(classes, "minhash-sets")

    keyed = _keyed(classes, a, b, rows)
    buckets = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(keyed.join(buckets, "key"), "minhash-buckets")

    # First round: each class and the smallest member of its buckets with which it shares most.
    star = shared.where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("tables"))
    best = materialize(star.groupBy("id").agg(F.max_by("lead", F.struct("tables", -F.col("lead"))).alias("lead")), "minhash-best")
    involved = materialize(shared.select("id").distinct(), "minhash-involved")
    count = involved.count()
    ids = small_side(involved, count)
    # Equal ids: one text stands for them, the one whose set stands for the class.
    texts = rows_in.join(ids, rows_in["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
    texts = materialize(texts, "minhash-texts")
    first = _verify(best.select(F.col("lead").alias("a"), F.col("id").alias("b")), texts, n, num, den, "minhash-first")
    parts = materialize(components(first, "minhash-one"), "minhash-parts")

    # Second round: what shares a bucket and no component. First which of these can be similar, as clusters.
    matches = needed_matches(threshold, (a + b) * rows)
    labelled = shared.join(parts, shared["id"] == parts["node"], "left").select("key", "size", "id", F.coalesce("component", "id").alias("comp"))
    labelled = materialize(labelled, "minhash-labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    sized = classes.select(F.col("id").alias("i"), "n", "sig")
    rest = labelled.join(mixed, "key", "left_semi").join(sized, F.col("id") == F.col("i")).select("key", "size", "id", "comp", "n", "sig")
    ordered = _in_blocks(rest, block).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    possible = materialize(ordered.mapInArrow(_candidates(matches, num, den), "id long, comp long, top long").distinct(), "minhash-possible")
    clusters = materialize(components(possible.select("comp", "top").distinct(), "minhash-possible"), "minhash-clusters")
    # Then every possible pair of a cluster on its full sets.
    members = possible.select("id", "comp").distinct()
    members = with_partner(members, "comp", "id", clusters.select(F.col("node").alias("comp"), F.col("component").alias("key")))
    members = materialize(members.join(sized, F.col("id") == F.col("i")).select("key", "id", "comp", "n", "sig"), "minhash-members")
    # A cluster of long texts counts as one of more rows, so that a block's sets are bounded in bytes, not in number alone.
    sizes = members.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / ROW_SHINGLES)).alias("size"))
    members = with_partner(members, "key", "id", sizes).select("key", "size", "id", "comp", "n", "sig")
    dealt = _in_blocks(members, block // 4)
    dealt = dealt.join(texts.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).select("key", "low", "high", "block", "id", "comp", "n", "sig", "text")
    ordered = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    second = materialize(ordered.mapInArrow(_similar(matches, num, den, n), "a long, b long").distinct(), "minhash-second")
    joined = materialize(components(second, "minhash-two"), "minhash-components").select(F.col("node").alias("c"), "component")

    named = digests.join(parts.withColumnRenamed("component", "c"), digests["id"] == parts["node"], "left").select("d1", "d2", "id", F.coalesce("c", "id").alias("c"))
    named = with_partner(named, "c", "id", joined, how="left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "c").alias("c"))
    found = sigs.select("doc_id", "n_shingles", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the document with the smallest id, all rows of it, columns as they are."""
    kept = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    kept = materialize(kept, "minhash-kept")
    side = small_side(kept, kept.count())
    same = docs.join(side, docs[id_col].cast("long") == side["_kept_id"], "left_semi")
    return same.unionByName(docs.where(F.col(id_col).isNull()))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at 85 hundredths."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 0.85)
