from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import embed_dedup, minhash
from quillon.llm.shared import components, stars


def smallest(ids, links):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        top[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def sets(texts):
    out = {}
    for k, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(0, k) for k in range(1000, 3000)] + [(k, k + 1) for k in range(5000, 5060)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "u long, v long"), "test").collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == smallest(ids, links) and stars(np.array([], int), np.array([], int))[0].size == 0


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_duplicates(spark, threshold):
    r = random.Random(3)
    words = [f"w{k}" for k in range(2000)]
    base = [r.choice(words) for _ in range(120)]
    texts = {}
    for k in range(500):  # copies of one text with up to 6 changes: chains of links
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(120)] = r.choice(words)
        texts[k] = (" " if k % 2 else "\n ").join(w)
    for k in range(500, 640):
        texts[k] = " ".join(r.choice(words) for _ in range(r.randrange(150)))
    for k in range(640, 700):  # a shared passage, no copies
        texts[k] = " ".join(base[:50] + [r.choice(words) for _ in range(12)])
    texts |= {700: None, 701: "", 702: " \n\t", 703: "a b", 704: "A B", 705: "a b c", 706: "É x", 707: "é x"}
    d = spark.createDataFrame([(k, x, "z") for k, x in texts.items()], "doc_id long, text string, id string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(d, threshold, block=64).collect()}
    s = sets(texts)
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= round(100 * threshold) * len(s[a] | s[b])]
    want = smallest(s, links)
    assert got == {k: (len(s[k]), want[k], want[k] == k) for k in s}
    kept = {x["doc_id"] for x in minhash.keep_one(d, threshold).collect()}
    assert kept == {k for k in s if want[k] == k}


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    d = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], schema)
    got = sorted(map(tuple, minhash.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True)] * 2 + [(2, 0, 2, True), (None, 1, None, True)], key=repr)


@pytest.mark.parametrize("top", [8, 1])
def test_vectors(spark, top):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 24))
    near = x[:40] + 0.25 * r.normal(size=(40, 24))
    dense = x[0] + 0.1 * r.normal(size=(200, 24))
    rows = [v.tolist() for v in np.vstack([x, near, dense, x[:5], 3 * x[:2]])]
    rows += [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, []]
    d = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, n int")
    got = {q["vec_id"]: (q["n_links"], q["component_id"], q["kept"]) for q in embed_dedup.near_vectors(d, 0.9, lead=6, tile_rows=40, top=top).collect()}
    good = {k: np.array(v) for k, v in enumerate(rows) if v and all(y is not None and np.isfinite(y) for y in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] / (np.sqrt(good[a] @ good[a]) * np.sqrt(good[b] @ good[b])) >= 0.9]
    n = {k: 0 for k in range(len(rows))}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = smallest(range(len(rows)), links)
    assert len(links) > 20_000 and got == {k: (n[k], want[k], want[k] == k) for k in n}


def test_no_vectors(spark):
    s = "vec_id long, embedding array<float>"
    assert embed_dedup.near_vectors(spark.createDataFrame([], s)).count() == 0
    assert [tuple(x) for x in embed_dedup.near_vectors(spark.createDataFrame([(4, None)], s)).collect()] == [(4, 0, 4, True)]
    assert [tuple(x) for x in embed_dedup.near_vectors(spark.createDataFrame([(4, [1.0, 2.0])], s)).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("dims", [1, 16, 17, 200])
def test_blocks_of_dimensions_against_whole_products(dims):
    """Flat and steep spectra, dense and sparse survivors; lead blocks of every kind."""
    from types import SimpleNamespace

    r = np.random.default_rng(dims)
    assert embed_dedup.block_ends(dims, 16)[-1] == dims and all(a < b for a, b in zip(embed_dedup.block_ends(dims, 3), embed_dedup.block_ends(dims, 3)[1:], strict=False))

    def tile(x):
        t = object.__new__(embed_dedup.Tile)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        t.__dict__.update(vars(SimpleNamespace(ids=np.arange(len(x)), given=3 * x, x=x)))
        t.measure(4)
        return t

    for steep in (0.0, 1.0):
        base = r.normal(size=(300, dims)) / (1 + np.arange(dims)) ** steep
        a, b = tile(base), tile(np.vstack([base[:80] + 0.05 * r.normal(size=(80, dims)), r.normal(size=(50, dims))]))
        for threshold in (0.1, 0.8, 0.9):
            for x, y, same in ((a, b, False), (a, a, True)):
                whole = x.x @ y.x.T
                if same:
                    whole[np.tril_indices(len(whole))] = -2
                i, j = embed_dedup.compare(x, y, threshold, same, step=37)
                assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(k.tolist() for k in np.nonzero(whole >= threshold)), strict=True))


def test_memory_of_a_comparison_at_1536_dimensions():
    import tracemalloc

    r = np.random.default_rng(1)
    x = r.normal(size=(640, 1536))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = object.__new__(embed_dedup.Tile)
    t.ids, t.given, t.x = np.arange(640), x, x
    t.measure(16)
    tracemalloc.start()
    embed_dedup.compare(t, t, 0.9, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_query_with_links_and_copies_of_a_third(spark, tmp_path):
    """The registered query and its SQL on vectors with links, one vector a third of all."""
    import duckdb

    from quillon.llm import queries

    r = np.random.default_rng(8)
    x = r.normal(size=(200, 16)).astype(np.float32)
    rows = [*x, *(x[:60] + 0.15 * r.normal(size=(60, 16)).astype(np.float32)), *[x[7]] * 130]
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(rows)] + [(900, None), (901, [0.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    out = c.execute(queries.oracle_sql()["op2_embedding_dedup"])
    columns = [d[0] for d in out.description]
    want = sorted(out.fetchall())
    got = sorted(tuple(q[k] for k in columns) for q in queries.queries()["op2_embedding_dedup"](spark, str(tmp_path)).collect())
    assert got == want and sum(q[columns.index("n_links")] > 0 for q in want) > 180
