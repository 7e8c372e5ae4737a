"""Tables that are kept and changed, indexes, loops and streams against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import collaborative, documents, embedding_loop, graph_store, index, lineage, postings, refresh, resolve
from quillon.plans.documents import letters
from quillon.sources.fixtures import Catalogue
from quillon.sources.versions import Cache, Store
from quillon.streaming import sessions, stateful


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def grams(s):
    out = set()
    for w in re.findall(r"[^\W_]+", s.lower()):
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_derived_tables_follow_their_sources(spark, tmp_path):
    """A file that is written anew within a session changes the next answer; one that isn't builds nothing again."""
    source, built = f"{tmp_path}/source", []

    def write(n):
        spark.range(n).write.mode("overwrite").parquet(f"{source}/t.parquet")

    def build():
        built.append(1)
        return spark.read.parquet(f"{source}/t.parquet").agg(F.count("*").alias("n"))

    ask = lambda: lineage.table(spark, source, "counted", build).first()[0]
    path = lambda: lineage.files(spark, source, "listed", lambda p: spark.read.parquet(f"{source}/t.parquet").write.parquet(p))
    write(10)
    one = path()
    assert ask() == ask() == 10 and len(built) == 1 and path() == one
    write(25)
    assert ask() == 25 and spark.read.parquet(path()).count() == 25 and len(built) == 2


def test_cooccurrence_after_a_change_of_lineitem(spark, tmp_path):
    """The query's answer is the same as over a new folder of the same rows."""
    from quillon.plans import catalog

    sf, ask = "/root/testdata/sf0.001", catalog.queries()["cooccurrence_stats"]
    half = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 2 = 0")
    for name in ("one", "two"):
        spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    whole = rows(ask(spark, f"{tmp_path}/one"))
    half.write.mode("overwrite").parquet(f"{tmp_path}/one/lineitem.parquet")
    half.write.mode("overwrite").parquet(f"{tmp_path}/two/lineitem.parquet")
    assert rows(ask(spark, f"{tmp_path}/one")) == rows(ask(spark, f"{tmp_path}/two")) != whole


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", {"t": ("k long, v string", "k")}, parts=4)
    frame = lambda x: spark.createDataFrame(x, "k long, v string")
    assert store.latest() == (0, None) and store.read("t").count() == 0
    assert store.commit({"t": (frame([(k, "a") for k in range(40)] + [(None, "n")]), None)}, "first") == 1
    was = {r["part"]: r["path"] for r in store._commit_rows(1) if r["name"]}
    store.change("t", frame([(7, "")]), lambda old: old.where("k <> 7 or k is null"))
    now = {r["part"]: r["path"] for r in store._commit_rows(2) if r["name"]}
    assert sum(was[p] != now.get(p) for p in was) == 1  # the other parts are the files that they were
    assert store.read("t").count() == 40 and store.read("t", version=1).count() == 41 and store.latest()[0] == 2
    store.commit({"t": (frame([]), None)})
    assert store.read("t").count() == 0 and store.read("t", version=1).count() == 41


def test_cache(spark, tmp_path):
    at = lambda d: F.lit(f"2024-01-{d:02} 00:00:00").cast("timestamp")
    cache = Cache(spark, f"{tmp_path}/c", "user_id long, item string, score double, expires_at timestamp", ["user_id", "item"], parts=3)
    put = lambda data: cache.write(spark.createDataFrame(data, "user_id long, item string, score double, day int").select("user_id", "item", "score", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(day)").alias("expires_at")))
    put([(u, i, 1.0, u) for u in range(1, 10) for i in ("a", "b", None)])
    version = put([(2, None, 5.0, 20), (3, "a", 7.0, 1)])
    ask = lambda d, **more: rows(cache.read(at(d), **more).select("user_id", "item", "score"))
    assert (2, None, 5.0) in ask(3) and (2, None, 1.0) not in ask(1) and (3, "a", 7.0) not in ask(3)
    cache.invalidate(spark.createDataFrame([(5,), (5,), (77,)], "user_id long"))
    cache.delete_expired(at(4))
    assert {u for u, _, _ in ask(1)} == {2, 4, 6, 7, 8, 9} and {u for u, _, _ in ask(1, version=version)} == set(range(1, 10))
    assert cache.delete_expired(at(4)) and len(ask(1)) == 16


def test_pairs_by_differences_equal_a_rebuild(spark, tmp_path):
    r = random.Random(2)
    store, lists = Store(spark, f"{tmp_path}/p", refresh.PAIR_TABLES, parts=4), set()
    versions = []
    for k in range(5):
        lists -= set(r.sample(sorted(lists), min(len(lists), 25)))
        lists |= {(r.randrange(30), r.randrange(25)) for _ in range(40)} if k != 3 else set()
        seeds = spark.createDataFrame([*lists, *list(lists)[:3], (None, 1), (1, None)], "list_id long, work_id long")
        versions.append(refresh.refresh_pairs(store, seeds))
        assert refresh.refresh_pairs(store, seeds) == versions[-1]
        plain = spark.createDataFrame(sorted(lists), "list_id long, work_id long")
        assert rows(refresh.stored_pairs(store)) == rows(collaborative.list_pairs(plain))
    assert versions == sorted(set(versions))
    assert refresh.refresh_pairs(store, spark.createDataFrame([], "list_id long, work_id long")) > versions[-1] and refresh.stored_pairs(store).count() == 0


def test_refresh_only_when_files_changed(spark, tmp_path):
    source = f"{tmp_path}/lists"
    save = lambda n: spark.createDataFrame([(k, w) for k in range(n) for w in range(4)], "list_id long, work_id long").write.mode("overwrite").parquet(source)
    ask = lambda: refresh.refresh_from(spark, f"{tmp_path}/state", source, spark.read.parquet(source))
    save(3)
    assert ask()[1] and not ask()[1]
    save(5)
    store, worked = ask()
    assert worked and {r["overlap"] for r in refresh.stored_pairs(store).collect()} == {5}


WORDS = ["blue", "Blues", "bolt", "100%", "a_b", "é", "Ébène", "x", "o'neil", "日本", "back\\slash", "bo"]


@pytest.fixture(scope="module")
def titled(spark, tmp_path_factory):
    r = random.Random(4)
    titles = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(300)] + [None, "", "--", "bolt"]
    works = spark.createDataFrame(list(enumerate(titles)), "work_id long, title string").cache()
    path = f"{tmp_path_factory.mktemp('postings')}/index"
    postings.build(works, path)
    return works, postings.Index(spark, path)


@pytest.mark.parametrize("pattern", ["blue%", "%bolt", "%lue bo%", "b_lt", "%100\\%%", "%a\\_b%", "%\\\\sl%", "É%", "_", "%", "", "%本", "zzz%", "%b%e%", "x", "b_ue% %t"])
def test_patterns_equal_a_scan(titled, pattern):
    works, found = titled
    assert rows(postings.matching(works, found, pattern)) == rows(works.where(F.ilike("title", F.lit(pattern))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "b", "é", "1", " ", "-", "%", "_", "\\%", "\\_", "\\\\"]), max_size=7), st.text(alphabet="abé1 -%_\\", max_size=12))
def test_grams_of_a_pattern_are_in_every_match(parts, text):
    pattern = "".join(parts)
    plain = re.sub(r"\\\\(.)|(%)|(_)|(.)", lambda m: m[0], pattern)
    regex, k = "", 0
    while k < len(plain):
        if plain[k] == "\\" and k + 1 < len(plain):
            regex, k = regex + re.escape(plain[k + 1]), k + 2
            continue
        regex += {"%": "(?s:.*)", "_": "(?s:.)"}.get(plain[k], re.escape(plain[k]))
        k += 1
    if re.fullmatch(regex, text):
        assert set(postings.pattern_grams(pattern)) <= grams(text)


@pytest.mark.parametrize("q", ["blue bolt", "Blues", "100%", "é", "zz", "--", "x y z", "a_b"])
def test_search_equals_scoring_every_title(titled, q):
    works, found = titled
    got = {r["work_id"]: round(r["similarity"], 9) for r in postings.search(works, found, q).collect()}
    want = {k: round(jaccard(t, q), 9) for k, t in works.collect() if t is not None and (jaccard(t, q) > 0.3 or q.lower() in t.lower())}
    assert got == want


def test_search_reads_lists_of_its_own_grams(titled):
    works, found = titled
    plan = postings.similar_ids(found, "blue bolt", 0.3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan or "In(gram" in plan


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_fuzzy_pairs_in_blocks(spark, monkeypatch, threshold):
    monkeypatch.setattr(resolve, "BLOCK", 7)
    r = random.Random(9)
    names = sorted({" ".join(r.choice(["the", "then", "red", "reds", "blue", "moon", "noon"]) for _ in range(r.randint(1, 3))) for _ in range(120)})
    got = {(a, b): round(s, 9) for a, b, s in rows(resolve.fuzzy_pairs(spark.createDataFrame([(k, n) for k, n in enumerate([*names, names[0]])] + [(-1, None), (-2, "--")], "id long, name string"), "id", "name", threshold))}
    assert got == {(a, b): round(jaccard(a, b), 9) for a, b in itertools.combinations(names, 2) if jaccard(a, b) >= threshold}


def test_potential_duplicates(spark):
    r = random.Random(5)
    works = [(k, r.choice(["red moon", "red moons", "Red Moon", "blue noon", "far"]) if k < 60 else f"only {k}", r.choice(["ann lee", "bob ray", None])) for k in range(70)] + [(99, None, "ann lee")]
    authors = [(k, n) for k, _, _ in works for n in r.sample(["ann lee", "anne lee", "bob ray", "zed"], r.randint(0, 2))]
    got = rows(resolve.potential_duplicates(spark.createDataFrame(works, "work_id long, title string, author string"), spark.createDataFrame(authors, "work_id long, name string")).select("work_id", "other_id"))
    want = []
    for k, t, a in works:
        near = sorted((-round(jaccard(t, u), 9), m) for m, u, _ in works if t and u and m != k and (jaccard(t, u) > 0.6 or t.lower() == u.lower()))[:10]
        want += [(k, m) for _, m in near if a is None or any(jaccard(n, a) > 0.5 for w, n in authors if w == m)]
    assert got == sorted(want, key=repr)


def test_cross_source_limit_with_hot_titles(spark):
    """Titles that many works share are not multiplied, and the first k pairs are those of the order."""
    works = [(k, ["Moon (Ed)", "Moon: one", "Noon Book 3", "moon"][k % 4], "amazon" if k % 2 else "openlibrary", None if k % 2 else f"OL{k}W") for k in range(200)] + [(900, None, "amazon", None), (901, "noons", "amazon", None)]
    described = spark.createDataFrame([(k,) for k in range(0, 200, 6)], "work_id long")
    d = spark.createDataFrame(works, "work_id long, title string, source string, ol_work_key string")
    bare = {k: t and re.sub(r"(?i)\s*(book\s*\d+|#\d+|volume\s*\d+)\s*$", "", re.sub(r"\s*:.*$", "", re.sub(r"\s*\([^)]*\)\s*$", "", t))).lower() for k, t, _, _ in works}
    shop, shelf = [k for k, _, s, key in works if s == "amazon" and not key and bare[k]], [k for k, _, _, key in works if key and k % 6 == 0]
    every = sorted((-round(1.0 if bare[a] == bare[o] else jaccard(bare[a], bare[o]), 9), bare[a], bare[o], a, o) for a in shop for o in shelf if bare[a] == bare[o] or jaccard(bare[a], bare[o]) > 0.3)
    for k in (1, 7, 250, 100_000):
        got = sorted((a, o) for a, o, _ in rows(resolve.cross_source_duplicates(d, described, 0.3, k)))
        assert got == sorted((a, o) for _, _, _, a, o in every[:k])
    classes = dict(rows(resolve.cross_source_classes(d, described, 0.3)))
    links, top = [(a, o) for _, _, _, a, o in every], {}
    for a, o in links * 3:
        low = min(top.get(a, a), top.get(o, o))
        top[a] = top[o] = low
    for _ in range(len(top)):
        for a, o in links:
            top[a] = top[o] = min(top[a], top[o])
        if all(top[a] == top[o] for a, o in links):
            break
    assert classes == top


def test_embedding_loop(spark, tmp_path):
    """Failed batches lose no row, a rerun adds none, an encoder that breaks the run is taken up again."""
    works = [(k, "brand#13" if k % 17 == 0 else "brand#21" if k % 11 == 0 else None if k == 5 else f"text {chr(97 + k % 26)}") for k in range(150)]
    d = spark.createDataFrame(works, "work_id long, text string")
    store = Store(spark, f"{tmp_path}/v", embedding_loop.TABLES, parts=3)
    bad = {k for k, t in works if t == "brand#13"}
    for attempt in range(1, 5):
        embedding_loop.run(d, store, letters, batch=7, slices=3)
        got = {r["work_id"]: r["embedding"] for r in store.read("vectors").collect()}
        assert got == {k: letters([t or ""])[0] for k, t in works if k not in bad} and store.read("vectors").count() == len(got)
        assert rows(store.read("dead")) == [(k, "ValueError: refused", min(attempt, 3)) for k in sorted(bad, key=lambda k: repr((k,)))]
    embedding_loop.run(d, store, lambda texts: [[1.0]] * len(texts), batch=7, slices=3, attempts=9)
    assert store.read("dead").count() == 0 and store.read("vectors").count() == 150
    embedding_loop.run(spark.createDataFrame([], "work_id long, text string"), store, letters)
    wrong = Store(spark, f"{tmp_path}/w", embedding_loop.TABLES)
    embedding_loop.run(d.where("work_id < 3"), wrong, lambda texts: [[1.0]], batch=2, slices=1)  # a vector too few, then one each
    assert wrong.read("vectors").count() == 3


def test_graph_caps_and_hops_without_a_shuffle_of_edges(spark):
    r = random.Random(6)
    edges = [(w, r.choice("ab"), f"n{r.randrange(12)}") for w in range(200) for _ in range(4)] + [(w, "a", "hub") for w in range(200)]
    d = spark.createDataFrame(edges, "work_id long, kind string, node string")
    kept = rows(graph_store.capped(d, 15, 3))
    assert kept == rows(graph_store.capped(d.repartition(5), 15, 3)) and set(kept) <= set(edges)
    for key, most in ((lambda e: e[1:], 15), (lambda e: e[0], 3)):
        assert max(len(list(g)) for _, g in itertools.groupby(sorted(kept, key=key), key)) <= most
    few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    graph = graph_store.store(graph_store.capped(d, 15, 3), buckets=4)
    try:
        hops = graph.two_hops(spark.range(0, 200, 5).withColumnRenamed("id", "work_id"))
        want = {}
        for (w, *n), (o, *m) in itertools.product(kept, kept):
            if n == m and w != o and w % 5 == 0:
                want[w, o] = want.get((w, o), 0) + 1
        assert {(a, b): n for a, b, n in rows(hops)} == want
        plan = hops._jdf.queryExecution().executedPlan().toString()
        under = [plan.splitlines()[max(0, i - 4) : i] for i, line in enumerate(plan.splitlines()) if "FileScan" in line]
        assert len(under) >= 2 and not any("Exchange" in line for lines in under for line in lines)
    finally:
        graph.drop()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)


def test_sessions_in_any_order():
    r = random.Random(1)
    for _ in range(200):
        times = [r.randrange(200) for _ in range(r.randint(1, 25))]
        got, want = [], []
        k = 0
        while k < len(times):
            n = r.randint(1, 5)
            got = stateful.add_events(got, times[k : k + n], [1.0] * len(times[k : k + n]), 10)
            k += n
        for t in sorted(times):
            if want and t < want[-1][1] + 10:
                want[-1] = [want[-1][0], t, want[-1][2] + 1, want[-1][3] + 1.0]
            else:
                want.append([t, t, 1, 1.0])
        assert got == want


def test_stream_with_late_rows(spark, tmp_path):
    """What comes behind the watermark of the batch before is dropped and counted; the rest are the sessions of the batch."""
    import time

    base = "timestamp '2024-01-01 00:00:00'"
    files = [[(1, 0), (1, 10), (2, 5)], [(1, 25), (1, 300), (2, 200)], [(1, 3), (2, 4), (2, 205), (1, 310)], [(9, 5000)], [(1, 20), (9, 5001)]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, "user_id long, m int").selectExpr("user_id", f"{base} + make_dt_interval(0, 0, m) ts", "1.5d value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in order of their times
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    late = stateful.run_to_end(stateful.stream_sessions(stream, 30, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = spark.createDataFrame([e for part in files[:3] for e in part], "user_id long, m int").selectExpr("user_id", f"{base} + make_dt_interval(0, 0, m) ts", "1.5d value")
    assert late == 1 and rows(got) == rows(sessions.sessionise(batch, "30 minutes"))


def test_index_on_vectors_with_structure(spark, tmp_path):
    from quillon.plans.upkeep import clustered
    from quillon.sources.fixtures import Catalogue

    data = clustered(Catalogue(spark, "/root/testdata/sf0.001")).cache()
    book = index.fit(data, 64)
    assert not book.exact and book.share <= 0.1
    found = index.build(data, book, f"{tmp_path}/ivf")
    asked = data.where("work_id % 20 = 0")
    got, want = (index.search(found, asked, b).collect() for b in (book, index.Codebook(book.centres, book.codes, 0, 1.0, True)))
    pairs = lambda x: {(r["asked"], r["work_id"]) for r in x}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want)) > 0
    all_ = data.collect()
    x = np.array([r["embedding"] for r in all_])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["work_id"] for r in all_])
    for k in np.flatnonzero(ids % 400 == 0):
        sims = np.round(x @ x[k], 9)
        sims[k] = -2
        assert {(ids[k], m) for m in ids[np.lexsort((ids, -sims))[:10]]} <= pairs(want)


def test_index_without_structure_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SHARD", 50)
    r = np.random.default_rng(3)
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(300, 24)))] + [(900, None)], "work_id long, embedding array<double>")
    book = index.fit(data, 8)
    assert book.exact
    found = index.search(index.build(data, book, f"{tmp_path}/ivf"), data.where("work_id % 20 = 0 or work_id = 900"), book, k=3)
    assert found.count() == 45 and {r["asked"] for r in found.collect()} == set(range(0, 300, 20))
    empty = spark.createDataFrame([], "work_id long, embedding array<double>")
    book = index.fit(empty, 8)
    assert book.exact and index.exact(empty, spark.createDataFrame([(1, [1.0])], "asked long, asked_vector array<double>")).count() == 0


def test_documents_of_odd_rows(spark):
    import json

    one = lambda data, schema: spark.createDataFrame(data, schema)
    works = one([(1, 'a "quoted" title', 1990, None), (2, None, None, "s"), (3, "not on the page", 1, "s")], "work_id long, title string, first_publish_year int, series string")
    authors = one([(1, 8, "Zed", "author"), (1, 9, "Ann", "editor"), (1, 7, "Ann", "author"), (1, 7, "Ann", "author"), (1, 6, None, None), (3, 1, "x", "author")], "work_id long, id long, name string, role string")
    subjects, editions = one([(1, "b"), (1, "a"), (1, "a")], "work_id long, subject string"), one([(1, "B2", 10), (1, "B1", None)], "work_id long, asin string, page_count int")
    quality, reading = one([(1, 4.25, 8)], "work_id long, blended_avg double, total_ratings long"), one([(2, 60000, 2)], "work_id long, total_ms long, sessions long")
    got = {r["work_id"]: json.loads(r["document"]) for r in documents.book_documents(one([(1,), (2,), (2,), (44,)], "work_id long"), works, authors, subjects, editions, quality, reading, F.lit(None).cast("string")).collect()}
    assert set(got) == {1, 2} and [(a["id"], a["role"]) for a in got[1]["authors"]] == [(7, "author"), (8, "author"), (9, "editor"), (6, None)]
    assert got[1]["title"] == 'a "quoted" title' and got[1]["subjects"] == ["a", "b"] and got[1]["editions"] == [{"asin": "B1", "page_count": None}, {"asin": "B2", "page_count": 10}] and got[1]["rating"] == {"average": "4.2500", "count": 8} and got[1]["reading"] is None
    assert got[2] == {"id": 2, "title": None, "year": None, "series": "s", "cover": None, "authors": [], "subjects": [], "editions": [], "rating": None, "reading": {"total_ms": 60000, "sessions": 2}}


def test_pairs_are_dealt_by_their_number(spark):
    """Tasks hold a bounded number of pairs, whatever the session's number of shuffle partitions."""
    seeds = spark.range(30_000).select((F.col("id") / 100).cast("long").alias("list_id"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("work_id")).distinct().cache()
    most = collaborative.pairs_at_most(seeds)
    assert lineage.parts(spark, most, most // 10) >= 10 and lineage.parts(spark, 0, 100) == 1
    found = collaborative.pairs_of(seeds, 10, [], F.lit(1))
    assert found.rdd.getNumPartitions() == 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    x, y = seeds.alias("x"), seeds.alias("y")
    plain = x.join(y, F.expr("x.list_id = y.list_id and x.work_id < y.work_id")).groupBy(F.col("x.work_id"), F.col("y.work_id")).agg(F.count("*"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_narrowed_catalogues(spark):
    """One reader's events and some works' ratings: the rows of the whole views, without a shuffle of all lines."""
    c = Catalogue(spark, "/root/testdata/sf0.001")
    one, ids = c.of_reader(1), spark.createDataFrame([(7,), (11,), (7,)], "work_id long")
    assert rows(one.user_event) == rows(c.user_event.where("user_id = 1")) and rows(one.session) == rows(c.session.where("user_id = 1"))
    assert rows(c.of_works(ids).rating) == rows(c.rating.where("work_id in (7, 11)"))
    assert "BroadcastHashJoin" in one.user_event._jdf.queryExecution().executedPlan().toString()
    assert rows(c.kept_events) == rows(c.user_event)
    kept = c.kept_events.inputFiles()
    assert kept == Catalogue(spark, "/root/testdata/sf0.001").kept_events.inputFiles()
