from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import collaborative as co
from quillon.operators import graph as gr
from quillon.operators import reading as rd
from quillon.operators import recommend as rc
from quillon.operators import resolve as rs
from quillon.operators.lineage import cut
from quillon.sources import dumps, sinks
from quillon.streaming import sessions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pairs_come_twice_for_readers(spark):
    seeds = spark.createDataFrame([(l, w) for l in (1, 2) for w in (10, 11)] + [(3, 12)], "list_id long, work_id long")
    none = spark.createDataFrame([], "work_id long, author_id long")
    table = co.cooccurrence(seeds, none)
    assert [(a, b, o) for a, b, o, _ in rows(table)] == [(10, 11, 2), (11, 10, 2)]
    assert len(rows(co.similar_works(table, 10))) == 2


def test_reverse_author_pairs_only_fill(spark):
    seeds = spark.createDataFrame([(l, w) for l in range(4) for w in (10, 11)] + [(l, 10) for l in range(4, 12)], "list_id long, work_id long")
    by = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 2)], "work_id long, author_id long")
    got = {(a, b): float(j) for a, b, _, j in rows(co.cooccurrence(seeds, by))}
    assert got[10, 11] == 1.0 and got[11, 10] == pytest.approx(4 / 12, abs=1e-5) and got[12, 13] == got[13, 12] == 1.0


def test_fusion_equals_a_fold(spark):
    rnd = np.random.default_rng(1)
    names = list(rc.BOOSTS_GENERAL)
    hits = [(int(w), names[s], int(q), float(v)) for w, s, q, v in zip(rnd.integers(0, 40, 300), rnd.integers(0, 4, 300), range(300), rnd.uniform(0, 1.5, 300))]
    want: dict = {}
    for w, s, q, v in sorted(hits, key=lambda h: (names.index(h[1]), h[2])):
        want[w] = min(1.0, want[w] + rc.BOOSTS_GENERAL[s] * v) if w in want else v
    got = {r["work_id"]: r["score"] for r in rc.fuse(spark.createDataFrame(hits, "work_id long, source string, seq int, sim double"), rc.BOOSTS_GENERAL).collect()}
    assert got == {w: pytest.approx(v, abs=1e-6) for w, v in want.items()}


def test_greedy_rerank_equals_the_plain_loop():
    rnd = np.random.default_rng(2)
    e = rnd.normal(size=(40, 8))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    pdf = pd.DataFrame({"work_id": range(40), "base": rnd.uniform(0, 1, 40), "embedding": [None if k % 9 == 0 else e[k] for k in range(40)], "authors": [[int(k % 5)] for k in range(40)]})
    got = rc.greedy_rerank(pdf, 20)["work_id"].tolist()
    pool, taken = pdf.sort_values(["base", "work_id"], ascending=[False, True]).to_dict("records"), []
    while len(taken) < 20:
        def value(r):
            known = [t["embedding"] for t in taken if t["embedding"] is not None]
            novelty = 1.0 if r["embedding"] is None or not known else 1 - np.mean([r["embedding"] @ k for k in known])
            return 0.7 * r["base"] + 0.3 * novelty * 0.15 - 0.1 * sum(a in {x for t in taken for x in t["authors"]} for a in r["authors"])

        best = max(pool, key=lambda r: round(value(r), 12))
        taken.append(best)
        pool = [r for r in pool if r["work_id"] != best["work_id"]]
    assert got == [t["work_id"] for t in taken]


def test_rerank_by_reader(spark):
    d = spark.createDataFrame([(u, w, 1.0 / (w + 1), [1.0, float(w)], [w % 2]) for u in (1, 2) for w in range(6)], "user_id int, work_id long, base double, embedding array<double>, authors array<long>")
    got = rc.rerank(d, 3).toPandas()
    assert got.groupby("user_id").size().to_dict() == {1: 3, 2: 3} and (got[got.position == 1].work_id == 0).all()


def test_shelf_machine(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    s = "user_id long, work_id long, shelf string, finished_at timestamp"
    old = spark.createDataFrame([(1, 1, "read", t(5)), (1, 2, "to-read", None)], s)
    new = spark.createDataFrame([(1, 1, "currently-reading", t(9)), (1, 2, "currently-reading", t(1)), (1, 2, "dnf", t(2)), (1, 3, "read", None)], s)
    assert [r[:3] for r in rows(rd.merge_shelves(old, new))] == [(1, 1, "read"), (1, 2, "dnf"), (1, 3, "read")]
    assert rows(rd.merge_shelves(old, new))[0][3] == t(9)


def test_dnf_weights(spark):
    none = lambda k: F.lit(None).cast(k)
    from quillon.functions.scoring import event_weight

    def weight(hours):
        e = dict(rating=none("int"), finished_at=none("timestamp"), last_read_at=none("timestamp"), total_ms=F.lit(int(hours * 3_600_000)), completions=none("int"), avg_minutes=none("double"), max_minutes=none("double"), last30_ms=none("long"), author_works=none("int"), days_since_previous=none("int"), origin=none("string"), shelf=F.lit("dnf"))
        return spark.range(1).select(event_weight(e, F.lit("2024-01-01").cast("timestamp"))).first()[0]

    assert weight(6.0) == 0 and weight(5.9) < 0


def test_streaks(spark):
    d = spark.createDataFrame([(1, dt.date(2024, 1, k)) for k in (1, 2, 3, 7, 8)] + [(2, dt.date(2024, 1, 1))], "user_id long, day date")
    assert [(u, s) for u, _, s in rows(rd.streaks(d))] == [(1, 2), (2, 1)]


def test_redirects_stop_at_the_depth(spark):
    d = spark.createDataFrame([(k, k - 1) for k in range(1, 15)], "old_key long, new_key long")
    got = {a: (b, h) for a, b, h in rows(gr.resolve_redirects(d))}
    assert got[14] == (4, 10) and got[3] == (0, 3)


def test_label_propagation_is_steady(spark):
    tri = [(a, b, 1) for g in (0, 10) for a in (g, g + 1, g + 2) for b in (g, g + 1, g + 2) if a != b]
    e = spark.createDataFrame(tri, "a long, b long, weight long")
    got = dict(rows(gr.label_propagation(e, 6)))
    assert len({got[k] for k in (0, 1, 2)}) <= 2 and not {got[k] for k in (0, 1, 2)} & {got[k] for k in (10, 11, 12)}


def test_merges_chain(spark):
    d = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1)], "a long, b long")
    assert rows(rs.merge_map(d, checkpoint=cut)) == [(3, 1), (4, 1), (5, 1), (9, 8)]


def test_fuzzy_pairs_find_all(spark):
    names = ["blue bolt", "blue bolts", "red gear", "red gears", "green thing", "blue", "bolt blue", "x", "the red gear"]
    d = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, name string")
    for t in (0.3, 0.5, 0.8):
        got = {(x, y) for x, y, _ in rows(rs.fuzzy_pairs(d, "id", "name", t))}

        def grams(n):
            return {f"  {w} "[k : k + 3] for w in n.split() for k in range(len(w) + 1)}

        want = {(x, y) for x in names for y in names if x < y and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= t}
        assert got == want


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 5)], "k long, v string, n int")
    new = spark.createDataFrame([(1, None, 3), (2, "b", None), (None, "m", 1)], "k long, v string, n int")
    assert rows(sinks.upsert(old, new, ["k"], {"v": "new", "n": "greatest"})) == sorted([(1, None, 3), (2, "b", None), (None, "m", 5)], key=repr)
    assert rows(sinks.upsert(old, new, ["k"], {"n": "fill"}))[0] == (1, "a", 1)
    assert len(rows(sinks.insert_ignore(old.where("k is not null"), new.where("k is not null"), ["k"]))) == 2
    assert spark.range(1).select(sinks.merge_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3","c":null}'))).first()[0] in ('{"a":"1","b":"3"}', '{"b":"3","a":"1"}')


def test_dumps(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text('/type/work\t/works/OL1W\t3\t2020-01-01\t{"key":"/works/OL1W","title":"T","description":{"value":"D"},"subjects":["Sci Fi"],"authors":[{"author":{"key":"/authors/OL9A"}}],"first_publish_date":"May 1984"}\nbad line\n/type/work\t/works/OL2W\t1\t2020-01-01\t{broken\n')
    base, subjects, by = dumps.works(dumps.dump(spark, str(p), "work"))
    assert rows(base)[0][:5] == ("OL1W", "T", None, "D", 1984) and rows(subjects) == [("OL1W", "sci_fi", "subject")] and rows(by) == [("OL1W", "OL9A")]
    r = tmp_path / "r.txt"
    r.write_text("/works/OL1W\t\t5\t2020-01-02\n/works/OL1W\t\t9\t2020-01-02\n/works/OL1W\n")
    got = rows(dumps.ratings(spark, str(r)))
    assert len(got) == 1 and got[0][2] == 5 and got[0][4].startswith("anon_")
    c = tmp_path / "c.txt"
    c.write_text("\ufeffT (A)\r\n- Added on Monday, March 2, 2020 10:00:00 AM\r\n\r\nx\r\n==========\r\nt (a)\n- Added on Friday, April 10, 2020 1:00:00 PM\n\ny\n==========\nNo author\n- Added on Friday\n==========\nLone (B)\n==========\nU (B)\n- no date\n==========\n")
    got = rows(dumps.clippings(spark, str(c)))
    assert got == [("T", "A", "Monday, March 2, 2020 10:00:00 AM", dt.datetime(2020, 3, 2, 10, 0)), ("U", "B", None, None)]


def test_reader_exports(spark, tmp_path):
    w = lambda name, body: ((tmp_path / name).write_text(body), str(tmp_path / name))[1]
    auto = w("a.csv", "created_timestamp,file_auto_marked_as_read\n2020-01-01T00:00:00Z,b0\n,b9\n2020-01-01T00:00:00Z,\n")
    unique = w("u.csv", "asin_date_and_content_type\nb1_2020-01-02_Automatic\nb2_2020-01-03_Manual\nb3_2020-01-03\n")
    sync = w("s.csv", "ASIN,Annotation Type,Customer modified date on device,Is Deleted\nB1,kindle.last_read,2020-02-01,\nB2,kindle.most_recent_read,2020-02-01,No\nB3,Kindle.Last_Read,2020-02-01,no\nB4,kindle.bookmark_ready,2020-02-01,\nB5,kindle.last_read,2020-02-01,Yes\nB6,kindle.last_read,,\n")
    got = [(a, m) for a, _, m in rows(dumps.completions(spark, auto, unique, sync))]
    assert got == [("B0", "auto_mark"), ("B1", "insights_auto"), ("B1", "whispersync_last_read"), ("B2", "insights_manual"), ("B2", "whispersync_last_read"), ("B3", "whispersync_last_read")]
    one = w("1.csv", "ASIN,start_time,end_time,total_reading_milliseconds\nb1,2020-01-01T00:00:00Z,2020-01-01T00:01:00Z,500\nb1,,2020-01-01T00:01:00Z,500\n")
    two = w("2.csv", "created_timestamp,ASIN,device_active_time_in_ms,device_family\n2020-01-01T00:00:00Z,b2,x,\n")
    three = w("3.csv", "start_timestamp,end_timestamp,ASIN,content_type,total_reading_millis,device_family\n2020-01-01T00:00:00Z,,b3,E-Book,7,K\n2020-01-01T00:00:00Z,,b4,,8,\n2020-01-01T00:00:00Z,,b5,Audio,8,\n2020-01-01T00:00:00Z,,Not Available,E-Book,8,\n")
    got = [(a, n, s, f) for a, _, _, n, s, f in rows(dumps.sessions(spark, one, two, three))]
    assert got == [("B1", 500, "ri_adjusted", None), ("B2", None, "ereader_active", "Kindle E-reader"), ("B3", 7, "legacy_session", "K"), ("B4", 8, "legacy_session", None)]
    own = tmp_path / "own"
    own.mkdir()
    for k, (asin, kind, at) in enumerate([("b1", "Download", "2020-05-01T00:00:00Z"), ("B1", "Download", None), ("b1", "Download", "2020-06-01T00:00:00Z"), ("b2", None, None), ("b3", "Download", None)]):
        right = "{" + ", ".join(f'"{a}": "{b}"' for a, b in (("rightType", kind), ("acquiredDate", at), ("rightStatus", "Active")) if b) + "}"
        (own / f"{k}.json").write_text(f'{{"rights": [{right}], "resource": {{"asin": "{asin}", "productName": "P{k}"}}}}')
    series = w("series.csv", "ASIN,Product Name,Creation Date\nb1,Not Available,2020-04-01T00:00:00Z\nb3,S,2020-04-01T00:00:00Z\nb4,N,2020-04-01T00:00:00Z\n")
    owned = dumps.ownership(spark, str(own))
    assert [(r["asin"], r["right_type"], r["name"]) for r in sorted(owned.collect())] == [("B1", "Download", "P0"), ("B2", "Unknown", "P3"), ("B3", "Download", "P4")]
    merged = {r["asin"]: (r["name"], r["origin"]) for r in dumps.with_series(owned, spark, series).collect()}
    assert merged == {"B1": (None, "Purchase"), "B2": ("P3", None), "B3": ("P4", None), "B4": ("N", "Purchase")}
    assert dumps.eligible(owned).count() == 3


def test_stream_of_sessions(spark, tmp_path):
    s = "event_id long, user_id long, ts timestamp, value double"
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, 1, t(0), 1.0), (2, 1, t(10), 2.0), (2, 1, t(10), 2.0), (3, 1, t(100), 4.0), (4, 1, t(5000), 8.0)], s).write.parquet(str(tmp_path / "in"))
    q = sessions.stream_sessions(spark.readStream.schema(s).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r[2], r[3]) for r in rows(spark.table("sessions"))] == [(2, 3.0), (1, 4.0)]


def test_identifier_classes_hold_all_pairs(spark):
    from collections import defaultdict
    from itertools import combinations

    from quillon.plans import catalog
    from quillon.sources.fixtures import Catalogue

    sf = "/root/testdata/sf0.001"
    by, want = defaultdict(set), set()
    for x in Catalogue(spark, sf).edition.collect():
        by["isbn13", f"i{x['page_count']}"].add(x["work_id"])
        by["asin", x["asin"]].add(x["work_id"])
    for (kind, value), works in by.items():
        want |= {(kind, value, a, min(works)) for a in works if len(works) > 1}
    rows = catalog.queries()["shared_identifier_classes"](spark, sf).select("kind", "value", "work_id", "representative").collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want
    groups = defaultdict(set)
    for x in Catalogue(spark, sf).table("lineitem").collect():
        groups["isbn13", x["l_orderkey"], x["l_suppkey"]].add(x["l_partkey"])
        groups["asin", x["l_orderkey"], x["l_linenumber"]].add(x["l_partkey"])
    few = {(x["a"], x["b"]) for x in catalog.queries()["shared_identifier"](spark, sf).collect()}
    assert few == {p for works in groups.values() for p in combinations(sorted(works), 2)}


def test_merges_of_all_redirects(spark):
    from quillon.plans import catalog
    from quillon.sources.fixtures import Catalogue

    sf = "/root/testdata/sf0.001"
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in Catalogue(spark, sf).redirect.select("old_key", "new_key").collect():
        a, b = sorted((top(a), top(b)))
        up[b] = a
    rows = catalog.queries()["merge_works_whole"](spark, sf).collect()
    assert len(rows) == len({x["from_id"] for x in rows})
    assert {(x["from_id"], x["to_id"]) for x in rows} == {(x, top(x)) for x in up if top(x) != x}
    assert any(x["from_id"] % 64 == 0 and x["to_id"] == 1 for x in rows)


@pytest.mark.parametrize("name", ["vector_index_search", "vector_index_clustered"])
def test_recall_of_the_vector_index(spark, name):
    """At least nine tenths of the true neighbours, all where the fit finds no structure; every vector is in one list."""
    from quillon.plans import catalog
    from quillon.plans.upkeep import _indexed, clustered
    from quillon.sources.fixtures import Catalogue

    sf = "/root/testdata/sf0.001"
    c = Catalogue(spark, sf)
    table = clustered(c) if name == "vector_index_clustered" else c.work.where("embedding is not null").select("work_id", "embedding")
    rows = {r["work_id"]: np.array(r["embedding"]) for r in table.collect()}
    index, book = _indexed(c, *(("clustered", table, 64) if name == "vector_index_clustered" else ("works", table, 16)))
    assert sorted(r[0] for r in index.select("work_id").collect()) == sorted(rows)
    assert book.exact == (name == "vector_index_search") and (book.exact or book.share <= 0.1)
    got = {}
    for r in catalog.queries()[name](spark, sf).collect():
        got.setdefault(r["asked"], set()).add(r["work_id"])
    ids = np.array(sorted(rows))
    x = np.array([rows[k] / np.linalg.norm(rows[k]) for k in ids])
    asked = [k for k in ids.tolist() if k % 20 == 0]
    hits = 0
    for k in asked:
        s = x @ rows[k]
        s[ids == k] = -2
        hits += len(got[k] & set(ids[np.argsort(-s, kind="stable")[:10]].tolist()))
    assert set(got) == set(asked) and hits >= (1.0 if book.exact else 0.9) * 10 * len(asked)
