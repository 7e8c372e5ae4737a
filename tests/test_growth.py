"""What intermediate rows hang on: distinct titles and names, not copies of them."""

from __future__ import annotations

import pytest

from quillon.operators import identity as idn


def _works(spark, copies: int = 300):
    titles = ["hot ring", "hot bolt", "hot rings", "cold plate"]
    return spark.createDataFrame([(k, titles[k % 4]) for k in range(4 * copies)], "work_id long, title string")


def _counted(monkeypatch, name: str) -> list:
    """Rows that each call of a function of identity gets."""
    seen, was = [], getattr(idn, name)

    def run(rows, *more):
        seen.append((more[0], rows.count()))
        return was(rows, *more)

    monkeypatch.setattr(idn, name, run)
    return seen


def test_titles_are_cut_before_they_are_multiplied(spark, monkeypatch):
    works, seen = _works(spark), _counted(monkeypatch, "keep_top")
    editions = works.selectExpr("work_id", "work_id + 10000 as edition_id")
    names = spark.createDataFrame([(1, "Ann")], "work_id long, name string")
    asked = spark.createDataFrame([(k, "hot ring", None, "title", "hot ring") for k in range(50)], "id long, title string, author string, kind string, q string")
    got = idn.local_by_title(asked, works, editions, names).collect()
    assert {(r["work_id"], r["edition_id"]) for r in got} == {(0, 10000)} and len(got) == 50
    assert max(n for _, n in seen) <= works.count() and seen[-1][1] <= 40


def test_legacy_requests_are_looked_up_once(spark, monkeypatch):
    works, names = _works(spark), spark.createDataFrame([(1, "Ann")], "work_id long, name string")
    asked = spark.createDataFrame([(k, "hot ring x" if k % 2 else "hot ring", None) for k in range(400)], "id long, title string, author string")
    seen = _counted(monkeypatch, "cut")
    got = idn.resolve_legacy(asked, works, names).collect()
    assert len(got) == 400 and {r["work_id"] for r in got if r["id"] % 2 == 0} == {0}
    assert dict(seen)["asked"] == 2 and dict(seen)["first-of-word"] <= 100


@pytest.mark.parametrize("name", ["upsert_works", "upsert_editions", "resolve_works", "resolve_urls"])
def test_growing_tables_are_not_broadcast(spark, name):
    from quillon.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_index_grows_by_lists_and_finds_neighbours_outside_its_sample(spark, monkeypatch):
    """Pairs of like vectors, of which the sample has few: lists come with the rows, and the fit asks all rows for neighbours."""
    import numpy as np

    from quillon.operators import index

    monkeypatch.setattr(index, "LIST_ROWS", 50)
    monkeypatch.setattr(index, "SAMPLE_MOST", 400)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1000, 16))
    x = np.repeat(base, 2, axis=0) + rng.normal(size=(2000, 16)) * 0.02
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "work_id long, embedding array<double>")
    book = index.fit(rows, 8, sample=200, k=1)
    assert len(book.centres) == 40 and not book.exact


def test_exact_search_in_blocks_with_ties(spark, monkeypatch):
    """Many equal vectors: the smallest ids win, in blocks of requests as of rows."""
    from quillon.operators import index

    monkeypatch.setattr(index, "EXACT_SHARD", 20)
    monkeypatch.setattr(index, "EXACT_ASKED", 2)
    rows = spark.createDataFrame([(k, [1.0, 0.5] if k < 60 else [0.0, 1.0]) for k in range(70)], "work_id long, embedding array<double>")
    asked = rows.where("work_id % 20 = 0").selectExpr("work_id as asked", "embedding as asked_vector")
    got = {}
    for r in index.exact(rows, asked, 3).collect():
        got.setdefault(r["asked"], []).append(r["work_id"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [1, 2, 3], 20: [0, 1, 2], 40: [0, 1, 2], 60: [61, 62, 63]}


def test_pairs_of_duplicates_are_not_ranked_one_by_one(spark, monkeypatch):
    """What is ranked hangs on names; a work takes its name's others as they are. An author beyond a row's AUTHORS counts too."""
    from quillon.operators import collaborative, resolve

    seen, was = [], collaborative.keep_top
    monkeypatch.setattr(collaborative, "keep_top", lambda rows, *more: (seen.append(rows.count()), was(rows, *more))[1])
    works = spark.createDataFrame([(k, "blue ring", "Ann Lee" if k else None) for k in range(200)], "work_id long, title string, author string")
    authors = spark.createDataFrame([(0, f"zz{k}") for k in range(40)] + [(0, "zzz Lee Ann"), (0, "Ann Lee"), (3, "Ann Lee")], "work_id long, name string")
    got = {(r["work_id"], r["other_id"]) for r in resolve.potential_duplicates(works, authors).collect()}
    want = {(0, k) for k in range(1, 11)} | {(k, o) for k in range(1, 200) for o in (0, 3) if o != k}
    assert got == want and max(seen) <= 200


def _legacy_plainly(spark, asked, works, names):
    """resolve_legacy by a plain join of every input with every row of works and authors."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillon.functions import text

    rows = works.select("work_id", F.lower("title").alias("name")).join(names.select("work_id", F.lower("name").alias("by")), "work_id", "left")
    each = asked.select("id", F.trim(F.lower("title")).alias("q"), F.trim(F.lower("author")).alias("author"))
    like = F.when((F.col("author") != "") & F.col("by").isNotNull(), text.dice_similarity("author", "by"))
    equal = each.join(rows, F.col("q") == F.col("name")).withColumn("like", like)
    one = equal.groupBy("id").agg(F.count("*").alias("n"), F.min("work_id").alias("f"), F.min(F.when(F.col("like") >= 0.8, F.col("work_id"))).alias("l"))
    exact = one.select("id", F.when((F.col("n") > 1) & F.col("l").isNotNull(), F.col("l")).otherwise(F.col("f")).alias("work_id"), F.when(F.col("n") == 1, 0.9).when(F.col("l").isNotNull(), 0.95).otherwise(0.7).alias("c"))
    word = F.split("q", "\\s+")[0]
    left = each.join(one, "id", "left_anti").where(F.length(word) >= 2)
    near = left.crossJoin(rows).where(F.expr("startswith(name, split(q, '\\\\s+')[0])")).withColumn("s", text.dice_similarity("q", "name")).where("s >= 0.6").withColumn("like", like)
    scored = near.withColumn("c", F.round(F.when(F.col("like") >= 0.7, F.least(F.lit(1.0), F.col("s") + 0.1)).otherwise(F.col("s")), 9))
    best = scored.withColumn("z", F.row_number().over(Window.partitionBy("id").orderBy(F.col("c").desc(), "work_id"))).where("z = 1 and c >= 0.7").select("id", "work_id", "c")
    return {(r["id"], r["work_id"], round(r["c"], 6)) for r in exact.unionByName(best).collect()}


def test_legacy_looks_at_all_works_of_a_title_and_all_titles_of_a_word(spark):
    titles = [(k, "hot ring") for k in range(150)] + [(k, f"hot plate {k}") for k in range(150, 300)] + [(300, "hot ringer")]
    works = spark.createDataFrame(titles, "work_id long, title string")
    names = spark.createDataFrame([(k, f"zzz {k}") for k in range(300)] + [(149, "Ann Lee")], "work_id long, name string")
    asked = spark.createDataFrame([(1, "Hot Ring", "Ann Lee"), (2, "hot ringers", ""), (3, "hot plate 299 x", "zzz 299"), (4, "hot rings", "Ann Lee")], "id long, title string, author string")
    got = {(r["id"], r["work_id"], round(r["confidence"], 6)) for r in idn.resolve_legacy(asked, works, names).collect()}
    assert {k: w for k, w, _ in got} == {1: 149, 2: 300, 3: 299, 4: 149} and (1, 149, 0.95) in got
    assert got == _legacy_plainly(spark, asked, works, names)


def test_legacy_equals_a_plain_join_on_odd_titles(spark, monkeypatch):
    import random

    monkeypatch.setattr(idn, "BLOCK", 3)  # also bigrams of more than one block
    draw = random.Random(4)
    words, authors = ["hot", "ho", "hotel", "a", "??", "ring", "rings", "bolt", "b.", "é", "new-one", "1"], ["Ann Lee", "Anne Lee", "Bob Stone", "Bo Stone", "?", "Li", None]
    title = lambda: draw.choice(["hot", "ho", "hotel", "??", "b."]) + "".join(" " + draw.choice(words) for _ in range(draw.randrange(4)))
    works = spark.createDataFrame([(k % 190, title() if k % 17 else None) for k in range(200)], "work_id long, title string")
    names = spark.createDataFrame([(draw.randrange(200), draw.choice(authors)) for _ in range(250)], "work_id long, name string")
    asked = spark.createDataFrame([(k, title() if k % 13 else None, draw.choice(authors) or "") for k in range(150)], "id long, title string, author string")
    got = {(r["id"], r["work_id"], round(r["confidence"], 6)) for r in idn.resolve_legacy(asked, works, names).collect()}
    want = _legacy_plainly(spark, asked, works, names)
    assert got == want and len({c for _, _, c in want}) > 6


def _shuffled_rows(df) -> int:
    """Rows that a query's shuffles wrote."""
    df.collect()

    def of(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(of(plan.children().apply(i)) for i in range(plan.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_favourites_are_not_shuffled_value_by_value(spark):
    """A reader's works have many authors: what is shuffled hangs on the works read, not on their authors. Names that two authors
    share, that are null, and that hold more than a block of numbers."""
    import collections
    import json

    from quillon.operators import reading as rd

    events = [(u, w, "read" if (u + w) % 7 else "dnf", (u * w) % 5 + 1) for u in range(40) for w in range(u % 3, 60, 5)] + [(None, 1, "read", 3), (50, None, "read", None), (51, 999, "read", 4)]
    name = lambda a: None if a == 8 else f"n{a % 90:03d}"
    pairs = sorted({(w, (w * 17 + a * a) % 120) for w in range(60) for a in range(50)})
    subjects = [(w, f"s{(w * k) % 9}") for w in range(60) for k in range(1, 4)] + [(3, None)]
    e = spark.createDataFrame(events, "user_id long, work_id long, shelf string, rating int")
    about = spark.createDataFrame(subjects, "work_id long, subject string").distinct()
    by = spark.createDataFrame(pairs + [(None, 1), (1, None)], "work_id long, author_id long")
    authors = spark.createDataFrame([(a, name(a)) for a in range(120)] + [(5, "n005")], "author_id long, name string")

    def plainly(values: dict) -> dict:
        seen = collections.defaultdict(collections.Counter)
        for u, w, shelf, _ in events:
            if shelf == "read" and u is not None:
                seen[u].update(values.get(w, []))
        return {u: [v for v, _ in sorted(c.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:5]] or None for u, c in seen.items()}

    names, kinds = collections.defaultdict(list), collections.defaultdict(list)
    for w, a in pairs:
        names[w] += [name(a)] * (2 if a == 5 else 1)
    for w, s in set(subjects):
        kinds[w].append(s)
    got = rd.taste(e, about, by, authors=authors)
    rows = {r["user_id"]: r for r in got.collect() if r["user_id"] is not None}
    assert {u: r["top_subjects"] for u, r in rows.items()} == plainly(kinds) and {u: r["top_authors"] for u, r in rows.items()} == plainly(names)
    named = by.join(authors, "author_id").select("work_id", "name")
    assert json.dumps(sorted(map(str, got.collect()))) == json.dumps(sorted(map(str, rd.taste(e, about, named).collect())))
    assert _shuffled_rows(rd.taste(e, about, by, authors=authors)) < 6 * len(events)


def test_numbers_beyond_a_block(spark, monkeypatch):
    from quillon.operators import reading as rd

    monkeypatch.setattr(rd, "PLACES", 4)
    e = spark.createDataFrame([(1, w, "read", 1) for w in range(6)], "user_id long, work_id long, shelf string, rating int")
    about = spark.createDataFrame([(w, f"s{w + k:02d}") for w in range(6) for k in range(12)], "work_id long, subject string")
    assert [r["top_subjects"] for r in rd.taste(e, about, k=8).collect()] == [["s05", "s06", "s07", "s08", "s09", "s10", "s11", "s04"]]


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from quillon.operators.lineage import SHUFFLES_GO, cut

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    was, before = spark.conf.get(SHUFFLES_GO), files()
    rows = cut(spark.range(10_000).repartition(4, "id"))
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and rows.count() == 10_000 and spark.conf.get(SHUFFLES_GO) == was


def test_kept_events_are_the_latest_lines(spark, tmp_path):
    """Lines of one order and work, of several orders on one day, and orders without a day or a reader."""
    import datetime
    import random

    from quillon.sources.fixtures import Catalogue

    draw = random.Random(2)
    days = [datetime.datetime(2000, 1, k + 1) for k in range(3)] + [None]
    orders = [(k % 70, draw.choice([1, 2, 3, None]), draw.choice("FOP"), draw.choice(days)) for k in range(80)]
    lines = [(draw.randrange(80), draw.choice([1, 2, 3, None]), draw.choice([1, 2]), draw.choice([1, 2]), float(draw.choice([7, 48])), float(draw.choice([1, 2])), draw.choice(["A", "N", None]), draw.choice("FO")) for _ in range(2000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = Catalogue(spark, str(tmp_path))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(c.kept_events) == rows(c.user_event) and c.kept_events.columns == c.user_event.columns
