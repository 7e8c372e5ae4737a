"""Queries over updates, validity, queues of work, explanations and the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scoring, text
from quillon.operators import index as ix
from quillon.operators import ratings as rt
from quillon.operators import resolve as rs
from quillon.operators.lineage import files, table
from quillon.plans.ratings import CO_VIEWS, PAIRS_SQL
from quillon.plans.recommend import USER, _anchors, _base
from quillon.sources import sinks
from quillon.sources.fixtures import Catalogue, sql


def _described(c: Catalogue):
    k = F.col("work_id")
    return c.work.select("work_id", "title", F.when(k % 3 == 0, F.concat(F.lit("About "), "title")).alias("description"), (k % 4 == 1).alias("is_stub"), F.when(k % 5 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("volume_id"), F.when(k % 2 == 0, F.concat(F.lit("979"), F.lpad(k.cast("string"), 10, "0"))).alias("isbn13"), F.when(k % 6 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("cover_url"))


DESCRIBED_SQL = "select work_id, title, case when work_id % 3 = 0 then concat('About ', title) end description, work_id % 4 = 1 is_stub, case when work_id % 5 = 0 then concat('v', work_id) end volume_id, case when work_id % 2 = 0 then concat('979', lpad(work_id::varchar, 10, '0')) end isbn13, case when work_id % 6 = 0 then concat('c', work_id) end cover_url from work"


def _queue(c: Catalogue, rows, k: int = 200):
    """Works with the identifiers that look-ups succeed with first, stubs before others, then by id."""
    first = F.when(F.col("volume_id").isNotNull(), 0).when(F.col("isbn13").isNotNull(), 1).otherwise(2)
    return rows.select("work_id", first.alias("rank"), "is_stub").orderBy("rank", F.col("is_stub").desc(), "work_id").limit(k)


def _medians(c: Catalogue):
    """K9: page counts of works from the medians of their editions."""
    works = c.table("part").select(F.col("p_partkey").alias("work_id"), F.when(F.col("p_partkey") % 2 == 0, F.lit(1)).alias("page_count_median"))
    return sinks.update_from(works, rt.page_medians(c.edition.where("work_id % 3 <> 0")), ["work_id"], ["page_count_median"])


def _favourites(c: Catalogue):
    """Blocks of works after some were put in and others were taken out."""
    old = c.block.where("work_id is not null").select("user_id", "work_id").distinct()
    add = c.table("events").where("event_type = 'view'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("work_id"))
    remove = c.table("events").where("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("work_id")).distinct()
    return sinks.toggle(old, add, remove, ["user_id", "work_id"])


def _checked(c: Catalogue):
    """ratings and events that break a rule, by rule."""
    rows = c.table("events").select("event_id", "event_type", F.round(F.col("value") / 50).cast("int").alias("rating"), F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"))
    good, bad = sinks.quarantine(rows, {"rating": F.col("rating").between(1, 5), "kind": F.col("event_type").isin("view", "click", "purchase"), "reader": F.col("user_id").isNotNull()})
    return bad.groupBy("broken_rule").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("none").alias("broken_rule"), F.count("*").alias("n")))


def _page(c: Catalogue, number: int = 3, size: int = 40):
    """A page with the number of rows and pages; the size is clamped."""
    rows = c.work.select("work_id", "title", "first_publish_year").where("first_publish_year >= 1970")
    size = max(1, min(size, 50))
    total = rows.agg(F.count("*").alias("total"))  # one row
    part = rows.orderBy(F.col("first_publish_year").desc(), "work_id").offset((number - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def _explained(c: Catalogue, k: int = 20):
    """The reader's best k candidates with title, cover, authors, subjects, grade and what speaks for each."""
    top = _base(c).orderBy(F.col("base").desc(), "work_id").limit(k)
    ids = F.broadcast(top.select("work_id"))
    by = c.work_author.join(ids, "work_id", "left_semi").join(c.author, "author_id").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("authors"))
    about = c.work_subject.join(ids, "work_id", "left_semi").groupBy("work_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("subject")), 1, 5), ", ").alias("subjects"))
    none = F.lit(None).cast("string")
    cover = text.cover_url(none, none, none, none, F.col("ol_work_key"), none)
    anchor = _anchors(c, 1).join(c.work, F.col("anchor") == F.col("work_id")).select(F.col("title").alias("anchor_title"))
    rows = top.join(c.work.select("work_id", "title", "first_publish_year", "ol_work_key"), "work_id").join(by, "work_id", "left").join(about, "work_id", "left").join(rt.quality(c.of_works(top).rating).select("work_id", "blended_avg", "total_ratings"), "work_id", "left").join(F.broadcast(anchor), how="left")
    points = F.array_join(F.filter(F.array(F.when(F.col("relevance") > 0.5, F.lit("near your taste")), F.when(F.col("quality") > 0.5, F.lit("well rated")), F.when(F.col("engagement") > 0, F.lit("you read it lately")), F.when(F.col("graph") > 0.5, F.lit("like what you liked"))), lambda x: x.isNotNull()), "; ")
    return rows.select("work_id", "title", "first_publish_year", cover.alias("cover_url"), "authors", "subjects", scoring.grade(F.col("base")).alias("grade"), F.round("blended_avg", 4).alias("rating"), "total_ratings", points.alias("highlights"))


def _indexed(c: Catalogue, name: str, rows, lists: int):
    """The index of rows (work_id, embedding) and its fit. The fit takes a bounded sample; rows are written once."""
    book = ix.fit(rows, lists)
    path = files(c.spark, c.dir, f"ivf-{name}", lambda p: ix.build(rows, book, p))
    return c.spark.read.parquet(path), book


def _index_search(c: Catalogue):
    """Ten nearest works of each work whose id is divisible by 20. The test vectors have no structure, as the fit finds, so
    every request meets every row."""
    index, book = _indexed(c, "works", c.work.select("work_id", "embedding"), 16)
    asked = c.work.where("work_id % 20 = 0").select("work_id", "embedding")
    return ix.search(index, asked, book).select("asked", "work_id", F.round("similarity", 6).alias("similarity"))


def clustered(c: Catalogue, copies: int = 12):
    """Vectors with structure: each of the table's with some of its like, turned a little by a hash."""
    noise = lambda i: (F.pmod(F.xxhash64("vec_id", "copy", i), F.lit(2001)) - 1000) / 5000.0
    rows = c.table("embeddings").where("embedding is not null").repartition("vec_id").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    return rows.select((F.col("vec_id") * copies + F.col("copy")).cast("long").alias("work_id"), F.transform("v", lambda x, i: x + noise(i) * F.sqrt(F.lit(4.0) / F.size("v"))).alias("embedding"))


def _clustered_search(c: Catalogue):
    """V5c on vectors with structure: a few lists are read, and the best by codes are ranked again."""
    rows = table(c.spark, c.dir, "clustered-vectors", lambda: clustered(c))  # written once: the fit, the index and the requests read them
    index, book = _indexed(c, "clustered", rows, 64)
    return ix.search(index, rows.where("work_id % 20 = 0"), book).select("asked", "work_id", F.round("similarity", 6).alias("similarity"))


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        "page_median_update": on(_medians),
        "favourites_toggle": on(_favourites),
        "block_status": on(lambda c: c.user_event.where(F.col("user_id") == USER).select("work_id").join(c.block.where((F.col("user_id") == USER) & F.col("work_id").isNotNull()).select("work_id").distinct().withColumn("blocked", F.lit(True)), "work_id", "left").select("work_id", F.coalesce("blocked", F.lit(False)).alias("blocked"))),
        "seed_key_backfill": on(lambda c: sinks.seed_ids(c.table("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/works/OL"), F.col("p_partkey").cast("string"), F.lit("W"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/books/OL"), F.col("p_partkey").cast("string"), F.lit("M"))).otherwise("/works/x").alias("seed_key")))),
        "quarantine": on(_checked),
        "cooccurrence_stats": on(lambda c: c.cooccurrence.agg(F.count("*").alias("pairs"), F.count_distinct("a").alias("works"), F.round(F.avg(F.col("jaccard").cast("double")), 4).alias("avg_jaccard"), F.round(F.avg("overlap"), 4).alias("avg_overlap"))),
        "pagination": on(_page),
        "pagination_by_key": on(lambda c: rs.page_after(c.work.select("work_id", "title", "first_publish_year"), "first_publish_year", "work_id", (1985, 100), 40)),
        "placeholder_queue": on(lambda c: c.work.select("work_id", F.when(F.col("work_id") % 9 == 0, F.lit("Unknown title")).otherwise(F.col("title")).alias("title")).where(F.col("title").ilike("unknown%")).join(c.edition.groupBy("work_id").agg(F.min("asin").alias("asin")), "work_id")),
        "stub_queue": on(lambda c: _queue(c, _described(c).where("is_stub"))),
        "missing_data_queue": on(lambda c: _queue(c, _described(c).where("is_stub or description is null or cover_url is null"))),
        "description_queue": on(lambda c: _described(c).where("description is null and isbn13 is not null").join(c.reading_log.groupBy("work_id").agg(F.count_distinct("user_id").alias("readers")), "work_id").select("work_id", "isbn13", "readers").orderBy(F.col("readers").desc(), "work_id").limit(100)),
        "own_works_queue": on(lambda c: _queue(c, _described(c).where("is_stub or description is null or cover_url is null").join(c.user_event.where(F.col("user_id") == USER).select("work_id"), "work_id", "left_semi"))),
        "explanations": on(_explained),
        "vector_index_search": on(_index_search),
        "vector_index_clustered": on(_clustered_search),
    }


def oracle_sql() -> dict[str, str]:
    queue = lambda where: sql(f"select work_id, case when volume_id is not null then 0 when isbn13 is not null then 1 else 2 end as rank, is_stub from d where {where} order by 2, is_stub desc, work_id limit 200", "work user_event", d=DESCRIBED_SQL)
    missing = "(is_stub or description is null or cover_url is null)"
    return {
        "page_median_update": sql("select p_partkey work_id, coalesce(m, case when p_partkey % 2 = 0 then 1 end) page_count_median from part left join (select work_id, round_even(quantile_cont(page_count, 0.5), 0)::int m from edition where work_id % 3 <> 0 group by 1) on p_partkey = work_id", "edition"),
        "favourites_toggle": sql("select distinct user_id, work_id from (select user_id, work_id from block where work_id is not null union all select user_id, k from e where event_type = 'view') where (user_id, work_id) not in (select user_id, k from e where event_type = 'click')", "block", e="select user_id, event_type, json_extract_string(props, '$.k')::bigint k from events"),
        "block_status": sql(f"select work_id, work_id in (select work_id from block where user_id = {USER} and work_id is not null) blocked from user_event where user_id = {USER}", "user_event block"),
        "seed_key_backfill": "select p_partkey, case p_partkey % 3 when 0 then concat('/works/OL', p_partkey, 'W') when 1 then concat('/books/OL', p_partkey, 'M') else '/works/x' end seed_key, case when p_partkey % 3 = 0 then concat('OL', p_partkey, 'W') end work_key from part",
        "quarantine": "select broken_rule, count(*) n from (select case when not (round(value / 50)::int between 1 and 5) then 'rating' when event_type not in ('view', 'click', 'purchase') then 'kind' when event_id % 13 = 0 then 'reader' else 'none' end broken_rule from events) group by 1",
        "cooccurrence_stats": sql("select count(*) pairs, count(distinct a) works, round(avg(jaccard::double), 4) avg_jaccard, round(avg(overlap), 4) avg_overlap from cooc", CO_VIEWS, **PAIRS_SQL),
        "pagination": sql("select work_id, title, first_publish_year, (select count(*) from work where first_publish_year >= 1970) total, ceil((select count(*) from work where first_publish_year >= 1970) / 40.0)::bigint pages from work where first_publish_year >= 1970 order by first_publish_year desc, work_id limit 40 offset 80", "work"),
        "pagination_by_key": sql("select work_id, title, first_publish_year from work where first_publish_year < 1985 or (first_publish_year = 1985 and work_id > 100) order by first_publish_year desc, work_id limit 40", "work"),
        "placeholder_queue": sql("select work_id, 'Unknown title' title, min(asin) asin from edition where work_id % 9 = 0 and work_id in (select work_id from work) group by 1", "work edition"),
        "stub_queue": queue("is_stub"),
        "missing_data_queue": queue(missing),
        "description_queue": sql("select work_id, isbn13, readers from d join (select work_id, count(distinct user_id) readers from reading_log group by 1) using (work_id) where description is null and isbn13 is not null order by readers desc, work_id limit 100", "work reading_log", d=DESCRIBED_SQL),
        "vector_index_search": sql("select asked, work_id, round(similarity, 6) similarity from (select x.work_id asked, y.work_id, round(list_cosine_similarity(x.embedding, y.embedding), 9) similarity, row_number() over (partition by x.work_id order by round(list_cosine_similarity(x.embedding, y.embedding), 9) desc, y.work_id) r from work x join work y on x.work_id <> y.work_id where x.work_id % 20 = 0 and x.embedding is not null and y.embedding is not null) where r <= 10", "work"),
        "own_works_queue": queue(f"{missing} and work_id in (select work_id from user_event where user_id = {USER})"),
    }
