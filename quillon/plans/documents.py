"""Queries that give nested documents as JSON, and those over stored graphs, streams, and the embedding loop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import documents as dc
from quillon.operators import embedding_loop as el
from quillon.operators import graph_store as gs
from quillon.operators import ratings as rt
from quillon.operators import reading as rd
from quillon.operators.collaborative import keep_top
from quillon.operators.lineage import cut, files, shared_folder
from quillon.plans.ratings import QUALITY_SQL
from quillon.plans.reading import EDGES_SQL, TOTALS_SQL, USER, WEIGHT_SQL, WEIGHT_VIEWS, totals, weighted
from quillon.sources.fixtures import Catalogue, sql
from quillon.sources.versions import Store
from quillon.streaming import stateful


def _contributors(c: Catalogue):
    """Authors of works by the lines' suppliers of the largest orders, with a role."""
    role = F.element_at(F.array(F.lit("translator"), F.lit("author"), F.lit("editor"), F.lit(None)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    lines = c.table("lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("id"), role.alias("role")).distinct()
    return lines.join(c.author.select(F.col("author_id").alias("id"), "name"), "id")


CONTRIBUTORS_SQL = "select distinct l_partkey work_id, l_suppkey id, s_name as name, ['translator', 'author', 'editor', null][l_suppkey % 4 + 1] as role from lineitem join supplier on l_suppkey = s_suppkey where l_quantity >= 45"


def _book_documents(c: Catalogue):
    none = F.lit(None).cast("string")
    cover = text.cover_url(none, none, none, none, F.col("ol_work_key"), none)
    works = c.work.select("work_id", "title", "first_publish_year", "series", "ol_work_key")
    own = totals(c).where(F.col("user_id") == USER)
    return dc.book_documents(works.where("work_id % 20 = 0").select("work_id"), works, _contributors(c), c.work_subject, c.edition, rt.quality(c.rating), own, cover)


def _highlights(c: Catalogue):
    return dc.engagement_highlights(totals(c), c.work, _contributors(c))


def _profiles(c: Catalogue):
    lines = c.table("lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("author_id"))
    # Lines are made distinct where the join with their authors has them.
    summary = rd.taste(c.kept_events, c.work_subject, lines.repartition("author_id").distinct(), authors=c.author)
    return dc.profile_documents(summary, cut(rd.anchors(weighted(c)), "anchors"), c.work)


def letters(texts: list[str]) -> list[list[float]]:
    """A deterministic encoder for tests and queries: counts of the letters a to z. It refuses batches with a text that names
    one brand, and always texts that name another."""
    if any("brand#13" in t for t in texts) or (len(texts) > 1 and any("brand#21" in t for t in texts)):
        raise ValueError("refused")
    return [[float(t.count(chr(k))) for k in range(97, 123)] for t in texts]


def _embedded(c: Catalogue):
    """Two runs over works that have no vector yet; the second finds only those that failed."""
    works = c.work.select("work_id", F.lower(F.concat_ws(" ", "title", "series")).alias("text"))
    store = Store(c.spark, f"{shared_folder(c.spark)}/quillon/vectors-{uuid.uuid4().hex}", el.TABLES)
    for _ in range(2):
        el.run(works, store, letters, batch=20, slices=2)
    good = store.read("vectors").select("work_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("letters"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("attempts"))
    return good.unionByName(store.read("dead").select("work_id", F.lit(None).cast("string").alias("letters"), "error", "attempts"))


PER_NODE, PER_WORK = 40, 4


def _stored_graph(c: Catalogue):
    edges = gs.capped(gs.typed_edges(c.work_author, c.work_subject, c.work), PER_NODE, PER_WORK)
    return gs.store(edges)


def _stream(c: Catalogue):
    """2.12: events in files by a hash, so that they arrive out of order, and a last file whose one event is far later: with it
    the watermark passes every session."""
    e = c.table("events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")

    def write(path: str) -> None:
        e.repartition(6, F.xxhash64("event_id")).drop("event_id").write.parquet(path)
        last = e.agg((F.max("ts") + F.expr("interval 100 days")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(0.0).alias("value"))
        last.coalesce(1).write.mode("append").parquet(path)

    folder = files(c.spark, c.dir, "event-stream", write)
    rows = c.spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 2).parquet(folder)
    out = f"{shared_folder(c.spark)}/quillon/sessions-{uuid.uuid4().hex}"
    stateful.run_to_end(stateful.stream_sessions(rows, 30, "60 days"), f"{out}/rows", f"{out}/checkpoint")
    return c.spark.read.schema("user_id long, session_start timestamp, last_event timestamp, events long, value double").parquet(f"{out}/rows")


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    asked = lambda c: c.work.where("work_id % 20 = 0")
    return {
        "book_documents": on(_book_documents),
        "engagement_highlights": on(_highlights),
        "profile_documents": on(_profiles),
        "authors_in_order": on(lambda c: dc.nested(_contributors(c).select("work_id", "id", "name", "role"), "work_id", [dc.role_rank(F.col("role")), F.col("name"), F.col("id")], ["name"], "names").select("work_id", F.array_join("names", ", ").alias("authors"), F.size("names").cast("long").alias("n"))),
        "embedding_loop": on(_embedded),
        "graph_capped_edges": on(lambda c: gs.capped(gs.typed_edges(c.work_author, c.work_subject, c.work), PER_NODE, PER_WORK)),
        "graph_store_two_hops": on(lambda c: _stored_graph(c).two_hops(asked(c))),
        "stream_sessions": on(_stream),
    }


def oracle_sql() -> dict[str, str]:
    rank = "case role when 'author' then 0 when 'editor' then 1 when 'translator' then 2 else 3 end"
    edges = EDGES_SQL.replace("concat('a', author_id) node", "'author' kind, author_id::varchar node").replace("concat('s', subject)", "'subject', subject").replace("concat('r', series)", "'series', series")
    capped = {
        "edges": edges,
        "drawn": "select distinct work_id, kind, node, md5(concat_ws(':', '7', kind, node, work_id::varchar)) d from edges",
        "few": f"select work_id, kind, node, d from (select *, row_number() over (partition by kind, node order by d, work_id) r from drawn) where r <= {PER_NODE}",
        "kept": f"select work_id, kind, node from (select *, row_number() over (partition by work_id order by d, kind, node) r from few) where r <= {PER_WORK}",
    }
    profile = WEIGHT_SQL | {
        "read": "select user_id, count(*) works_read, round(avg(rating), 6) a from user_event where shelf = 'read' group by 1",
        "tops": "select user_id, list(subject order by r) s from (select user_id, subject, row_number() over (partition by user_id order by count(*) desc, subject) r from user_event join work_subject using (work_id) where shelf = 'read' group by 1, 2) where r <= 5 group by 1",
        "topa": "select user_id, list(name order by r) a from (select user_id, name, row_number() over (partition by user_id order by count(*) desc, name) r from user_event join (select distinct l_partkey work_id, s_suppkey, s_name as name from lineitem join supplier on l_suppkey = s_suppkey) using (work_id) where shelf = 'read' group by 1, 2) where r <= 5 group by 1",
        "anchor": "select user_id, work_id, w, row_number() over (partition by user_id order by w desc, work_id) p from (select user_id, work_id, round(weight, 6) w from weighted where weight > 0)",
        "anchored": "select user_id, list(struct_pack(work_id := work_id, title := title, weight := w::decimal(18,6)::varchar) order by p) l from anchor join work using (work_id) where p <= 10 group by 1",
    }
    return {
        "book_documents": sql(
            f"""select work_id, to_json(struct_pack(id := work_id, title := title, year := first_publish_year, series := series, cover := concat('https://covers.openlibrary.org/w/olid/', ol_work_key, '-M.jpg'), authors := coalesce(a, []), subjects := coalesce(s, []), editions := coalesce(e, []),
            rating := case when q.work_id is not null then struct_pack(average := round(blended_avg, 4)::decimal(10,4)::varchar, count := total_ratings) end, reading := case when t.work_id is not null then struct_pack(total_ms := total_ms, sessions := sessions) end))::varchar document
            from work left join (select work_id, list(struct_pack(id := id, name := name, role := role) order by {rank}, name, id) a from contributors group by 1) using (work_id) left join (select work_id, list(subject order by subject) s from work_subject group by 1) using (work_id)
            left join (select work_id, list(struct_pack(asin := asin, page_count := page_count) order by asin, page_count) e from (select distinct * from edition) group by 1) using (work_id) left join quality q using (work_id) left join (select * from totals where user_id = {USER}) t using (work_id) where work_id % 20 = 0""",
            "work work_subject edition rating session", contributors=CONTRIBUTORS_SQL, totals=TOTALS_SQL, **QUALITY_SQL,
        ),
        "engagement_highlights": sql(
            """select user_id, to_json(list(struct_pack(title := title, authors := coalesce(a, []), minutes := total_ms // 60000, last_read := strftime(last_read_at, '%Y-%m-%d %H:%M:%S')) order by r))::varchar highlights
            from (select t.*, title, row_number() over (partition by user_id order by total_ms desc nulls last, last_read_at desc nulls last, work_id) r from totals t join work using (work_id)) left join (select work_id, list(distinct name order by name) a from contributors group by 1) using (work_id) where r <= 3 group by 1""",
            "work session", totals=TOTALS_SQL, contributors=CONTRIBUTORS_SQL,
        ),
        "profile_documents": sql("select user_id, to_json(struct_pack(user_id := user_id, works_read := works_read, avg_rating := read.a::decimal(10,4)::varchar, top_subjects := coalesce(s, []), top_authors := coalesce(topa.a, []), anchors := coalesce(l, [])))::varchar document from read left join tops using (user_id) left join topa using (user_id) left join anchored using (user_id)", WEIGHT_VIEWS + " work work_subject", **profile),
        "authors_in_order": sql(f"select work_id, string_agg(name, ', ' order by {rank}, name, id) authors, count(*) n from contributors group by 1", "", contributors=CONTRIBUTORS_SQL),
        "embedding_loop": sql("select work_id, case when not bad then array_to_string(list_transform(range(97, 123), lambda k: length(t) - length(replace(t, chr(k::int), ''))), ',') end letters, case when bad then 'ValueError: refused' end error, case when bad then 2 end attempts from (select work_id, lower(concat_ws(' ', title, series)) t, lower(series) = 'brand#13' bad from work)", "work"),
        "graph_capped_edges": sql("select * from kept", "work work_author work_subject", **capped),
        "graph_store_two_hops": sql("select x.work_id, y.work_id other_id, count(*) shared from kept x join kept y on x.kind = y.kind and x.node = y.node and x.work_id <> y.work_id where x.work_id % 20 = 0 group by 1, 2", "work work_author work_subject", **capped),
        "stream_sessions": "select user_id, min(ts) session_start, max(ts) last_event, count(*) events, round(sum(value), 4) value from (select *, sum(gap) over (partition by user_id order by ts, event_id rows unbounded preceding) s from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 1 else 0 end gap from events)) group by user_id, s",
    }
