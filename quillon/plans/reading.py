"""Queries over the graph, reading sessions and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import graph as gr
from quillon.operators import reading as rd
from quillon.plans.ratings import CO_VIEWS, PAIRS_SQL, WORK
from quillon.sources.fixtures import EVENTS_AS_OF, SESSIONS_AS_OF, Catalogue, as_of, sql

USER = 1
#: Reading signals of the fixture's events are joined to the orders' readers by the same ids.
WEIGHT_VIEWS = "user_event session completion ownership work_author"
TOTALS_SQL = f"select user_id, work_id, sum(duration_ms)::bigint total_ms, count(*) sessions, max(duration_ms) max_ms, avg(duration_ms) avg_ms, coalesce(sum(duration_ms) filter (start_at >= timestamp '{SESSIONS_AS_OF}' - interval 30 days), 0)::bigint last30_ms, max(start_at) last_read_at from session group by 1, 2"
WEIGHT_SQL = {
    "totals": TOTALS_SQL,
    "done": "select user_id, work_id, count(*) completions from completion group by 1, 2",
    "owned": "select distinct user_id, work_id, 'Purchase' origin from ownership",
    "by_author": "select user_id, e.work_id, author_id from user_event e join work_author a on e.work_id = a.work_id",
    "loyalty": "select b.user_id, b.work_id, max(n) author_works from by_author b join (select user_id, author_id, count(distinct work_id) n from by_author group by 1, 2) c on b.user_id = c.user_id and b.author_id = c.author_id group by 1, 2",
    "ev": "select *, date_diff('day', lag(finished_at) over (partition by user_id order by finished_at nulls last, work_id, source), finished_at) gap from user_event",
    "joined": "select e.*, total_ms, max_ms, avg_ms, last30_ms, last_read_at, completions, origin, author_works from ev e left join totals t on e.user_id = t.user_id and e.work_id = t.work_id left join done d on e.user_id = d.user_id and e.work_id = d.work_id left join owned o on e.user_id = o.user_id and e.work_id = o.work_id left join loyalty l on e.user_id = l.user_id and e.work_id = l.work_id",
    "parts": f"""select *, coalesce(total_ms, 0) / 3600000.0::double h, coalesce(completions, 0) c, coalesce(avg_ms / 60000.0::double, 0) am, coalesce(max_ms / 60000.0::double, 0) mm,
      greatest(0.0::double, (epoch(timestamp '{EVENTS_AS_OF}') - epoch(coalesce(finished_at, last_read_at))) / (365.0::double * 86400)) yrs from joined""",
    "weighted": """select *, (case when rating is null then 1 else pow(2.0::double, (rating - 3) / 2.0::double) end) * (case when rating = 5 then 2.0::double else 1 end)
      * (case when yrs is null then 1 else pow(0.5::double, yrs / (case when c >= 3 or am >= 15 or mm >= 120 then 4.0::double else 2 end)) end)
      * (1 + least(1.0::double, log10(h + 1))) * (case when coalesce(last30_ms, 0) > 0 then 1.1::double else 1 end)
      * (case when c >= 2 then least(3.0::double, pow(1.5::double, c - 1)) else 1 end) * ((1 + least(0.5::double, am / 30)) * (1 + least(0.5::double, mm / 240)))
      * (case when coalesce(author_works, 0) >= 3 then least(2.0::double, 1 + (author_works - 2) * 0.25::double) else 1 end)
      * (case when gap between 0 and 3 then 1.3::double else 1 end) * (case when origin = 'Purchase' then 1.15::double else 1 end)
      * (case when shelf = 'read' then 1 when shelf = 'currently-reading' then 0.8::double when shelf = 'to-read' then 0.3::double when shelf = 'dnf' and h >= 6 then 0 when shelf = 'dnf' then -0.5::double else 1 end) weight from parts""",
}
TASTE_SQL = WEIGHT_SQL | {
    "flat": "select user_id, weight, unnest(embedding) x, generate_subscripts(embedding, 1) k from weighted join work using (work_id) where embedding is not null",
    "means": "select user_id, k, sum(weight * x) filter (weight > 0) / sum(weight) filter (weight > 0) plus, sum(weight * x) filter (weight < 0) / sum(weight) filter (weight < 0) minus from flat group by 1, 2",
    "taste": "select user_id, k, plus - 0.3::double * coalesce(minus, 0) x from means where plus is not null",
    "unit": "select user_id, k, x / sqrt(sum(x * x) over (partition by user_id)) x from taste",
}
EDGES, ROUNDS = 0.05, 15
LPA_SQL = PAIRS_SQL | {
    "edge": f"select a, b, jaccard w from cooc where jaccard >= {EDGES} union all select b, a, jaccard from cooc where jaccard >= {EDGES}",
    "l0": "select distinct a node, a as label from edge",
} | {
    f"l{k}": f"select node, label from (select *, row_number() over (partition by node order by w desc, label) r from (select a node, label, sum(w) w from edge join l{k - 1} on b = node group by 1, 2)) where r = 1" for k in range(1, ROUNDS + 1)
} | {"community": f"select node, label, size from l{ROUNDS} join (select label, count(*) size from l{ROUNDS} group by 1 having count(*) >= 5) using (label)"}


EDGES_SQL = "select work_id, concat('a', author_id) node from work_author union all select work_id, concat('s', subject) from work_subject union all select work_id, concat('r', series) from work where series is not null"


def totals(c: Catalogue):
    return rd.aggregate_sessions(c.session, as_of(SESSIONS_AS_OF))


def weighted(c: Catalogue, user: int | None = None):
    """All readers' events with their weights, or one reader's, whose rows are picked before anything is joined or added up."""
    of = c if user is None else c.of_reader(user)
    sums = rd.aggregate_sessions(of.session, as_of(SESSIONS_AS_OF))
    return rd.weighted_events(c.kept_events if user is None else of.user_event, sums, of.completion, of.ownership, c.work_author, as_of(EVENTS_AS_OF))


def graph_edges(c: Catalogue):
    a = c.work_author.select("work_id", F.concat(F.lit("a"), F.col("author_id").cast("string")).alias("node"))
    series = c.work.where("series is not null").select("work_id", F.concat(F.lit("r"), "series"))
    return a.unionAll(c.work_subject.select("work_id", F.concat(F.lit("s"), "subject"))).unionAll(series)


def _new_events(c: Catalogue):
    shelf = F.when(F.col("event_type") == "purchase", "read").when(F.col("event_type") == "view", "currently-reading").when(F.col("event_type") == "error", "dnf").otherwise("to-read")
    return c.table("events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("work_id"), shelf.alias("shelf"), F.col("ts").alias("finished_at"))


NEW_EVENTS_SQL = "select user_id, json_extract_string(props, '$.k')::bigint work_id, case event_type when 'purchase' then 'read' when 'view' then 'currently-reading' when 'error' then 'dnf' else 'to-read' end shelf, ts finished_at from events"


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    ms = lambda name: F.round(name, 4).alias(name)
    return {
        "graph_neighbors_2hop": on(lambda c: gr.two_hops(graph_edges(c), WORK)),
        "graph_features": on(lambda c: gr.user_features(c.of_reader(USER).user_event, c.work, c.work_author, c.work_subject, USER).withColumn("prox", F.round("prox", 6))),
        "label_propagation": on(lambda c: c.label),
        "community_metadata": on(lambda c: gr.community_top(c.community, c.work_subject, "subject", "top_subjects")),
        "community_authors": on(lambda c: gr.community_top(c.community, c.work_author.join(c.author, "author_id").select("work_id", "name"), "name", "top_authors")),
        "stale_events_update": on(lambda c: rd.mark_stale(c.user_event, totals(c), c.completion, as_of("2024-02-20 00:00:00"))),
        "community_candidates": on(lambda c: gr.community_candidates(c.community, c.work.where("work_id % 20 = 0"), 20)),
        "redirect_resolution": on(lambda c: gr.resolve_redirects(c.redirect)),
        "reading_aggregate": on(lambda c: totals(c).select("user_id", "work_id", "total_ms", "sessions", "max_ms", ms("avg_ms"), "last30_ms", "last_read_at")),
        "reading_streak": on(lambda c: rd.streaks(c.reading_day)),
        "auto_dnf": on(lambda c: rd.auto_dnf(totals(c), c.completion, as_of("2024-02-20 00:00:00"))),
        "event_upsert_shelf_machine": on(lambda c: rd.merge_shelves(c.user_event, _new_events(c))),
        "profile_event_weights": on(lambda c: weighted(c).select("user_id", "work_id", "shelf", F.round("weight", 6).alias("weight"))),
        "profile_signals": on(lambda c: rd.signals(weighted(c))),
        "profile_vector": on(lambda c: rd.profile_vector(weighted(c), c.work).select("user_id", F.posexplode("vector").alias("k", "x")).select("user_id", "k", F.round("x", 6).alias("x"))),
        "profile_anchors": on(lambda c: rd.anchors(weighted(c))),
        "taste_summary": on(lambda c: rd.taste_summary(c.user_event, c.work_subject)),
        "profile_staleness": on(lambda c: rd.stale_profiles(c.user_event.groupBy("user_id").agg(F.max("finished_at").alias("updated_at")), c.completion.select("user_id", "at"), c.session.select("user_id", F.col("start_at").alias("at")))),
    }


def oracle_sql() -> dict[str, str]:
    edges = {"edges": EDGES_SQL}
    features = {
        "own": f"select * from user_event where user_id = {USER}",
        "readw": "select distinct work_id, rating from own where shelf = 'read'",
        "liked": "select distinct work_id from readw where rating is null or rating >= 4",
        "fa": "select distinct author_id from work_author where work_id in (select work_id from liked)",
        "fs": "select distinct subject from work_subject where work_id in (select work_id from liked)",
        "ser": "select distinct series from work where work_id in (select work_id from readw)",
        "aff": "select work_id, count(f.author_id) / count(*) a from work_author w left join fa f on w.author_id = f.author_id group by 1",
        "ovl": "select work_id, count(f.subject) / (count(*) + (select count(*) from fs) - count(f.subject)) o from work_subject w left join fs f on w.subject = f.subject group by 1",
    }
    return {
        "graph_neighbors_2hop": sql(f"select distinct work_id from edges where work_id <> {WORK} and node in (select node from edges where work_id = {WORK})", "work work_author work_subject", **edges),
        "graph_features": sql("select w.work_id, round(coalesce(a, 0), 6) author_affinity, round(coalesce(o, 0), 6) subject_overlap, coalesce(series in (select series from ser), false) same_series, round((coalesce(a, 0) + coalesce(o, 0)) / 2, 6) prox from work w left join aff on w.work_id = aff.work_id left join ovl on w.work_id = ovl.work_id where w.work_id not in (select work_id from own)", "user_event work work_author work_subject", **features),
        "label_propagation": sql(f"select node, label from l{ROUNDS}", CO_VIEWS, **LPA_SQL),
        "community_metadata": sql("select label, size, string_agg(subject, ', ' order by n desc, subject) top_subjects from (select *, row_number() over (partition by label order by n desc, subject) r from (select label, size, subject, count(*) n from community join work_subject on node = work_id group by 1, 2, 3)) where r <= 5 group by 1, 2", CO_VIEWS + " work_subject", **LPA_SQL),
        "community_authors": sql("select label, size, string_agg(name, ', ' order by n desc, name) top_authors from (select *, row_number() over (partition by label order by n desc, name) r from (select label, size, name, count(*) n from community join work_author on node = work_id join author using (author_id) group by 1, 2, 3)) where r <= 5 group by 1, 2", CO_VIEWS + " author", **LPA_SQL),
        "stale_events_update": sql("select e.user_id, e.work_id, case when s then 'dnf' else shelf end shelf, rating, case when s then last_read_at::date::timestamp else finished_at end finished_at, case when s then 'auto-dnf-stale' end notes from user_event e left join totals t on e.user_id = t.user_id and e.work_id = t.work_id, lateral (select coalesce(shelf = 'currently-reading' and last_read_at < timestamp '2024-02-20 00:00:00' - interval 30 days and (e.user_id, e.work_id) not in (select user_id, work_id from completion), false) s)", "user_event session completion", totals=TOTALS_SQL),
        "community_candidates": sql("select anchor, work_id from (select o.node anchor, m.node work_id, row_number() over (partition by o.node order by md5(concat('7:', m.node)), m.node) r from community o join community m on o.label = m.label and o.node <> m.node where o.node % 20 = 0) where r <= 20", CO_VIEWS, **LPA_SQL),
        "redirect_resolution": sql("select old_key, final_key, hops::int hops from (select *, row_number() over (partition by old_key order by hops desc) r from walk) where r = 1", "redirect", True, walk="select old_key, new_key final_key, 1 hops from redirect union all select w.old_key, r.new_key, hops + 1 from walk w join redirect r on r.old_key = w.final_key where hops < 10"),
        "reading_aggregate": sql("select user_id, work_id, total_ms, sessions, max_ms, round(avg_ms, 4) avg_ms, last30_ms, last_read_at from totals", "session", totals=TOTALS_SQL),
        "reading_streak": sql("select user_id, last_day, streak from (select user_id, island, count(*) streak, max(day) last_day, row_number() over (partition by user_id order by max(day) desc) r from (select user_id, day, day - row_number() over (partition by user_id order by day)::int island from reading_day) group by 1, 2) where r = 1", "reading_day"),
        "auto_dnf": sql("select user_id, work_id, last_read_at from totals t where last_read_at < timestamp '2024-02-20 00:00:00' - interval 30 days and not exists (select 1 from completion c where c.user_id = t.user_id and c.work_id = t.work_id)", "session completion", totals=TOTALS_SQL),
        "event_upsert_shelf_machine": sql(
            "select coalesce(o.user_id, n.user_id) user_id, coalesce(o.work_id, n.work_id) work_id, case when o.shelf in ('read', 'dnf') then o.shelf else coalesce(n.shelf, o.shelf) end shelf, greatest(o.finished_at, n.finished_at) finished_at from user_event o full join best n on o.user_id = n.user_id and o.work_id = n.work_id",
            "user_event",
            fresh=NEW_EVENTS_SQL,
            best="select user_id, work_id, shelf, finished_at from (select *, row_number() over (partition by user_id, work_id order by case shelf when 'dnf' then 4 when 'read' then 3 when 'currently-reading' then 2 else 1 end desc, finished_at desc) r from fresh) where r = 1",
        ),
        "profile_event_weights": sql("select user_id, work_id, shelf, round(weight, 6) weight from weighted", WEIGHT_VIEWS, **WEIGHT_SQL),
        "profile_signals": sql("select user_id, work_id, coalesce(rating = 5, false) five_stars, coalesce(completions >= 2, false) reread, coalesce(max_ms / 60000 >= 240, false) binge, coalesce(avg_ms / 60000 >= 15, false) long_sessions, coalesce(last30_ms > 0, false) active, coalesce(author_works >= 3, false) loyal, coalesce(gap between 0 and 3, false) quick_next from joined", WEIGHT_VIEWS, **{k: WEIGHT_SQL[k] for k in ("totals", "done", "owned", "by_author", "loyalty", "ev", "joined")}),
        "profile_vector": sql("select user_id, (k - 1)::int k, round(x, 6) x from unit", WEIGHT_VIEWS + " work", **TASTE_SQL),
        "profile_anchors": sql("select user_id, work_id, weight, position::int as position from (select user_id, work_id, round(weight, 6) weight, row_number() over (partition by user_id order by round(weight, 6) desc, work_id) as position from weighted where weight > 0) where position <= 10", WEIGHT_VIEWS, **WEIGHT_SQL),
        "taste_summary": sql("select b.user_id, works_read, avg_rating, top_subjects from (select user_id, count(*) works_read, round(avg(rating), 6) avg_rating from user_event where shelf = 'read' group by 1) b left join (select user_id, string_agg(subject, ', ' order by r) top_subjects from (select user_id, subject, row_number() over (partition by user_id order by count(*) desc, subject) r from user_event join work_subject using (work_id) where shelf = 'read' group by 1, 2) where r <= 5 group by 1) t on b.user_id = t.user_id", "user_event work_subject"),
        "profile_staleness": sql("select p.user_id, coalesce(c.last_at > updated_at, false) stale from (select user_id, max(finished_at) updated_at from user_event group by 1) p left join (select user_id, max(z) last_at from (select user_id, completion.at z from completion union all select user_id, start_at from session) group by 1) c on p.user_id = c.user_id", "user_event completion session"),
    }
