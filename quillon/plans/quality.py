"""Queries over data quality, display forms, shelves with notes, and what hangs on identifiers of the shop."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import identity as idn
from quillon.operators import reading as rd
from quillon.operators import resolve as rs
from quillon.operators.lineage import table
from quillon.plans.identity import _merges, _works
from quillon.plans.reading import NEW_EVENTS_SQL, TASTE_SQL, TOTALS_SQL, WEIGHT_VIEWS, totals, weighted
from quillon.plans.upkeep import DESCRIBED_SQL, _described
from quillon.sources.fixtures import Catalogue, sql


def _noted(c: Catalogue):
    """K7, K8 with notes: events of one batch with the order of input, over events that have some notes."""
    shelf = F.when(F.col("event_type") == "purchase", "read").when(F.col("event_type") == "view", "currently-reading").when(F.col("event_type") == "error", "dnf").otherwise("to-read")
    n = F.col("event_id")
    new = c.table("events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("work_id"), shelf.alias("shelf"), F.col("ts").alias("finished_at"), F.when(n % 3 != 0, F.concat(F.lit("n"), n.cast("string"))).alias("notes"), n.alias("ordinal"))
    old = c.user_event.withColumn("notes", F.when(F.col("work_id") % 2 == 0, F.lit("old")))
    return rd.merge_shelves(old, new)


def _unknown(c: Catalogue):
    return _described(c).withColumn("title", F.when(F.col("work_id") % 9 == 0, F.lit("Unknown title")).otherwise(F.col("title")))


UNKNOWN_SQL = "select work_id, case when work_id % 9 = 0 then 'Unknown title' else title end title, is_stub, description from d"


def _bridge(c: Catalogue):
    e = c.table("events").where("event_type = 'signup'")
    name = F.when(F.col("event_id") % 5 == 0, "Not available").when(F.col("event_id") % 7 != 0, F.concat(F.lit("Product "), F.col("event_id").cast("string")))
    owned = e.select(F.concat(F.lit("B"), F.get_json_object("props", "$.k"), F.lit("-1")).alias("asin"), name.alias("product_name"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("acquired_at"))
    return rs.asin_bridge(_unknown(c), c.edition, owned)


def _isbn_editions(c: Catalogue):
    """Editions of orders' first lines with ISBNs for some."""
    k = F.col("l_orderkey")
    isbn = lambda p, n: F.concat(F.lit(p), F.lpad(k.cast("string"), n, "0"))
    return c.table("lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("work_id"), F.col("l_orderkey").alias("edition_id"), F.when(k % 3 == 0, isbn("979", 10)).alias("isbn13"), F.when(k % 4 == 0, isbn("", 10)).alias("isbn10")).distinct()


def _dated(c: Catalogue):
    k, y = F.col("p_partkey"), 1900 + F.col("p_partkey") % 120
    year = y.cast("string")
    forms = [F.concat(year, F.lit("-03-02")), F.concat(F.lit("May "), year), F.concat(F.lit("March 5, "), year), F.concat(F.lit("c"), year), F.concat(F.lit("ca. "), year, F.lit("?")), year, F.lit("unknown"), F.concat(F.lit("7 June "), year)]
    return c.table("part").select(k.alias("work_id"), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("published"))


DATED_SQL = "select p_partkey work_id, [concat(y, '-03-02'), concat('May ', y), concat('March 5, ', y), concat('c', y), concat('ca. ', y, '?'), y::varchar, 'unknown', concat('7 June ', y)][p_partkey % 8 + 1] published from (select p_partkey, 1900 + p_partkey % 120 y from part)"


def _profiles(c: Catalogue):
    """Readers with even ids have a stored profile of an earlier day."""
    weights = table(c.spark, c.dir, "event-weights", lambda: weighted(c).select("user_id", "work_id", "weight"))
    stored = rd.profile_vector(weights.where("user_id % 2 = 0"), c.work)
    seen = c.kept_events.groupBy("user_id").agg(F.max("finished_at").alias("updated_at"))
    stale = rd.stale_profiles(seen, c.completion.where("work_id % 3 = 0").select("user_id", "at"))
    build = lambda ids: rd.profile_vector(weights.join(ids, "user_id", "left_semi"), c.work)
    return rd.get_or_build(stored.select("user_id", "vector"), stale, build).select("user_id", "origin", F.size("vector").alias("dims"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def _resolver_tables(c: Catalogue) -> dict:
    cache = c.work.select(F.concat(F.lit("k"), F.col("work_id").cast("string")).alias("lookup_key"), "work_id")
    log = c.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("work_id"))
    roles = c.work_author.withColumn("role", F.when(F.col("author_id") % 2 == 0, "author").otherwise("editor"))
    empty = {"edition": c.edition, "work_subject": c.work_subject, "user_event": c.user_event, "rating": c.rating.withColumn("last_updated", F.lit("2020-01-01").cast("date")), "work": _works(c)}
    return idn.merge_all(_merges(c), empty | {"resolver_cache": cache, "resolver_log": log, "work_author": roles})


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        "event_upsert_notes": on(_noted),
        "quality_warnings": on(lambda c: rs.quality_warnings(_unknown(c), c.user_event, c.work_author, c.work_subject.where("work_id % 4 = 0"))),
        "enrichment_stats": on(lambda c: rs.enrichment_stats(_described(c), c.edition.select("work_id", F.when(F.col("page_count") % 3 != 0, F.lit("u")).alias("cover_url"), F.lit(None).cast("string").alias("cover_id")), c.rating)),
        "asin_bridge": on(_bridge),
        "placeholder_isbn_queue": on(lambda c: _unknown(c).where(F.col("title").ilike("unknown%")).select("work_id").join(_isbn_editions(c).where("isbn13 is not null or isbn10 is not null"), "work_id")),
        "year_variants": on(lambda c: _dated(c).select("work_id", text.date_year("published").alias("parsed"), text.year_of("published").alias("found"), text.year_of("published", text.DUMP_YEAR).alias("dump"))),
        "reading_hours": on(lambda c: totals(c).select("user_id", "work_id", text.hours_text(F.col("total_ms") / 3_600_000.0).alias("hours"))),
        "string_hashes": on(lambda c: c.table("documents").select("doc_id", text.string_hash("text").alias("hash"))),
        "profiles_get_or_build": on(_profiles),
        "merged_resolver_cache": on(lambda c: _resolver_tables(c)["resolver_cache"]),
        "merged_resolver_log": on(lambda c: _resolver_tables(c)["resolver_log"]),
        "merged_author_roles": on(lambda c: _resolver_tables(c)["work_author"]),
    }


def oracle_sql() -> dict[str, str]:
    to = "case when {0} > 0 and {0} % 2 = 0 then {0} // ({0} & -{0}) else {0} end"
    parsed = " , ".join(f"try_strptime(trim(published), '{f}')" for f in ("%Y-%m-%d", "%Y-%m", "%B %-d, %Y", "%B %Y", "%-d %B %Y", "%Y"))
    return {
        "event_upsert_notes": sql(
            "select coalesce(o.user_id, n.user_id) user_id, coalesce(o.work_id, n.work_id) work_id, case when o.shelf in ('read', 'dnf') then o.shelf else coalesce(n.shelf, o.shelf) end shelf, greatest(o.finished_at, n.finished_at) finished_at, coalesce(n.notes, case when o.work_id % 2 = 0 then 'old' end) notes from user_event o full join best n on o.user_id = n.user_id and o.work_id = n.work_id",
            "user_event",
            fresh=NEW_EVENTS_SQL.replace("ts finished_at", "ts finished_at, event_id o, case when event_id % 3 <> 0 then concat('n', event_id) end notes"),
            ranked="select *, case shelf when 'dnf' then 4 when 'read' then 3 when 'currently-reading' then 2 else 1 end p from fresh",
            best="select user_id, work_id, any_value(shelf) shelf, max(finished_at) finished_at, arg_min(notes, o) filter (notes is not null) notes from (select *, max(p) over (partition by user_id, work_id) m from ranked) where p = m group by 1, 2",
        ),
        "quality_warnings": sql(
            "select user_id, works, round(a, 6) authors, round(s, 6) subjects, round(t, 6) stubs, u unknown_titles, array_to_string(list_filter([case when a < 0.5 then 'few authors' end, case when s < 0.3 then 'few subjects' end, case when t > 0.5 then 'many stubs' end, case when u > 100 then 'many unknown titles' end], lambda x: x is not null), '; ') warnings from (select user_id, count(*) works, avg((work_id in (select work_id from work_author))::int) a, avg((work_id in (select work_id from work_subject where work_id % 4 = 0))::int) s, avg((is_stub)::int) t, (select count(*) from titled where title ilike 'unknown%') u from (select distinct user_id, work_id from user_event) join titled using (work_id) group by 1)",
            "user_event work work_author work_subject", d=DESCRIBED_SQL, titled=UNKNOWN_SQL,
        ),
        "enrichment_stats": sql("select (select count(*) from d) works, (select count(*) from d where is_stub) stubs, (select count(*) from d where description is null) missing_description, (select count(distinct work_id) from edition where page_count % 3 = 0) missing_cover, (select count(distinct work_id) from rating where source = 'googlebooks') with_outside_ratings", "work edition rating", d=DESCRIBED_SQL),
        "asin_bridge": sql(
            "select work_id, asin, product_name from (select *, row_number() over (partition by work_id order by acquired_at desc nulls last, asin, product_name) r from (select work_id, asin from edition where work_id % 9 = 0) join owned using (asin) where product_name is not null and product_name not ilike 'not available%') where r = 1", "edition",
            owned="select concat('B', json_extract_string(props, '$.k'), '-1') asin, case when event_id % 5 = 0 then 'Not available' when event_id % 7 <> 0 then concat('Product ', event_id) end product_name, case when event_id % 2 = 0 then ts end acquired_at from events where event_type = 'signup'",
        ),
        "placeholder_isbn_queue": "select distinct l_partkey work_id, l_orderkey edition_id, case when l_orderkey % 3 = 0 then concat('979', lpad(l_orderkey::varchar, 10, '0')) end isbn13, case when l_orderkey % 4 = 0 then lpad(l_orderkey::varchar, 10, '0') end isbn10 from lineitem where l_linenumber = 1 and l_partkey % 9 = 0 and (l_orderkey % 3 = 0 or l_orderkey % 4 = 0)",
        "year_variants": sql(f"select work_id, coalesce(year(coalesce({parsed})), nullif(regexp_extract(published, '\\b(?:19|20)\\d{{2}}\\b'), '')::int)::int parsed, nullif(regexp_extract(published, '\\b(?:19|20)\\d{{2}}\\b'), '')::int as found, nullif(regexp_extract(published, '\\b(?:1[0-9]{{3}}|20[0-2][0-9])\\b'), '')::int as dump from dated", "", dated=DATED_SQL),
        "reading_hours": sql("select user_id, work_id, case when h >= 10 then concat(floor(h + 0.5)::bigint, 'h') when h >= 1 then concat(t // 10, '.', t % 10, 'h') else concat(floor(greatest(h * 60, 1.0) + 0.5)::bigint, 'm') end as hours from (select *, ((least(h, 10) * 4503599627370496)::bigint * 10 + 2251799813685248) >> 52 t from (select *, total_ms / 3600000.0::double h from totals))", "session", totals=TOTALS_SQL),
        "string_hashes": "select doc_id, list_reduce(list_prepend(0::bigint, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)), lambda h, p: ((h * 31 + p + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::int as hash from documents",
        "profiles_get_or_build": sql(
            "select user_id, case when user_id % 2 = 0 and not stale then 'stored' else 'built' end origin, dims::int dims, round(x, 6) as first from (select user_id, count(*) dims, max(x) filter (k = 1) x from unit group by 1) join (select user_id, coalesce(l > u, false) stale from (select user_id, max(finished_at) u from user_event group by 1) left join (select user_id, max(completion.at) l from completion where work_id % 3 = 0 group by 1) using (user_id)) using (user_id)",
            WEIGHT_VIEWS + " work", **TASTE_SQL,
        ),
        "merged_resolver_cache": sql(f"select concat('k', work_id) lookup_key, {to.format('work_id')} work_id from work", "work"),
        "merged_resolver_log": f"select event_id, case when k in (select p_partkey from part) then {to.format('k')} else k end work_id from (select event_id, json_extract_string(props, '$.k')::bigint k from events)",
        "merged_author_roles": sql(f"select distinct {to.format('work_id')} work_id, author_id, case when author_id % 2 = 0 then 'author' else 'editor' end as role from work_author", "work_author"),
    }
