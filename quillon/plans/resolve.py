"""Queries over search, identity resolution, texts and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scoring, text
from quillon.operators import postings as ps
from quillon.operators import ratings as rt
from quillon.operators import resolve as rs
from quillon.operators.lineage import cut, files
from quillon.plans.ratings import POPULARITY_SQL, QUALITY_SQL, WORK
from quillon.sources import sinks
from quillon.sources.fixtures import Catalogue, as_of, sql
from quillon.streaming import sessions

Q = "blue bolt"
AUTHOR, SUBJECT = 7, "economy"
TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"
BI = "case when length({0}) < 2 then []::varchar[] else list_distinct(list_transform(range(1, length({0})), lambda k: substring({0}, k, 2))) end"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"({both}::double / (len({a}) + len({b}) - {both}))"


def _found(c: Catalogue):
    q = rt.quality(c.rating).select("work_id", "blended_avg", "total_ratings")
    index = ps.Index(c.spark, files(c.spark, c.dir, "titles", lambda p: ps.build(c.work.select("work_id", "title"), p)))
    return ps.search(c.work.select("work_id", "title", "first_publish_year"), index, Q).join(q, "work_id", "left")


def _names(c: Catalogue):
    return c.table("part").select("p_name").distinct()


def _inputs(c: Catalogue):
    w = c.work.select("work_id", "title")
    k, pick = F.col("work_id"), lambda m, x: F.when(F.col("work_id") % m == 0, x)
    isbn13 = pick(2, F.concat(F.lit("978"), F.lpad(k.cast("string"), 10, "0")))
    return w.select(k.alias("id"), isbn13.alias("isbn13"), pick(3, F.concat(F.lit("v"), k.cast("string"))).alias("volume_id"), pick(5, F.concat(F.lit("b"), k.cast("string"))).alias("asin"), "title", pick(7, F.lit("Last, First")).alias("author"), (k % 4 == 0).alias("known"))


INPUTS_SQL = "select work_id id, case when work_id % 2 = 0 then concat('978', lpad(work_id::varchar, 10, '0')) end isbn13, case when work_id % 3 = 0 then concat('v', work_id) end volume_id, case when work_id % 5 = 0 then concat('b', work_id) end asin, title, case when work_id % 7 = 0 then 'Last, First' end author, work_id % 4 = 0 known from work"
ROUTE_SQL = {
    "inputs": INPUTS_SQL,
    "pathed": "select *, case when isbn13 is not null and known then 'isbn_ol' when isbn13 is not null then 'isbn_local' when volume_id is not null then 'gbid' when author is not null and known then 'title_gb' when asin is not null then 'asin' else 'manual' end path from inputs",
    "routed": "select *, case path " + " ".join(f"when '{k}' then {v}::double" for k, v in scoring.PATH_CONFIDENCE.items()) + " end confidence from pathed",
}


def _isbns(c: Catalogue):
    k = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    return c.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.substring(k, 1, 4), F.lit("-"), F.substring(k, 5, 5), F.lit("-"), F.when(F.col("p_partkey") % 11 == 0, "x").otherwise((F.col("p_partkey") % 10).cast("string"))).alias("isbn"))


ISBN_SQL = {
    "raw": "select p_partkey id, lpad((p_partkey * 7919 % 1000000000)::varchar, 9, '0') k, case when p_partkey % 11 = 0 then 'x' else (p_partkey % 10)::varchar end d from part",
    "isbns": "select id, concat(substring(k, 1, 4), '-', substring(k, 5, 5), '-', d) isbn from raw",
    "plain": "select id, upper(regexp_replace(isbn, '[-\\s]', '', 'g')) isbn10 from isbns",
    "body": "select id, isbn10, '978' || substring(isbn10, 1, 9) b from plain",
    "full": "select id, isbn10, b || ((10 - list_sum(list_transform(range(1, 13), lambda k: substring(b, k, 1)::int * (case when k % 2 = 0 then 3 else 1 end))) % 10) % 10)::int::varchar isbn13 from body",
}


def _detail(c: Catalogue):
    w = c.work.where(F.col("work_id") == WORK).select("work_id", "title", "first_publish_year", "series")
    a = c.work_author.join(c.author, "author_id").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("authors"))
    s = c.work_subject.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), ", ").alias("subjects"))
    p = rt.popularity(c.reading_log).select("work_id", "read_count", "unique_users")
    q = rt.graded(rt.quality(c.rating)).select("work_id", "quality_score", "grade")
    return w.join(a, "work_id", "left").join(s, "work_id", "left").join(p, "work_id", "left").join(q, "work_id", "left")


def _listing(c: Catalogue, rows):
    q = rt.quality(c.rating)
    grade = scoring.browse_grade(F.round("blended_avg", 6), F.col("total_ratings"))
    out = rows.join(c.work.select("work_id", "title"), "work_id").join(q, "work_id", "left").select("work_id", "title", "total_ratings", grade.alias("grade"))
    return rs.page(out, [F.col("total_ratings").desc_nulls_last(), "work_id"], 1, 50)


def _upserts(c: Catalogue):
    old = c.work.where("work_id % 3 <> 0").select("work_id", "title", "first_publish_year", F.when(F.col("work_id") % 4 == 0, F.col("series")).alias("series"))
    new = c.work.where("work_id % 2 = 0").select("work_id", F.upper("title").alias("title"), (F.col("first_publish_year") + 1).alias("first_publish_year"), F.when(F.col("work_id") % 5 != 0, F.lower("series")).alias("series"))
    return sinks.upsert(old, new, ["work_id"], {"title": "new", "first_publish_year": "greatest", "series": "fill"})


def _identified(c: Catalogue):
    """Editions with two selective identifiers: works of one order share one where supplier or line number is the same."""
    o = F.col("l_orderkey").cast("string")
    return c.table("lineitem").select(F.col("l_partkey").alias("work_id"), F.concat(F.lit("i"), o, F.lit("-"), F.col("l_suppkey").cast("string")).alias("isbn13"), F.concat(F.lit("B"), o, F.lit("-"), F.col("l_linenumber").cast("string")).alias("asin")).distinct()


def _embedding_texts(c: Catalogue):
    """A third of the works have a short description, a third one that is cut."""
    k = F.col("work_id")
    long_ = F.repeat(F.concat("title", F.lit(" ")), F.lit(200))
    about = F.when(k % 3 == 0, F.concat(F.lit("About "), "title")).when(k % 3 == 1, F.trim(long_))
    by = c.work_author.join(c.author, "author_id").groupBy("work_id").agg(F.array_sort(F.collect_set("name")).alias("by"))
    on = c.work_subject.groupBy("work_id").agg(F.array_sort(F.collect_set("subject")).alias("s"))
    rows = c.work.join(on, "work_id", "left").join(by, "work_id", "left")
    return rows.select("work_id", text.embedding_text(F.col("title"), F.col("series"), F.coalesce("by", F.array().cast("array<string>")), about, F.col("s")).alias("text"))


def _name_pairs(c: Catalogue):
    """Pairs of distinct names that share a word, each once: they meet by that word."""
    n = _names(c).select("p_name", F.explode(F.split("p_name", " ")).alias("word"))
    a, b = n.select(F.col("p_name").alias("a"), "word"), n.select(F.col("p_name").alias("b"), "word")
    return a.join(b, "word").where("a < b").select("a", "b").distinct()


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    pairs = _name_pairs
    docs = lambda c: c.table("documents").select("doc_id", "text", "source")
    return {
        "search_titles": on(lambda c: _found(c).select("work_id", "title", "score").orderBy(F.col("score").desc(), "work_id").limit(50)),
        "search_count": on(lambda c: _found(c).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))),
        "search_page": on(lambda c: rs.page(_found(c), [F.col("score").desc(), F.col("total_ratings").desc_nulls_last(), "work_id"], 2, 20).select("work_id", "title", "score", "total_ratings")),
        "works_by_author": on(lambda c: _listing(c, c.work_author.where(F.col("author_id") == AUTHOR).select("work_id").distinct())),
        "works_by_subject": on(lambda c: _listing(c, c.work_subject.where(F.col("subject") == SUBJECT).select("work_id").distinct())),
        "work_detail": on(_detail),
        "work_authors_agg": on(lambda c: c.work_author.join(c.author, "author_id").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("authors"), F.count("*").alias("n_authors"))),
        "work_subjects_agg": on(lambda c: c.work_subject.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_list("subject")), ", ").alias("subjects"), F.count("*").alias("n_subjects"))),
        "trigram_similarity": on(lambda c: pairs(c).select("a", "b", F.round(text.trigram_similarity("a", "b"), 6).alias("similarity"))),
        "dice_similarity": on(lambda c: pairs(c).select("a", "b", F.round(text.dice_similarity("a", "b"), 6).alias("similarity"))),
        "title_dedupe_candidates": on(lambda c: rs.title_duplicates(c.work).select("x", "y", F.round("similarity", 6).alias("similarity"), "works_x", "works_y")),
        "asin_duplicates": on(lambda c: rs.asin_duplicates(c.edition)),
        "merge_works": on(lambda c: rs.merge_map(c.redirect.select(F.col("old_key").alias("a"), F.col("new_key").alias("b")), checkpoint=cut)),
        # Another name of the query before, kept for its callers.
        "merge_works_whole": on(lambda c: rs.merge_map(c.redirect.select(F.col("old_key").alias("a"), F.col("new_key").alias("b")), checkpoint=cut)),
        "shared_identifier": on(lambda c: rs.shared_identifiers(*[_identified(c)] * 2, ["isbn13", "asin"])),
        "shared_identifier_classes": on(lambda c: rs.identifier_classes(c.edition.select("work_id", F.concat(F.lit("i"), F.col("page_count").cast("string")).alias("isbn13"), "asin"), ["isbn13", "asin"])),
        "isbn_normalise": on(lambda c: _isbns(c).select("id", text.normalize_isbn("isbn").alias("isbn10"), text.isbn10_to_13(text.normalize_isbn("isbn")).alias("isbn13"))),
        "resolve_isbn_batch": on(lambda c: rs.resolve_isbns(_isbns(c), _isbns(c).where("id % 3 = 0").select(text.isbn10_to_13(text.normalize_isbn("isbn")).alias("isbn13"), F.col("id").alias("work_id")))),
        "resolver_route": on(lambda c: rs.route(_inputs(c))),
        "resolver_stats": on(lambda c: rs.path_stats(rs.route(_inputs(c)))),
        "html_to_text": on(lambda c: c.table("pages").select("page_id", F.md5(text.html_to_text("html").cast("binary")).alias("text_md5"), F.length(text.html_to_text("html")).alias("chars"))),
        "url_external_ids": on(lambda c: c.table("pages").select("page_id", text.url_host("url").alias("host"), text.url_path("url").alias("path"), text.url_param("url", "page").alias("page"), text.url_param("url", "ref").alias("ref"))),
        "normalise_text": on(lambda c: docs(c).select("doc_id", F.md5(text.normalize_text("text").cast("binary")).alias("text_md5"))),
        "embedding_text": on(_embedding_texts),
        "year_extract": on(lambda c: docs(c).select("doc_id", text.year_of("text").alias("year"), text.year_of("text", text.DUMP_YEAR).alias("dump_year"))),
        "slug_names": on(lambda c: c.table("part").select("p_partkey", text.slugify(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"), text.author_name(F.concat_ws(", ", "p_brand", "p_type")).alias("name"), text.subject_key("p_name", True).alias("subject"), text.title_case("p_name").alias("title"))),
        "data_quality": on(lambda c: rs.coverage(c.work, c.work_author, c.work_subject, c.rating)),
        "enrichment_queue": on(lambda c: rs.enrichment_queue(c.work, c.reading_log, c.work_author)),
        "import_stats": on(lambda c: c.user_event.groupBy("shelf").agg(F.count("*").alias("events"), F.count_distinct("work_id").alias("works"), F.round(F.avg("rating"), 6).alias("avg_rating"))),
        "upsert_policies": on(_upserts),
        "cache_ttl": on(lambda c: sinks.live(c.table("events").select(F.col("user_id"), F.col("event_id"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at")), as_of("2024-01-20 00:00:00"), except_users=[1, 2]).select("user_id", "event_id")),
        "sessionise_events": on(lambda c: sessions.sessionise(c.table("events"), "30 minutes")),
    }


def oracle_sql() -> dict[str, str]:
    tri = lambda x: TRI.format(x)
    found = {
        **QUALITY_SQL,
        "sims": f"select work_id, title, coalesce({_jaccard('g', 'q')}, 0) similarity from (select work_id, title, {tri('title')} g, {tri(chr(39) + Q + chr(39))} q from work)",
        "found": f"select s.work_id, title, round(greatest(similarity, case when lower(title) like '{Q}%' then 0.9::double else 0 end, case when lower(title) like '%{Q}%' then 0.7::double else 0 end), 6) score, total_ratings from sims s left join quality q on s.work_id = q.work_id where similarity > 0.3 or lower(title) like '%{Q}%'",
    }
    listing = "select w.work_id, title, total_ratings, case when total_ratings is null or total_ratings < 5 then 'B-' when a >= 4.5 and total_ratings >= 100 then 'A+' when a >= 4.2 then 'A' when a >= 4.0 then 'A-' when a >= 3.7 then 'B+' when a >= 3.4 then 'B' else 'B-' end grade from work w left join (select *, round(blended_avg, 6) a from quality) q on w.work_id = q.work_id where w.work_id in ({0}) order by total_ratings desc nulls last, w.work_id limit 50"
    names = {"nm": "select distinct p_name from part", "pairs": "select x.p_name a, y.p_name b from nm x join nm y on x.p_name < y.p_name where len(list_intersect(string_split(x.p_name, ' '), string_split(y.p_name, ' '))) > 0"}
    html = "html"
    for a, b in (("(?i)<br\\s*/?>", "\n"), ("(?i)</p>", "\n\n"), ("<[^>]+>", "")):
        html = f"regexp_replace({html}, '{a}', '{b}', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        html = f"replace({html}, '{a}', '{b}')"
    html = f"trim(regexp_replace(regexp_replace({html}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g'), concat(' ', chr(9), chr(10), chr(13)))"
    return {
        "search_titles": sql("select work_id, title, score from found order by score desc, work_id limit 50", "work rating", **found),
        "search_count": sql("select count(*) total, ceil(count(*) / 20)::bigint pages from found", "work rating", **found),
        "search_page": sql("select work_id, title, score, total_ratings from found order by score desc, total_ratings desc nulls last, work_id limit 20 offset 20", "work rating", **found),
        "works_by_author": sql(listing.format(f"select work_id from work_author where author_id = {AUTHOR}"), "work work_author rating", **QUALITY_SQL),
        "works_by_subject": sql(listing.format(f"select work_id from work_subject where subject = '{SUBJECT}'"), "work work_subject rating", **QUALITY_SQL),
        "work_detail": sql(
            f"""select w.work_id, title, first_publish_year, series, (select string_agg(distinct name, ', ' order by name) from work_author join author using (author_id) where work_id = {WORK}) authors,
            (select string_agg(distinct subject, ', ' order by subject) from work_subject where work_id = {WORK}) subjects, read_count, unique_users, quality_score,
            case when quality_score >= 0.85 then 'A+' when quality_score >= 0.75 then 'A' when quality_score >= 0.65 then 'A-' when quality_score >= 0.55 then 'B+' when quality_score >= 0.45 then 'B' else 'B-' end grade
            from work w left join ({POPULARITY_SQL}) p on w.work_id = p.work_id left join scored s on w.work_id = s.work_id where w.work_id = {WORK}""",
            "work work_author author work_subject reading_log rating",
            **QUALITY_SQL,
        ),
        "work_authors_agg": sql("select work_id, string_agg(name, ', ' order by name) authors, count(*) n_authors from work_author join author using (author_id) group by 1", "work_author author"),
        "work_subjects_agg": sql("select work_id, string_agg(subject, ', ' order by subject) subjects, count(*) n_subjects from work_subject group by 1", "work_subject"),
        "trigram_similarity": sql(f"select a, b, round({_jaccard('x', 'y')}, 6) similarity from (select a, b, {tri('a')} x, {tri('b')} y from pairs)", "", **names),
        "dice_similarity": sql(f"select a, b, round(case when p = q then 1.0::double when length(p) < 2 or length(q) < 2 then 0.0::double else 2.0::double * len(list_intersect(x, y)) / (len(x) + len(y)) end, 6) similarity from (select *, {BI.format('p')} x, {BI.format('q')} y from (select a, b, {NORM.format('a')} p, {NORM.format('b')} q from pairs))", "", **names),
        "title_dedupe_candidates": sql(f"select x.name x, y.name y, round({_jaccard('x.g', 'y.g')}, 6) similarity, x.n works_x, y.n works_y from t x join t y on x.name < y.name where {_jaccard('x.g', 'y.g')} >= 0.5", "work", t=f"select name, n, {tri('name')} g from (select lower(title) name, count(*) n from work group by 1)"),
        "asin_duplicates": sql("select asin, work_id, canonical, works from (select *, min(work_id) over (partition by asin) canonical, count(*) over (partition by asin) works from (select distinct asin, work_id from edition)) where works > 1", "edition"),
        # Redirects halve even keys, so a work ends at its odd part.
        **dict.fromkeys(("merge_works", "merge_works_whole"), sql("select old_key from_id, old_key // (old_key & -old_key) to_id from redirect", "redirect")),
        "shared_identifier": sql("select a, b, case when min(p) = 0 then 'isbn13' else 'asin' end match_type from (select x.work_id a, y.work_id b, 0 p from ed x join ed y on x.isbn13 = y.isbn13 and x.work_id < y.work_id union all select x.work_id, y.work_id, 1 from ed x join ed y on x.asin = y.asin and x.work_id < y.work_id) group by 1, 2", "", ed="select distinct l_partkey work_id, concat('i', l_orderkey, '-', l_suppkey) isbn13, concat('B', l_orderkey, '-', l_linenumber) asin from lineitem"),
        "isbn_normalise": sql("select * from full_", "", **{("full_" if k == "full" else k): v for k, v in ISBN_SQL.items()}),
        "resolve_isbn_batch": sql("select f.id, f.isbn13, k.work_id from full_ f left join (select isbn13, min(id) work_id from full_ where id % 3 = 0 group by 1) k on f.isbn13 = k.isbn13", "", **{("full_" if k == "full" else k): v for k, v in ISBN_SQL.items()}),
        "resolver_route": sql(f"select id, path, confidence, confidence < 0.7 is_stub, case when isbn13 is not null then 'isbn13:' || isbn13 when volume_id is not null then 'gbid:' || volume_id when asin is not null then 'asin:' || upper(asin) else concat('title:', trim(lower(title)), '|author:', trim(lower(coalesce(author, '')))) end lookup_key from routed", "work", **ROUTE_SQL),
        "resolver_stats": sql("select path, count(*) n, round(avg(confidence), 6) avg_confidence, round(avg((confidence < 0.7)::int), 6) stub_share from routed group by 1", "work", **ROUTE_SQL),
        "html_to_text": f"select page_id, md5(t) text_md5, length(t)::int chars from (select page_id, {html} t from pages)",
        "url_external_ids": "select page_id, nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', ''), '') host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') as ref from pages",
        "normalise_text": f"select doc_id, md5({NORM.format('text')}) text_md5 from documents",
        "embedding_text": sql("select work_id, concat_ws('. ', title, series, 'By ' || a, d, 'Topics: ' || s) as text from (select *, case when work_id % 3 = 0 then concat('About ', title) when work_id % 3 = 1 then case when length(trim(repeat(concat(title, ' '), 200))) <= 2000 then trim(repeat(concat(title, ' '), 200)) else concat(trim(substring(trim(repeat(concat(title, ' '), 200)), 1, 1997)), '...') end end d from work) left join (select work_id, string_agg(distinct subject, ', ' order by subject) s from work_subject group by 1) using (work_id) left join (select work_id, string_agg(distinct name, ', ' order by name) a from work_author join author using (author_id) group by 1) using (work_id)", "work work_subject work_author author"),
        "year_extract": "select doc_id, nullif(regexp_extract(text, '(\\b(?:19|20)\\d{2}\\b)', 1), '')::int as year, nullif(regexp_extract(text, '(\\b(?:1[0-9]{3}|20[0-2][0-9])\\b)', 1), '')::int dump_year from documents",
        "slug_names": "select p_partkey, regexp_replace(regexp_replace(lower(concat_ws(' & ', p_name, p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug, concat_ws(' ', p_type, p_brand) as name, regexp_replace(regexp_replace(lower(p_name), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') subject, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') title from part",
        "data_quality": sql("select *, round(with_embedding / works, 6) embedding_share, case when with_embedding / works < 0.5 then 'few works have an embedding' else 'none' end as warning from (select count(*) works, count(embedding) with_embedding, count(*) filter (work_id in (select work_id from work_author)) with_author, count(*) filter (work_id in (select work_id from work_subject)) with_subject, count(*) filter (work_id in (select work_id from rating)) with_rating, count(*) filter (title ilike 'unknown%') unknown_titles from work)", "work work_author work_subject rating"),
        "enrichment_queue": sql("select work_id, title, readers from work join (select work_id, count(distinct user_id) readers from reading_log group by 1) using (work_id) where work_id not in (select work_id from work_author) order by readers desc, work_id limit 50", "work reading_log work_author"),
        "import_stats": sql("select shelf, count(*) events, count(distinct work_id) works, round(avg(rating), 6) avg_rating from user_event group by 1", "user_event"),
        "upsert_policies": sql("select coalesce(n.work_id, o.work_id) work_id, case when n.work_id is not null then n.title else o.title end title, greatest(o.first_publish_year, n.first_publish_year) first_publish_year, coalesce(o.series, n.series) series from (select work_id, title, first_publish_year, case when work_id % 4 = 0 then series end series from work where work_id % 3 <> 0) o full join (select work_id, upper(title) title, first_publish_year + 1 first_publish_year, case when work_id % 5 <> 0 then lower(series) end series from work where work_id % 2 = 0) n on o.work_id = n.work_id", "work"),
        "cache_ttl": "select user_id, event_id from events where ts + interval 7 days > timestamp '2024-01-20 00:00:00' and user_id not in (1, 2)",
        "sessionise_events": "select user_id, min(ts) session_start, max(ts) last_event, count(*) events, round(sum(value), 4) value from (select *, sum(gap) over (partition by user_id order by ts, event_id rows unbounded preceding) s from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 1 else 0 end gap from events)) group by user_id, s",
    }
