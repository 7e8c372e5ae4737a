"""Queries over the file sources: each writes files of the shape that a source has from the driver's tables, once for an
application, and reads them back by the source's reader. The SQL says what of the tables must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.lineage import files
from quillon.sources import dumps
from quillon.sources.fixtures import Catalogue, sql

RULES = {
    "space": {"include": ["red", "blue"], "exclude": ["old"], "years": "1950-"},
    "sea": {"include": ["green"], "years": "-1990", "description": "ships"},
    "land": {"include": ["small", "large"], "exclude": None, "years": "1960-1980"},
    "any": {"include": ["new"]},
}


def _key(kind: str, number: Column, letter: str) -> Column:
    return F.concat(F.lit(f"/{kind}/OL"), number.cast("string"), F.lit(letter))


def _json(*fields: Column, extra: Column | None = None) -> Column:
    """A JSON object of fields (nulls are left out) and, before its end, a text of more fields."""
    whole = F.to_json(F.struct(*fields))
    return whole if extra is None else F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.coalesce(extra, F.lit("")), F.lit("}"))


def _text_or_object(name: str, n: Column, text: Column, other: Column) -> Column:
    """Of three rows one with a text, one with an object of it, one without."""
    return F.when(n % 3 == 0, F.concat(F.lit(f',"{name}":"'), text, F.lit('"'))).when(n % 3 == 1, F.concat(F.lit(f',"{name}":{{"type":"/type/text","value":"'), other, F.lit('"}')))


def _lines(c: Catalogue, name: str, rows: DataFrame, kind: str, key: Column, json: Column, n: Column) -> str:
    """A dump of rows, with a broken line for every tenth row and a short one for every eleventh."""
    good = rows.select(F.concat_ws("\t", F.lit(f"/type/{kind}"), key, F.lit("3"), F.lit("2020-01-01T00:00:00"), json).alias("value"))
    bad = rows.where(n % 10 == 0).select(F.concat_ws("\t", F.lit(f"/type/{kind}"), key, F.lit("3"), F.lit("2020-01-01T00:00:00"), F.lit('{"key": ')).alias("value"))
    short = rows.where(n % 11 == 0).select(F.concat_ws("\t", F.lit(f"/type/{kind}"), key, F.lit("3")).alias("value"))
    return files(c.spark, c.dir, name, lambda path: good.unionAll(bad).unionAll(short).write.option("compression", "gzip").text(path))


def _works(c: Catalogue):
    p = F.col("p_partkey")
    by = c.work_author.groupBy(F.col("work_id").alias("w")).agg(F.collect_list(F.struct(F.struct(_key("authors", F.col("author_id"), "A").alias("key")).alias("author"))).alias("authors"))
    rows = c.table("part").join(by, p == F.col("w"), "left")
    many = F.when(p % 50 == 0, F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("Tag "), k.cast("string")))).otherwise(F.concat(F.array("p_type"), F.split("p_name", " ")))
    fields = [
        _key("works", p, "W").alias("key"), F.when(p % 7 != 0, F.col("p_name")).alias("title"), F.when(p % 2 == 0, F.col("p_brand")).alias("subtitle"),
        F.concat(F.lit("May 1, "), (1950 + F.col("p_size")).cast("string")).alias("first_publish_date"), many.alias("subjects"), F.array(F.lit("New  York")).alias("subject_places"),
        F.array("p_brand").alias("subject_people"), F.array(F.lit("19th Century")).alias("subject_times"), F.col("authors"), F.array(p, p + 1).alias("covers"),
    ]
    about = _text_or_object("description", p, F.concat(F.lit("About "), F.col("p_name")), F.concat(F.lit("Of "), F.col("p_brand")))
    path = _lines(c, "dump-works", rows, "work", _key("works", p, "W"), _json(*fields, extra=about), p)
    return dumps.works(dumps.dump(c.spark, path, "work"))


def _work_authors(c: Catalogue) -> DataFrame:
    """Pairs of keys, joined with the ids of works and of three quarters of the authors."""
    works = c.table("part").select(F.concat(F.lit("OL"), F.col("p_partkey").cast("string"), F.lit("W")).alias("ol_work_key"), F.col("p_partkey").alias("work_id"))
    authors = c.author.where("author_id % 4 <> 0").select(F.concat(F.lit("OL"), F.col("author_id").cast("string"), F.lit("A")).alias("ol_author_key"), "author_id")
    return dumps.link_authors(_works(c)[2], works, authors)


def _editions(c: Catalogue):
    k = F.col("c_custkey")
    nine = F.lpad(k.cast("string"), 9, "0")
    fields = [
        _key("books", k, "M").alias("key"), F.when(k % 5 != 0, F.array(F.struct(_key("works", k % 100, "W").alias("key")))).alias("works"), F.col("c_name").alias("title"),
        F.when(k % 2 == 0, F.array(F.concat(F.substring(nine, 1, 3), F.lit("-"), F.substring(nine, 4, 6), F.lit(" X")))).alias("isbn_10"),
        F.when(k % 3 != 0, F.array(F.concat(F.lit("9780"), nine), F.concat(F.lit("9780"), nine), F.lit("12"))).alias("isbn_13"), F.array("c_mktsegment", "c_name").alias("publishers"),
        F.when(k % 4 == 0, F.lit("2001-05-01")).when(k % 4 == 1, F.lit("May 2001")).when(k % 4 == 2, F.lit("1987")).alias("publish_date"), (k % 900).cast("int").alias("number_of_pages"), F.array(k).alias("covers"),
    ]
    path = _lines(c, "dump-editions", c.table("customer"), "edition", _key("books", k, "M"), _json(*fields), k)
    return dumps.editions(dumps.dump(c.spark, path, "edition"))


def _authors(c: Catalogue) -> DataFrame:
    k = F.col("s_suppkey")
    fields = [_key("authors", k, "A").alias("key"), F.when(k % 6 != 0, F.col("s_name")).alias("name"), F.when(k % 2 == 0, F.lit("1 May 1950")).alias("birth_date"), F.lit(None).cast("string").alias("death_date")]
    path = _lines(c, "dump-authors", c.table("supplier"), "author", _key("authors", k, "A"), _json(*fields, extra=_text_or_object("bio", k, F.col("s_name"), F.lit("b"))), k)
    return dumps.authors(dumps.dump(c.spark, path, "author"))


def _tab_file(c: Catalogue, name: str, rows: DataFrame, *columns: Column) -> str:
    return files(c.spark, c.dir, name, lambda path: rows.select(F.concat_ws("\t", *columns).alias("value")).write.text(path))


def _ratings(c: Catalogue) -> DataFrame:
    k = F.col("c_custkey")
    rows = c.table("customer").withColumn("_twice", F.explode(F.when(k % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    user = F.when(k % 3 != 0, F.concat(F.lit("/people/u"), k.cast("string")))
    path = _tab_file(c, "ratings-file", rows, _key("works", k % 50, "W"), F.when(k % 2 == 0, _key("books", k, "M")).otherwise(""), (k % 7).cast("string"), F.lit("2020-01-02"), user)
    return dumps.ratings(c.spark, path)


def _log_status(k: Column) -> Column:
    return F.when(k % 4 == 0, "Already-Read").when(k % 4 == 1, "reading").when(k % 4 == 2, "to-read").otherwise("lost")


def _reading_log(c: Catalogue) -> DataFrame:
    k = F.col("c_custkey")
    path = _tab_file(c, "reading-log-file", c.table("customer"), _key("works", k % 50, "W"), F.lit(""), F.lit("2020-02-03"), F.when(k % 5 != 0, F.concat(F.lit("u"), k.cast("string"))).otherwise(""), _log_status(k))
    return dumps.reading_log(c.spark, path)


def _reading_log_fast(c: Catalogue) -> DataFrame:
    k = F.col("c_custkey")
    path = _tab_file(c, "reading-log-fast-file", c.table("customer"), _key("works", k % 50, "W"), F.lit(""), _log_status(k), F.when(k % 5 != 0, F.lit("2020-02-03")).otherwise(""))
    return dumps.reading_log_fast(c.spark, path)


def _tsv_rows(c: Catalogue) -> DataFrame:
    k = F.col("s_suppkey")
    path = _tab_file(c, "tsv-file", c.table("supplier"), k.cast("string"), F.lit("x"), F.when(k % 2 == 0, F.col("s_name")))
    return dumps.tsv(c.spark, path, 3).select(F.col("f")[0].cast("long").alias("id"), F.col("f")[2].alias("name"))


def _redirects(c: Catalogue) -> DataFrame:
    k = F.col("old_key")
    kind = F.when(k % 3 == 0, "works").when(k % 3 == 1, "books").otherwise("authors")
    key = lambda n: F.concat(F.lit("/"), kind, F.lit("/OL"), n.cast("string"))
    path = _lines(c, "dump-redirects", c.redirect, "redirect", key(k), _json(key(k).alias("key"), F.when(k % 5 != 0, key(F.col("new_key"))).alias("location")), k)
    return dumps.redirects(dumps.dump(c.spark, path, "redirect"))


def _covers(c: Catalogue) -> DataFrame:
    k = F.col("s_suppkey")
    fields = [k.alias("id"), F.when(k % 3 == 0, _key("authors", k, "A")).alias("author"), F.when(k % 3 != 0, _key("books", k, "M")).alias("edition"), (k % 500).alias("width"), F.when(k % 2 == 0, k).alias("height")]
    path = _lines(c, "dump-covers", c.table("supplier"), "cover", _key("covers", k, "C"), _json(*fields), k)
    return dumps.covers(dumps.dump(c.spark, path, "cover"))


def _wikidata(c: Catalogue) -> DataFrame:
    k = F.col("s_suppkey")
    path = _lines(c, "dump-wikidata", c.table("supplier"), "wikidata", _key("authors", k, "A"), _json(_key("authors", k, "A").alias("key"), F.when(k % 3 != 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata")), k)
    return dumps.wikidata(dumps.dump(c.spark, path, "wikidata")).select("key", "wikidata_id", F.variant_get("raw", "$.wikidata", "string").alias("raw_id"))


def _lists(c: Catalogue):
    n, k = F.col("n_nationkey"), F.col("n_nationkey").cast("long")
    name = F.when(n % 4 == 0, F.concat(F.lit("/lists/OL"), n.cast("string"), F.lit("L"))).otherwise(F.concat(F.lit("/people/u"), n.cast("string"), F.lit("/lists/OL"), n.cast("string"), F.lit("L")))
    ids = F.sequence(F.lit(1), F.when(n == 3, F.lit(1005)).otherwise(n + 2).cast("int"))
    plain = lambda i: F.concat(F.lit('"/works/OL'), i.cast("string"), F.lit('W"'))
    seed = F.transform(ids, lambda i: F.when(i % 2 == 0, F.concat(F.lit('{"key":"/books/OL'), i.cast("string"), F.lit('M"}'))).otherwise(plain(i)))
    seeds = F.concat(F.lit(',"seeds":['), F.array_join(seed, ","), F.lit("]"))
    path = _lines(c, "dump-lists", c.table("nation"), "list", name, _json(name.alias("key"), F.col("n_name").alias("name"), F.size(ids).alias("seed_count"), extra=seeds), k)
    return dumps.lists(dumps.dump(c.spark, path, "list"))


def _csv_file(c: Catalogue, name: str, rows: DataFrame, **columns: Column) -> str:
    picked = rows.select(*[x.cast("string").alias(k) for k, x in columns.items()])
    return files(c.spark, c.dir, name, lambda path: picked.write.option("header", True).option("escape", '"').csv(path))


def _library(c: Catalogue) -> DataFrame:
    k = F.col("c_custkey")
    cell = lambda x: F.concat(F.lit('="'), x, F.lit('"'))
    path = _csv_file(
        c, "library-csv", c.table("customer"),
        **{"Book Id": k, "Title": F.concat(F.col("c_name"), F.lit(', "quoted"')), "Author": F.col("c_mktsegment"), "ISBN": cell(F.when(k % 2 == 0, F.lpad(k.cast("string"), 10, "0")).otherwise("")),
           "ISBN13": cell(F.when(k % 3 == 0, F.lpad(k.cast("string"), 13, "9")).otherwise("")), "My Rating": k % 6, "Date Read": F.when(k % 4 == 0, "2021/03/04").when(k % 4 == 1, "2021-03-05"),
           "Exclusive Shelf": F.when(k % 4 == 0, "Read").when(k % 4 == 1, "did-not-finish").when(k % 4 == 2, "to-read").otherwise("My-Own")},
    )
    return dumps.library_csv(c.spark, path)


def _ownership(c: Catalogue) -> DataFrame:
    """One array of objects is one file here; a reader's export has a file for each object."""
    k = F.col("s_suppkey")
    right = lambda kind, at: F.struct(kind.alias("rightType"), F.when(k % 7 == 0, "Expired").otherwise("Active").alias("rightStatus"), at.alias("acquiredDate"), F.struct(F.when(k % 5 == 0, "Sample").otherwise("Purchase").alias("originType")).alias("origin"))
    day = lambda n: F.concat(F.lit("2020-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    rights = F.array(right(F.lit("Download"), day(k + 5)), right(F.lit("Download"), F.when(k % 2 == 0, day(k))), right(F.when(k % 3 == 0, F.lit("Rental")), day(k)))
    rows = c.table("supplier").select(F.lit("2020-02-01").alias("lastUpdatedDate"), rights.alias("rights"), F.struct(F.concat(F.lit("b"), (k % 40).cast("string")).alias("asin"), F.col("s_name").alias("productName"), F.lit("KindleEBook").alias("resourceType")).alias("resource"))
    path = files(c.spark, c.dir, "ownership-json", lambda p: rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(p))
    more = c.table("supplier").where("s_suppkey % 2 = 1 or s_suppkey % 40 > 30")
    series = _csv_file(c, "series-csv", more, **{"ASIN": F.concat(F.lit("B"), (k % 50).cast("string")), "Product Name": F.when(k % 3 == 0, F.lit("Not Available")).otherwise(F.concat(F.lit("S"), (k % 50).cast("string"))), "Creation Date": F.concat(F.lit("2019-12-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))})
    owned = dumps.with_series(dumps.ownership(c.spark, path), c.spark, series)
    return dumps.eligible(owned).select("asin", "right_type", "acquired_at", "origin", "name")


def _completions(c: Catalogue) -> DataFrame:
    e, k = c.table("events"), F.get_json_object("props", "$.k")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    of = lambda kind: e.where(F.col("event_type") == kind)
    n = F.col("event_id")
    auto = _csv_file(c, "auto-csv", of("purchase"), created_timestamp=F.when(n % 3 != 0, at), file_auto_marked_as_read=F.concat(F.lit("b"), k))
    unique = _csv_file(c, "unique-csv", of("signup"), asin_date_and_content_type=F.concat(F.lit("b"), k, F.lit("_"), F.date_format("ts", "yyyy-MM-dd"), F.when(n % 4 == 0, "_Automatic").when(n % 4 == 1, "_Manual").otherwise("")), product_name=F.lit("p"))
    kind = F.when(n % 4 == 0, "Kindle.Last_Read").when(n % 4 == 1, "kindle.most_recent_read").when(n % 4 == 2, "kindle.bookmark_ready").otherwise("kindle.continuous_read")
    gone = F.when(n % 5 == 0, "Yes").when(n % 5 == 1, "No")
    sync = _csv_file(c, "sync-csv", of("click"), **{"ASIN": F.concat(F.lit("b"), k), "Annotation Type": kind, "Customer modified date on device": at, "Is Deleted": gone})
    return dumps.completions(c.spark, auto, unique, sync).groupBy("asin", "at", "method").agg(F.count("*").alias("n"))


def _sessions(c: Catalogue) -> DataFrame:
    e, asin, n = c.table("events"), F.concat(F.lit("b"), F.get_json_object("props", "$.k")), F.col("event_id")
    t = lambda hours: F.date_format(F.col("ts") + F.expr(f"interval {hours} hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ms = F.when(n % 3 == 0, F.lit("x")).otherwise(F.round(F.col("value") * 1000).cast("long").cast("string"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    one = _csv_file(c, "insights-csv", of("view"), ASIN=asin, start_time=F.when(n % 7 != 0, t(0)), end_time=t(1), total_reading_milliseconds=ms)
    two = _csv_file(c, "active-csv", of("click"), created_timestamp=t(0), ASIN=asin, device_active_time_in_ms=ms, device_family=F.when(n % 2 == 0, F.lit("Oasis")))
    three = _csv_file(c, "legacy-csv", of("signup"), start_timestamp=t(0), end_timestamp=t(2), ASIN=F.when(n % 5 == 0, F.lit("Not Available")).otherwise(asin), content_type=F.when(n % 2 == 0, F.lit("E-Book")).when(n % 4 == 1, F.lit("Audio")), total_reading_millis=ms, device_family=F.lit("Fire"))
    return dumps.sessions(c.spark, one, two, three).groupBy("source", "asin", "device_family").agg(F.count("*").alias("n"), F.count("end_at").alias("ends"), F.sum("duration_ms").alias("ms"), F.max("start_at").alias("last"))


def _days(c: Catalogue) -> DataFrame:
    path = _csv_file(c, "days-csv", c.table("events"), reading_tracked_on_day=F.when(F.col("event_id") % 9 == 0, F.lit("never")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return dumps.day_units(c.spark, path)


def _clippings(c: Catalogue) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Tale "), (k % 30).cast("string"), F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(" ("), F.when(k % 2 == 0, "Ann Lee").otherwise("ANN LEE"), F.lit(")"))))
    entry = F.concat(name, F.lit("\r\n- Your Highlight | Added on Monday, March "), (k % 28 + 1).cast("string"), F.lit(", 2020 10:00:00 AM\r\n\r\nwords\r\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]), "==========\r\n")
    path = files(c.spark, c.dir, "clippings-text", lambda p: c.table("supplier").agg(rows.alias("value")).coalesce(1).write.text(p))
    return dumps.clippings(c.spark, path).select("title", "author", "added_at")


def _restored(c: Catalogue) -> DataFrame:
    saved = files(c.spark, c.dir, "vectors-json", lambda p: dumps.backup_vectors(c.work.where("work_id % 2 = 0"), p))
    rows = c.work.select("work_id", "ol_work_key", F.when(F.col("work_id") % 3 == 0, F.col("embedding")).alias("embedding"))
    return dumps.restore_vectors(rows, saved).where("embedding is not null").select("work_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _freshness(c: Catalogue) -> DataFrame:
    path, e = _csv_file(c, "days-csv", c.table("events"), reading_tracked_on_day=F.lit("x")), c.table("events")
    old, future = e.select(F.col("ts").alias("created_at")), e.limit(1).select(F.lit("2999-01-01").cast("timestamp").alias("created_at"))
    both = dumps.up_to_date(c.spark, path, old, future).select(F.lit("imported later").alias("case"), "latest", "skip")
    return both.unionByName(dumps.up_to_date(c.spark, path, old).select(F.lit("files are newer").alias("case"), "latest", "skip"))


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        "dump_works": on(lambda c: _works(c)[0]),
        "dump_work_subjects": on(lambda c: _works(c)[1]),
        "dump_work_authors": on(_work_authors),
        "dump_editions": on(lambda c: _editions(c)[0]),
        "dump_edition_isbns": on(lambda c: _editions(c)[1]),
        "dump_authors": on(_authors),
        "tsv_rows": on(_tsv_rows),
        "ratings_file": on(_ratings),
        "reading_log_file": on(_reading_log),
        "reading_log_fast_file": on(_reading_log_fast),
        "redirects_dump": on(_redirects),
        "covers_dump": on(_covers),
        "wikidata_dump": on(_wikidata),
        "lists_dump": on(lambda c: _lists(c)[0]),
        "list_seeds_dump": on(lambda c: _lists(c)[1]),
        "library_export": on(_library),
        "ownership_export": on(_ownership),
        "completion_exports": on(_completions),
        "session_exports": on(_sessions),
        "day_units_export": on(_days),
        "clippings_export": on(_clippings),
        "category_rules": on(lambda c: dumps.categories(c.spark, RULES).select("slug", F.array_join("include", ",").alias("include"), F.array_join("exclude", ",").alias("exclude"), "year_min", "year_max")),
        "vector_backup": on(_restored),
        "import_freshness": on(_freshness),
    }


def oracle_sql() -> dict[str, str]:
    tag = lambda x: f"regexp_replace(lower({x}), '\\s+', '_', 'g')"
    line = "concat_ws(chr(9), concat('/works/OL', c_custkey % 50, 'W'), case when c_custkey % 2 = 0 then concat('/books/OL', c_custkey, 'M') else '' end, c_custkey % 7, '2020-01-02')"
    fast = "concat_ws(chr(9), concat('/works/OL', c_custkey % 50, 'W'), '', case c_custkey % 4 when 0 then 'Already-Read' when 1 then 'reading' when 2 then 'to-read' else 'lost' end, case when c_custkey % 5 <> 0 then '2020-02-03' else '' end)"
    status = "case c_custkey % 4 when 0 then 'already-read' when 1 then 'currently-reading' when 2 then 'want-to-read' end"
    day = "make_date(2020, 1, ({0} % 28 + 1)::int)::timestamp"
    return {
        "dump_works": "select concat('OL', p_partkey, 'W') ol_work_key, p_name title, case when p_partkey % 2 = 0 then p_brand end subtitle, case p_partkey % 3 when 0 then 'About ' || p_name when 1 then 'Of ' || p_brand end description, 1950 + p_size first_publish_year, p_partkey cover_id from part where p_partkey % 7 <> 0",
        "dump_work_subjects": f"""select distinct concat('OL', p_partkey, 'W') ol_work_key, subject, kind from (
            select p_partkey, {tag('s')} subject, kind, row_number() over (partition by p_partkey order by o, i) r from (
              select p_partkey, unnest(l) s, generate_subscripts(l, 1) i, 0 o, 'subject' kind from (select p_partkey, case when p_partkey % 50 = 0 then list_transform(range(1, 61), lambda k: concat('Tag ', k)) else list_concat([p_type], string_split(p_name, ' ')) end l from part)
              union all select p_partkey, 'New  York', 1, 1, 'place' from part union all select p_partkey, p_brand, 1, 2, 'person' from part union all select p_partkey, '19th Century', 1, 3, 'time' from part))
            where r <= 50 and p_partkey % 7 <> 0""",
        "dump_work_authors": sql("select work_id, author_id from work_author where work_id % 7 <> 0 and author_id % 4 <> 0", "work_author"),
        "dump_editions": """select concat('OL', c_custkey, 'M') ol_edition_key, concat('OL', c_custkey % 100, 'W') ol_work_key, c_name title, case when c_custkey % 2 = 0 then substring(n, 1, 3) || '-' || substring(n, 4, 6) || ' X' end isbn10,
            case when c_custkey % 3 <> 0 then '9780' || n end isbn13, c_mktsegment publisher, case c_custkey % 4 when 0 then date '2001-01-01' when 2 then date '1987-01-01' end pub_date, (c_custkey % 900)::int page_count, c_custkey cover_id
            from (select *, lpad(c_custkey::varchar, 9, '0') n from customer) where c_custkey % 5 <> 0""",
        "dump_edition_isbns": """select concat('OL', c_custkey, 'M') ol_edition_key, isbn from (select c_custkey, lpad(c_custkey::varchar, 9, '0') || 'X' isbn from customer where c_custkey % 2 = 0
            union all select c_custkey, '9780' || lpad(c_custkey::varchar, 9, '0') from customer where c_custkey % 3 <> 0) where c_custkey % 5 <> 0""",
        "dump_authors": "select concat('OL', s_suppkey, 'A') ol_author_key, s_name as name, case s_suppkey % 3 when 0 then s_name when 1 then 'b' end bio, case when s_suppkey % 2 = 0 then '1 May 1950' end birth_date, null::varchar death_date from supplier where s_suppkey % 6 <> 0",
        "tsv_rows": "select s_suppkey id, s_name as name from supplier where s_suppkey % 2 = 0",
        "ratings_file": f"""select concat('OL', c_custkey % 50, 'W') work_key, case when c_custkey % 2 = 0 then concat('OL', c_custkey, 'M') end edition_key, (c_custkey % 7)::int rating, date '2020-01-02' rated_on,
            case when c_custkey % 3 <> 0 then concat('u', c_custkey) else concat('anon_', md5(line), '_', row_number() over (partition by line, c_custkey % 3 = 0)) end user_key
            from (select *, {line} line from customer, range(1, 3) t(copy) where copy = 1 or c_custkey % 9 = 0) where c_custkey % 7 between 1 and 5""",
        "reading_log_file": f"select concat('OL', c_custkey % 50, 'W') work_key, null::varchar edition_key, date '2020-02-03' logged_on, concat('u', c_custkey) user_key, {status} status from customer where c_custkey % 5 <> 0 and c_custkey % 4 <> 3",
        "reading_log_fast_file": f"select concat('OL', c_custkey % 50, 'W') work_key, concat('anon_', md5(line), '_', row_number() over (partition by line)) user_key, {status} status, case when c_custkey % 5 <> 0 then date '2020-02-03' end logged_on from (select *, {fast} line from customer) where c_custkey % 4 <> 3",
        "redirects_dump": sql("select concat('/', k, '/OL', old_key) old_key, concat('/', k, '/OL', new_key) new_key, case k when 'works' then 'work' when 'books' then 'edition' else 'author' end entity from (select *, case old_key % 3 when 0 then 'works' when 1 then 'books' else 'authors' end k from redirect) where old_key % 5 <> 0", "redirect"),
        "covers_dump": "select s_suppkey cover_id, case when s_suppkey % 3 = 0 then 'author' else 'edition' end kind, case when s_suppkey % 3 = 0 then concat('/authors/OL', s_suppkey, 'A') else concat('/books/OL', s_suppkey, 'M') end target, (s_suppkey % 500)::int width, case when s_suppkey % 2 = 0 then s_suppkey::int end height from supplier",
        "wikidata_dump": "select concat('/authors/OL', s_suppkey, 'A') as key, concat('Q', s_suppkey) wikidata_id, concat('Q', s_suppkey) raw_id from supplier where s_suppkey % 3 <> 0",
        "lists_dump": "select case when n_nationkey % 4 = 0 then concat('/lists/OL', n_nationkey, 'L') else concat('/people/u', n_nationkey, '/lists/OL', n_nationkey, 'L') end list_key, case when n_nationkey % 4 = 0 then 'unknown' else concat('u', n_nationkey) end user_key, n_name as name, case when n_nationkey = 3 then 1005 else n_nationkey + 2 end::int seed_count from nation",
        "list_seeds_dump": """select case when n_nationkey % 4 = 0 then concat('/lists/OL', n_nationkey, 'L') else concat('/people/u', n_nationkey, '/lists/OL', n_nationkey, 'L') end list_key, (i - 1)::int as position,
            case when i % 2 = 0 then concat('/books/OL', i, 'M') else concat('/works/OL', i, 'W') end seed_key, case when i % 2 = 0 then 'edition' else 'work' end kind from nation, range(1, 1006) t(i) where i <= case when n_nationkey = 3 then 1000 else n_nationkey + 2 end""",
        "library_export": """select c_custkey::varchar book_id, concat(c_name, ', "quoted"') title, c_mktsegment author, case when c_custkey % 2 = 0 then lpad(c_custkey::varchar, 10, '0') end isbn10, case when c_custkey % 3 = 0 then lpad(c_custkey::varchar, 13, '9') end isbn13,
            case when c_custkey % 6 > 0 then (c_custkey % 6)::int end rating, case c_custkey % 4 when 0 then date '2021-03-04' when 1 then date '2021-03-05' end finished_at, case c_custkey % 4 when 0 then 'read' when 1 then 'dnf' when 2 then 'to-read' else 'my-own' end shelf from customer""",
        "ownership_export": f"""with r as (select s_suppkey % 40 a, s_name, 'Download' t, case when s_suppkey % 7 = 0 then 'Expired' else 'Active' end st, case when s_suppkey % 5 = 0 then 'Sample' else 'Purchase' end o, {day.format('(s_suppkey + 5)')} d from supplier
            union all select s_suppkey % 40, s_name, 'Download', case when s_suppkey % 7 = 0 then 'Expired' else 'Active' end, case when s_suppkey % 5 = 0 then 'Sample' else 'Purchase' end, case when s_suppkey % 2 = 0 then {day.format('s_suppkey')} end from supplier
            union all select s_suppkey % 40, s_name, case when s_suppkey % 3 = 0 then 'Rental' else 'Unknown' end, case when s_suppkey % 7 = 0 then 'Expired' else 'Active' end, case when s_suppkey % 5 = 0 then 'Sample' else 'Purchase' end, {day.format('s_suppkey')} from supplier),
            own as (select * from (select *, row_number() over (partition by a, t order by d nulls last, o, s_name, st) rn from r) where rn = 1),
            ser as (select * from (select s_suppkey % 50 a, make_date(2019, 12, (s_suppkey % 28 + 1)::int)::timestamp d, case when s_suppkey % 3 <> 0 then concat('S', s_suppkey % 50) end n, row_number() over (partition by s_suppkey % 50 order by s_suppkey % 28, case when s_suppkey % 3 <> 0 then concat('S', s_suppkey % 50) end nulls first) rn from supplier where s_suppkey % 2 = 1 or s_suppkey % 40 > 30) where rn = 1),
            b as (select coalesce(own.a, ser.a) a, coalesce(own.t, 'Download') right_type, own.a is null or coalesce(ser.d < own.d, false) u, own.d od, ser.d sd, own.o, own.s_name, own.st, ser.n from own full join ser on own.a = ser.a and own.t = 'Download')
            select concat('B', a) asin, right_type, case when u then sd else od end acquired_at, case when u then 'Purchase' else o end origin, case when u then n else s_name end as name from b where u or (st = 'Active' and o = 'Purchase')""",
        "completion_exports": """select concat('B', k) asin, "at", method, count(*) n from (
            select k, date_trunc('second', ts) "at", 'auto_mark' as method from e where event_type = 'purchase' and event_id % 3 <> 0
            union all select k, ts::date::timestamp, case when event_id % 4 = 0 then 'insights_auto' else 'insights_manual' end from e where event_type = 'signup' and event_id % 4 < 2
            union all select k, date_trunc('second', ts), 'whispersync_last_read' from e where event_type = 'click' and event_id % 5 <> 0 and event_id % 4 <> 2) group by 1, 2, 3""".replace("from e where", "from (select *, json_extract_string(props, '$.k') k from events) where"),
        "session_exports": """select source, asin, device_family, count(*) n, count(end_at) ends, sum(ms)::bigint ms, max(start_at) as last from (
            select 'ri_adjusted' source, concat('B', k) asin, null::varchar device_family, 1 end_at, ms, date_trunc('second', ts) start_at from e where event_type = 'view' and event_id % 7 <> 0
            union all select 'ereader_active', concat('B', k), case when event_id % 2 = 0 then 'Oasis' else 'Kindle E-reader' end, null, ms, date_trunc('second', ts) from e where event_type = 'click'
            union all select 'legacy_session', concat('B', k), 'Fire', 1, ms, date_trunc('second', ts) from e where event_type = 'signup' and event_id % 5 <> 0 and event_id % 4 <> 1) group by 1, 2, 3""".replace(
            "from e where", "from (select *, json_extract_string(props, '$.k') k, case when event_id % 3 <> 0 then round(value * 1000)::bigint end ms from events) where"
        ),
        "day_units_export": "select distinct ts::date as day from events where event_id % 9 <> 0",
        "clippings_export": "select title, author, added_at from (select concat('Tale ', s_suppkey % 30) title, case when s_suppkey % 2 = 0 then 'Ann Lee' else 'ANN LEE' end author, make_timestamp(2020, 3, s_suppkey % 28 + 1, 10, 0, 0.0) added_at, row_number() over (partition by s_suppkey % 30 order by s_suppkey) r from supplier where s_suppkey % 11 <> 0) where r = 1",
        "category_rules": "select * from (values ('space', 'red,blue', 'old', 1950, null), ('sea', 'green', '', null, 1990), ('land', 'small,large', '', 1960, 1980), ('any', 'new', '', null, null)) t(slug, include, exclude, year_min, year_max)",
        "vector_backup": sql("select work_id, len(embedding)::int dims, round(list_sum(embedding), 4) total from work where embedding is not null and (work_id % 2 = 0 or work_id % 3 = 0)", "work"),
        "import_freshness": "select 'imported later' as case, timestamp '2999-01-01' latest, true skip union all select 'files are newer', max(ts), false from events",
    }
