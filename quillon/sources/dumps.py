"""File sources (S1-S22, S25, S27): dumps of tab-separated lines with JSON, library exports, reader exports. Every reader is
a scan with a declared schema and column expressions; malformed lines are left out, as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text

WORK_JSON = "key string, title string, subtitle string, first_publish_date string, subjects array<string>, subject_places array<string>, subject_people array<string>, subject_times array<string>, authors array<struct<author:struct<key:string>>>, covers array<bigint>"
EDITION_JSON = "key string, works array<struct<key:string>>, title string, isbn_10 array<string>, isbn_13 array<string>, publishers array<string>, publish_date string, number_of_pages int, covers array<bigint>, languages array<struct<key:string>>"
AUTHOR_JSON = "key string, name string, birth_date string, death_date string, alternate_names array<string>"
LIST_JSON = "key string, name string, seed_count int, seeds array<string>"


def tsv(spark: SparkSession, path: str, least: int) -> DataFrame:
    """S3: fields (array) of the lines with at least so many tab-separated fields."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    return rows.where(F.size("f") >= least)


def dump(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Type, key, revision, last_modified, json of a dump; lines of fewer than five fields or of broken JSON go.
    Compressed files are read as they are."""
    f = lambda k: F.get("f", F.lit(k))
    rows = spark.read.text(path).select(F.split("value", "\t", 5).alias("f")).where(F.size("f") >= 5)
    rows = rows.select(f(0).alias("type"), f(1).alias("key"), F.expr("try_cast(f[2] as int)").alias("revision"), F.expr("try_cast(f[3] as timestamp)").alias("last_modified"), f(4).alias("json"))
    rows = rows.where(F.try_parse_json("json").isNotNull())
    return rows.where(F.col("type").contains(kind)) if kind else rows


def works(lines: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works, their subjects (the first `most` of the four kinds in order), their authors' keys. A title is required."""
    j = lines.select(F.from_json("json", WORK_JSON).alias("j"), text.unwrap_text(F.col("json"), "description").alias("description")).where("j.title is not null")
    key = text.key_suffix("j.key")
    year = text.year_of("j.first_publish_date", text.DUMP_YEAR)
    base = j.select(key.alias("ol_work_key"), "j.title", "j.subtitle", "description", year.alias("first_publish_year"), F.get("j.covers", F.lit(0)).alias("cover_id"))
    kinds = [("subjects", "subject"), ("subject_places", "place"), ("subject_people", "person"), ("subject_times", "time")]
    def tagged(c: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"j.{c}"), F.array().cast("array<string>")), lambda x: F.struct(text.subject_key(x).alias("subject"), F.lit(kind).alias("kind")))

    subjects = j.select(key.alias("ol_work_key"), F.inline(F.slice(F.concat(*[tagged(c, t) for c, t in kinds]), 1, most))).distinct()
    authors = j.select(key.alias("ol_work_key"), F.explode("j.authors").alias("a")).select("ol_work_key", text.key_suffix("a.author.key").alias("ol_author_key")).where("ol_author_key is not null").distinct()
    return base, subjects, authors


def link_authors(pairs: DataFrame, works_: DataFrame, authors_: DataFrame) -> DataFrame:
    """work_id, author_id of pairs of keys (ol_work_key, ol_author_key) that are known on both sides."""
    return pairs.join(works_, "ol_work_key").join(authors_, "ol_author_key").select("work_id", "author_id").distinct()


def editions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Editions with a work, and every ISBN of each."""
    j = lines.select(F.from_json("json", EDITION_JSON).alias("j")).where("j.works[0].key is not null")
    first = lambda c: F.get(f"j.{c}", F.lit(0))
    date = F.when(F.col("j.publish_date").rlike("^[0-9]{4}"), F.expr("try_to_date(substring(j.publish_date, 1, 4), 'yyyy')"))
    key = text.key_suffix("j.key")
    base = j.select(key.alias("ol_edition_key"), text.key_suffix(first("works")["key"]).alias("ol_work_key"), "j.title", first("isbn_10").alias("isbn10"), first("isbn_13").alias("isbn13"), first("publishers").alias("publisher"), date.alias("pub_date"), F.col("j.number_of_pages").alias("page_count"), first("covers").alias("cover_id"))
    every = F.concat(F.coalesce("j.isbn_10", F.array().cast("array<string>")), F.coalesce("j.isbn_13", F.array().cast("array<string>")))
    isbns = j.select(key.alias("ol_edition_key"), F.explode(every).alias("isbn")).select("ol_edition_key", text.normalize_isbn("isbn").alias("isbn")).where("isbn is not null").distinct()
    return base, isbns


def authors(lines: DataFrame) -> DataFrame:
    """A name is required."""
    j = lines.select(F.from_json("json", AUTHOR_JSON).alias("j"), text.unwrap_text(F.col("json"), "bio").alias("bio")).where("j.name is not null")
    return j.select(text.key_suffix("j.key").alias("ol_author_key"), "j.name", "bio", "j.birth_date", "j.death_date")


def _nameless(rows: DataFrame) -> DataFrame:
    """Lines f without a reader, each with a name of its own (user_key): the digest of the line and the number of the line among
    equal ones. So the names don't hang on files and their splits."""
    equal = rows.groupBy("f").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return equal.select("f", F.concat(F.lit("anon_"), F.md5(F.array_join("f", "\t", "").cast("binary")), F.lit("_"), F.col("k").cast("string")).alias("user_key"))


def _field(k: int) -> Column:
    return F.nullif(F.get("f", F.lit(k)), F.lit(""))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings of 1 to 5 with a work; a line without a reader has one of its own. Keys are what follows their last slash."""
    rows = tsv(spark, path, 3).where((F.get("f", F.lit(0)) != "") & F.expr("try_cast(f[2] as int) between 1 and 5"))
    named = rows.where(_field(4).isNotNull()).select("f", text.key_suffix(_field(4)).alias("user_key"))
    every = named.unionByName(_nameless(rows.where(_field(4).isNull()).select("f")))
    return every.select(text.key_suffix(_field(0)).alias("work_key"), text.key_suffix(_field(1)).alias("edition_key"), F.expr("try_cast(f[2] as int)").alias("rating"), F.expr("try_cast(f[3] as date)").alias("rated_on"), "user_key")


def reading_log(spark: SparkSession, path: str) -> DataFrame:
    """Work, edition, date, reader, status lines; lines without a work, reader or known status go."""
    rows = tsv(spark, path, 5).select(text.key_suffix(_field(0)).alias("work_key"), text.key_suffix(_field(1)).alias("edition_key"), F.expr("try_cast(f[2] as date)").alias("logged_on"), text.key_suffix(_field(3)).alias("user_key"), text.mapped(_field(4), text.STATUSES).alias("status"))
    return rows.where("work_key is not null and user_key is not null and status is not null")


def reading_log_fast(spark: SparkSession, path: str) -> DataFrame:
    """Work, edition, status, date lines, which name no reader: each has one of its own; unknown statuses go."""
    rows = tsv(spark, path, 3).withColumn("status", text.mapped(_field(2), text.STATUSES)).where("status is not null")
    out = _nameless(rows.select("f"))
    return out.select(text.key_suffix(_field(0)).alias("work_key"), "user_key", text.mapped(_field(2), text.STATUSES).alias("status"), F.expr("try_cast(f[3] as date)").alias("logged_on"))


def redirects(lines: DataFrame) -> DataFrame:
    """S9."""
    location = F.get_json_object("json", "$.location")
    kind = F.when(F.col("key").contains("/works/"), "work").when(F.col("key").rlike("/(?:editions|books)/"), "edition").when(F.col("key").contains("/authors/"), "author").otherwise("unknown")
    return lines.select(F.col("key").alias("old_key"), location.alias("new_key"), kind.alias("entity")).where("new_key is not null")


def covers(lines: DataFrame) -> DataFrame:
    """S10."""
    g = lambda p: F.get_json_object("json", p)
    return lines.select(g("$.id").cast("long").alias("cover_id"), F.when(g("$.author").isNotNull(), "author").otherwise("edition").alias("kind"), F.coalesce(g("$.author"), g("$.edition")).alias("target"), g("$.width").cast("int").alias("width"), g("$.height").cast("int").alias("height"))


def wikidata(lines: DataFrame) -> DataFrame:
    """The raw object stays as a variant."""
    return lines.select("key", F.get_json_object("json", "$.wikidata").alias("wikidata_id"), F.parse_json("json").alias("raw")).where("wikidata_id is not null")


def lists(lines: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Lists, and their seeds (texts or objects with a key) in order, at most `most` of each list as in the reference."""
    j = lines.select(F.from_json("json", LIST_JSON).alias("j"))
    user = F.coalesce(F.nullif(F.regexp_extract("j.key", "/people/([^/]+)/", 1), F.lit("")), F.lit("unknown"))
    base = j.select(F.col("j.key").alias("list_key"), user.alias("user_key"), "j.name", F.col("j.seed_count").alias("seed_count"))
    seeds = j.select(F.col("j.key").alias("list_key"), F.posexplode(F.slice("j.seeds", 1, most)).alias("position", "seed"))
    key = F.when(F.col("seed").startswith("{"), F.get_json_object("seed", "$.key")).otherwise(F.col("seed"))
    seeds = seeds.select("list_key", "position", key.alias("seed_key")).where("seed_key is not null")
    return base, seeds.withColumn("kind", F.when(F.col("seed_key").contains("/works/"), "work").otherwise("edition"))


def library_csv(spark: SparkSession, path: str) -> DataFrame:
    """A library export; a rating of 0 is none."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rating = F.expr("try_cast(`My Rating` as int)")
    return rows.select(F.col("Book Id").alias("book_id"), F.col("Title").alias("title"), F.col("Author").alias("author"), text.unwrap_isbn("ISBN").alias("isbn10"), text.unwrap_isbn("ISBN13").alias("isbn13"), F.when(rating > 0, rating).alias("rating"), F.expr("coalesce(try_to_date(`Date Read`, 'yyyy/MM/dd'), try_to_date(`Date Read`, 'yyyy-MM-dd'))").alias("finished_at"), F.coalesce(text.mapped("Exclusive Shelf", text.SHELVES), F.lower(F.trim("Exclusive Shelf"))).alias("shelf"))


def ownership(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of rights; of an item's equal rights the earliest counts, one without a date last (ties by the other
    columns)."""
    schema = "lastUpdatedDate string, rights array<struct<rightType:string,rightStatus:string,acquiredDate:string,origin:struct<originType:string>>>, resource struct<asin:string,productName:string,resourceType:string,orderId:string,transactionId:string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("resource", "lastUpdatedDate", F.explode("rights").alias("r")).where("resource.asin <> ''")
    at = F.expr("try_cast(r.acquiredDate as timestamp)")
    x = F.struct(at.isNull().alias("undated"), at.alias("acquired_at"), F.col("r.origin.originType").alias("origin"), F.col("resource.productName").alias("name"), F.col("r.rightStatus").alias("right_status"), F.col("resource.resourceType").alias("resource_type"))
    rows = rows.select(F.upper("resource.asin").alias("asin"), F.coalesce(F.nullif("r.rightType", F.lit("")), F.lit("Unknown")).alias("right_type"), x.alias("x"))
    return rows.groupBy("asin", "right_type").agg(F.min("x").alias("x")).select("asin", "right_type", "x.*").drop("undated")


def with_series(owned: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Ownership with the purchases of series: they are downloads; one takes the place of an equal right that was acquired
    later, and of none. 'Not Available' is no name."""
    at = F.expr("try_cast(`Creation Date` as timestamp)")
    name = F.nullif("Product Name", F.lit("Not Available"))
    x = F.struct(at.isNull().alias("undated"), at.alias("s_at"), name.alias("s_name"))
    bought = _csv(spark, path).where("ASIN <> ''").select(F.upper("ASIN").alias("asin"), F.lit("Download").alias("right_type"), x.alias("x")).groupBy("asin", "right_type").agg(F.min("x").alias("x"))
    both = owned.withColumn("there", F.lit(True)).join(bought, ["asin", "right_type"], "full")
    use = F.col("there").isNull() | F.coalesce(F.col("x.s_at") < F.col("acquired_at"), F.lit(False))
    pick = lambda new, old: F.when(use, new).otherwise(F.col(old)).alias(old)
    return both.select("asin", "right_type", pick(F.col("x.s_at"), "acquired_at"), pick(F.lit("Purchase"), "origin"), pick(F.col("x.s_name"), "name"), pick(F.lit("Active"), "right_status"), pick(F.lit("KindleEBook"), "resource_type"))


def eligible(owned: DataFrame) -> DataFrame:
    """rights that count as owning a book; what is not stated is no obstacle."""
    ok = lambda c, *values: F.col(c).isNull() | F.col(c).isin("", *values)
    return owned.where(ok("right_status", "Active") & ok("origin", "Purchase", "KindleUnlimited") & ok("resource_type", "KindleEBook"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv(path)


#: Annotations of a device that tell of reading.
READ_MARKS = ("kindle.last_read", "kindle.most_recent_read", "kindle.continuous_read")


def completions(spark: SparkSession, auto: str, unique: str, sync: str) -> DataFrame:
    """Completion events of three exports: asin, at, method. Lines without an item or a date go; of the device's lines
    those deleted and those of other annotations. An empty cell for 'deleted' is no deletion."""
    at = lambda c: F.expr(f"try_cast({c} as timestamp)")
    a = _csv(spark, auto).select(F.upper("file_auto_marked_as_read").alias("asin"), at("created_timestamp").alias("at"), F.lit("auto_mark").alias("method"))
    p = F.split("asin_date_and_content_type", "_")
    how = F.when(F.lower(F.get(p, F.lit(2))) == "automatic", "insights_auto").otherwise("insights_manual")
    u = _csv(spark, unique).where(F.size(p) >= 3).select(F.upper(F.get(p, F.lit(0))).alias("asin"), F.get(p, F.lit(1)).alias("d"), how.alias("method")).select("asin", at("d").alias("at"), "method")
    kept = (F.coalesce(F.lower("Is Deleted"), F.lit("")) != "yes") & F.lower("Annotation Type").isin(*READ_MARKS)
    s = _csv(spark, sync).where(kept).select(F.upper("ASIN").alias("asin"), at("`Customer modified date on device`").alias("at"), F.lit("whispersync_last_read").alias("method"))
    return a.unionByName(u).unionByName(s).where("asin <> '' and at is not null")


def sessions(spark: SparkSession, insights: str, active: str, legacy: str) -> DataFrame:
    """Sessions of three exports: asin, start_at, end_at, duration_ms, source, device_family. Lines without an item or a
    start go; of the oldest export also those of no known item or of anything but books."""
    t = lambda c: F.expr(f"try_cast(`{c}` as timestamp)")
    n = lambda c: F.expr(f"try_cast(`{c}` as bigint)").alias("duration_ms")
    none, name = F.lit(None), F.upper("ASIN").alias("asin")
    one = _csv(spark, insights).select(name, t("start_time").alias("start_at"), t("end_time").alias("end_at"), n("total_reading_milliseconds"), F.lit("ri_adjusted").alias("source"), none.cast("string").alias("device_family"))
    two = _csv(spark, active).select(name, t("created_timestamp").alias("start_at"), none.cast("timestamp").alias("end_at"), n("device_active_time_in_ms"), F.lit("ereader_active").alias("source"), F.coalesce("device_family", F.lit("Kindle E-reader")).alias("device_family"))
    old = _csv(spark, legacy).where("ASIN <> 'Not Available' and coalesce(content_type, '') in ('', 'E-Book')")
    three = old.select(name, t("start_timestamp").alias("start_at"), t("end_timestamp").alias("end_at"), n("total_reading_millis"), F.lit("legacy_session").alias("source"), "device_family")
    return one.unionByName(two).unionByName(three).where("asin <> '' and start_at is not null")


def day_units(spark: SparkSession, path: str) -> DataFrame:
    """S20."""
    return _csv(spark, path).select(F.expr("try_cast(reading_tracked_on_day as date)").alias("day")).where("day is not null").distinct()


def clippings(spark: SparkSession, path: str) -> DataFrame:
    """Title, author, added_on (text), added_at of each clipping with a 'Title (Author)' line; of a work's clippings, whatever
    their case, the first in the order of files and lines counts. A file is one reader's, so it is one row."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "==========")).alias("at", "entry"))
    lines = F.filter(F.split(F.btrim("entry", F.lit(" \t\r\n\ufeff")), "\n"), lambda x: x != "")
    rows = whole.select("file", "at", lines.alias("lines")).where(F.size("lines") >= 2)
    head = F.btrim(F.col("lines")[0], F.lit("\r"))
    pattern = "^(.+?)\\s*\\(([^)]+)\\)$"
    rows = rows.where(head.rlike(pattern)).select("file", "at", F.regexp_extract(head, pattern, 1).alias("title"), F.regexp_extract(head, pattern, 2).alias("author"), F.nullif(F.trim(F.regexp_extract(F.col("lines")[1], "(?i)Added on\\s+([^\\r\\n]+)", 1)), F.lit("")).alias("added_on"))
    first = F.min(F.struct("file", "at", "title", "author", "added_on")).alias("x")
    kept = rows.groupBy(F.lower(F.concat_ws("|", "title", "author")).alias("key")).agg(first).select("x.title", "x.author", "x.added_on")
    plain = F.regexp_replace("added_on", "^[A-Za-z]+,\\s*", "")
    at = F.coalesce(F.try_to_timestamp(plain, F.lit("MMMM d, y h:mm:ss a")), F.try_to_timestamp(plain, F.lit("d MMMM y HH:mm:ss")), F.try_to_timestamp(plain))
    return kept.withColumn("added_at", at)


def backup_vectors(works_: DataFrame, path: str) -> None:
    """{k, e} lines of the vectors there are."""
    works_.where("embedding is not null").select(F.col("ol_work_key").alias("k"), F.col("embedding").alias("e")).write.mode("overwrite").json(path)


def restore_vectors(works_: DataFrame, path: str) -> DataFrame:
    """Vectors of a backup where a work has none."""
    saved = works_.sparkSession.read.schema("k string, e array<double>").json(path).dropDuplicates(["k"])
    kept: Column = F.coalesce("embedding", "e")
    return works_.join(saved, F.col("ol_work_key") == F.col("k"), "left").withColumn("embedding", kept).drop("k", "e")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """One row, the latest change of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("modificationTime").agg(F.max("modificationTime").alias("newest"))


def up_to_date(spark: SparkSession, path: str, *imported: DataFrame) -> DataFrame:
    """One row: newest change of the files, latest import (the largest `created_at` of some tables), and whether the import
    can be skipped, as nothing is newer than it."""
    each = [t.agg(F.max("created_at").alias(f"t{k}")) for k, t in enumerate(imported)]  # a row each
    rows = newest_file(spark, path)
    for t in each:
        rows = rows.crossJoin(t)
    latest = F.greatest(*[f"t{k}" for k in range(len(each))]) if len(each) > 1 else F.col("t0")
    return rows.select("newest", latest.alias("latest")).withColumn("skip", F.coalesce(F.col("latest") >= F.col("newest"), F.lit(False)))


def categories(spark: SparkSession, rules: dict[str, dict]) -> DataFrame:
    """Slug, include, exclude, year_min, year_max of category rules (a parsed file of some dozen slugs)."""
    rows = [(k, list(r["include"]), list(r.get("exclude") or []), *text.parse_year_range(r["years"])) if r.get("years") else (k, list(r["include"]), list(r.get("exclude") or []), None, None) for k, r in rules.items()]
    return spark.createDataFrame(rows, "slug string, include array<string>, exclude array<string>, year_min int, year_max int")
