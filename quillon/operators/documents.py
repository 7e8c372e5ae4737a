"""Nested documents as JSON (F13, A3, R15, R18, R19): a row's parts are brought together once, as arrays of structs in a fixed
order. All are for a page of ids: the sides are cut to them before anything is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.collaborative import keep_top

#: The order of authors' roles.
ROLES = ("author", "editor", "translator")


def as_json(*fields: Column | str) -> Column:
    """A JSON object of columns, nulls spelt out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def nested(rows: DataFrame, key: str, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """key and the array of its rows' fields (a struct, or one plain column) in order; ties by the fields themselves."""
    ranked = F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], *fields)))
    one = (lambda x: x[fields[0]]) if len(fields) == 1 else (lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return rows.groupBy(key).agg(F.transform(ranked, one).alias(name))


def role_rank(role: Column) -> Column:
    """A3: authors before editors before translators, other and missing roles last."""
    rank = F.lit(len(ROLES))
    for k, name in enumerate(ROLES):
        rank = F.when(role == name, k).otherwise(rank)
    return rank


def _empty(c: str, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind)).alias(c)


def book_documents(page: DataFrame, works: DataFrame, authors: DataFrame, subjects: DataFrame, editions: DataFrame, quality: DataFrame, reading: DataFrame, cover: Column) -> DataFrame:
    """work_id and document of each work of the page (work_id): title, year, series, cover, authors by role, name and id,
    subjects by name, editions by identifier, rating, and the reader's own totals. What a work lacks is null or an empty array.

    authors: work_id, id, name, role; editions: work_id, asin, page_count; quality: work_id, blended_avg, total_ratings;
    reading: work_id, total_ms, sessions, of one reader. Rows of a part that repeat come once.
    """
    ids = page.select("work_id").distinct()
    of = lambda rows: rows.join(ids, "work_id", "left_semi")
    by = nested(of(authors).select("work_id", "id", "name", "role").distinct(), "work_id", [role_rank(F.col("role")), F.col("name"), F.col("id")], ["id", "name", "role"], "authors")
    about = nested(of(subjects).select("work_id", "subject").distinct(), "work_id", [F.col("subject")], ["subject"], "subjects")
    copies = nested(of(editions).select("work_id", "asin", "page_count").distinct(), "work_id", [F.col("asin"), F.col("page_count")], ["asin", "page_count"], "editions")
    rated = of(quality).select("work_id", F.struct(F.round("blended_avg", 4).cast("decimal(10,4)").cast("string").alias("average"), F.col("total_ratings").alias("count")).alias("rating"))
    own = of(reading).select("work_id", F.struct("total_ms", "sessions").alias("reading"))
    rows = of(works)
    for side in (by, about, copies, rated, own):
        rows = rows.join(side, "work_id", "left")
    parts = ["title", F.col("first_publish_year").alias("year"), "series", cover.alias("cover"), _empty("authors", "array<struct<id:bigint,name:string,role:string>>"), _empty("subjects", "array<string>"), _empty("editions", "array<struct<asin:string,page_count:int>>"), "rating", "reading"]
    return rows.select("work_id", as_json(F.col("work_id").alias("id"), *parts).alias("document"))


def engagement_highlights(totals: DataFrame, works: DataFrame, authors: DataFrame, k: int = 3) -> DataFrame:
    """user_id and a JSON array of each reader's k works of the most reading time (then the latest), with their authors'
    names. totals: user_id, work_id, total_ms, last_read_at; of works that are not known, none. Totals are cut before names
    are looked up."""
    known = totals.join(works.select("work_id", "title"), "work_id")
    top = keep_top(known, ["user_id"], [F.col("total_ms").desc_nulls_last(), F.col("last_read_at").desc_nulls_last(), "work_id"], k)
    names = nested(authors.join(top.select("work_id").distinct(), "work_id", "left_semi").select("work_id", "name").distinct(), "work_id", [F.col("name")], ["name"], "authors")
    rows = top.join(names, "work_id", "left").select("user_id", "title", _empty("authors", "array<string>"), (F.col("total_ms") / 60000).cast("long").alias("minutes"), F.date_format("last_read_at", "yyyy-MM-dd HH:mm:ss").alias("last_read"), "total_ms", "last_read_at", "work_id")
    order = [F.col("total_ms").isNull(), -F.col("total_ms"), F.col("last_read_at").isNull(), -F.unix_micros(F.col("last_read_at").cast("timestamp")), F.col("work_id")]
    return nested(rows, "user_id", order, ["title", "authors", "minutes", "last_read"], "highlights").select("user_id", F.to_json("highlights", {"ignoreNullFields": "false"}).alias("highlights"))


def profile_documents(summary: DataFrame, anchors: DataFrame, works: DataFrame) -> DataFrame:
    """user_id and document of each reader of summary (user_id, works_read, avg_rating, top_subjects, top_authors): these and
    the anchors (user_id, work_id, weight, position) with their titles."""
    titled = anchors.join(works.select("work_id", "title"), "work_id").withColumn("weight", F.col("weight").cast("decimal(18,6)").cast("string"))
    listed = nested(titled, "user_id", [F.col("position")], ["work_id", "title", "weight"], "anchors")
    rows = summary.join(listed, "user_id", "left")
    fields = ["works_read", F.col("avg_rating").cast("decimal(10,4)").cast("string").alias("avg_rating"), _empty("top_subjects", "array<string>"), _empty("top_authors", "array<string>"), _empty("anchors", "array<struct<work_id:bigint,title:string,weight:string>>")]
    return rows.select("user_id", as_json("user_id", *fields).alias("document"))
