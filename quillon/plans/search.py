"""Queries over the trigram index of titles and over duplicates across sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import postings as ps
from quillon.operators import resolve as rs
from quillon.operators.lineage import cut, files
from quillon.plans.resolve import TRI, _jaccard
from quillon.sources.fixtures import Catalogue, sql

#: Name to pattern: ILIKE with a backslash as escape.
PATTERNS = {
    "search_prefix": "bLue %",
    "search_suffix": "%brand#12",
    "search_contains": "%LT bran%",
    "search_wildcard": "b_u% b%#1_%",
    "search_escaped": "%d#__ 100\\%",
    "search_short": "%1_",
}


def _titled(c: Catalogue):
    """Works with longer titles: the brand, and for some a share, a volume mark, or a subtitle."""
    k = F.col("work_id") % 10
    end = F.when(k == 3, " 100%").when(k == 7, " (Book 2)").when(k == 1, ": a tale").otherwise("")
    return c.work.select("work_id", F.concat("title", F.lit(" "), "series", end).alias("title"), "ol_work_key")


TITLED_SQL = "select work_id, concat(title, ' ', series, case work_id % 10 when 3 then ' 100%' when 7 then ' (Book 2)' when 1 then ': a tale' else '' end) title, ol_work_key from work"


def _index(c: Catalogue, name: str, works) -> ps.Index:
    return ps.Index(c.spark, files(c.spark, c.dir, f"titles-{name}", lambda p: ps.build(works, p)))


def _like(c: Catalogue, pattern: str):
    works = _titled(c)
    return ps.matching(works, _index(c, "long", works), pattern).select("work_id", "title")


def _authored(c: Catalogue):
    """work_id, name of the supplier of each of a work's lines."""
    lines = c.table("lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("author_id"))
    return lines.join(c.author, "author_id").select("work_id", "name")


def _potential(c: Catalogue):
    authors = _authored(c)
    first = authors.groupBy("work_id").agg(F.min("name").alias("author"))
    works = _titled(c).join(first, "work_id", "left").select("work_id", "title", F.when(F.col("work_id") % 4 != 0, F.col("author")).alias("author"))
    return rs.potential_duplicates(works, authors).select("work_id", "other_id", F.round("similarity", 6).alias("similarity"))


def _two_sources(c: Catalogue):
    """A third of the works are the shop's, without a catalogue key; half of all have a subject, some an author."""
    shop = F.col("work_id") % 3 == 1
    works = _titled(c).select("work_id", F.when(shop, F.concat("title", F.lit(" (Kindle Edition)"))).otherwise(F.col("title")).alias("title"), F.when(shop, "amazon").otherwise("openlibrary").alias("source"), F.when(~shop, F.col("ol_work_key")).alias("ol_work_key"))
    described = c.work_subject.where("work_id % 2 = 0").select("work_id").unionByName(c.work_author.select("work_id")).distinct()
    return works, described


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        **{name: on(lambda c, p=pattern: _like(c, p)) for name, pattern in PATTERNS.items()},
        "potential_duplicates": on(_potential),
        "cross_source_duplicates": on(lambda c: rs.cross_source_duplicates(*_two_sources(c)).withColumn("similarity", F.round("similarity", 6))),
        "cross_source_classes": on(lambda c: rs.cross_source_classes(*_two_sources(c), checkpoint=cut)),
    }


def oracle_sql() -> dict[str, str]:
    tri = lambda x: TRI.format(x)
    sim = _jaccard("x.g", "y.g")
    bare = "lower(regexp_replace(regexp_replace(regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '', 'g'), '\\s*:.*$', ''), '\\s*(Book\\s*\\d+|#\\d+|Volume\\s*\\d+)\\s*$', '', 'i'))"
    near = f"""select x.name x, y.name y, round(case when x.name = y.name then 1.0::double else {sim} end, 9) similarity from nm x join nm y
        on x.name = y.name or {sim} > {{0}}"""
    sources = {
        "titled": TITLED_SQL,
        "two": "select work_id, case when work_id % 3 = 1 then concat(title, ' (Kindle Edition)') else title end title, case when work_id % 3 <> 1 then ol_work_key end k from titled",
        "named": f"select work_id, {bare} as name, k from two",
        "described": "select work_id from work_subject where work_id % 2 = 0 union select work_id from work_author",
        "shop": "select work_id, name from named where k is null",
        "shelf": "select work_id, name from named where k is not null and work_id in (select work_id from described)",
        "nm": f"select name, {tri('name')} g from (select name from shop union select name from shelf)",
        "near": near.format(0.85),
    }
    return {
        **{name: sql(f"select work_id, title from titled where title ilike '{pattern}' escape '\\'", "work", titled=TITLED_SQL) for name, pattern in PATTERNS.items()},
        "potential_duplicates": sql(
            f"""select work_id, other_id, round(similarity, 6) similarity from top where author is null or exists (select 1 from authors a where a.work_id = top.other_id and {_jaccard(tri('a.name'), tri('top.author'))} > 0.5)""",
            "work author",
            titled=TITLED_SQL,
            authors="select distinct l_partkey work_id, name from lineitem join author on l_suppkey = author_id",
            named="select work_id, lower(title) as name, case when work_id % 4 <> 0 then (select min(name) from authors a where a.work_id = titled.work_id) end author from titled",
            nm=f"select name, {tri('name')} g from (select distinct name from named)",
            near=near.format(0.6),
            top="select * from (select *, row_number() over (partition by work_id order by similarity desc, other_id) r from (select n.work_id, m.work_id other_id, similarity, n.author from named n join near on n.name = near.x join named m on m.name = near.y and m.work_id <> n.work_id)) where r <= 10",
        ),
        "cross_source_duplicates": sql("select shop_id, catalogue_id, round(similarity, 6) similarity from (select shop.work_id shop_id, shelf.work_id catalogue_id, similarity from shop join near on near.x = shop.name join shelf on shelf.name = near.y order by similarity desc, near.x, near.y, 1, 2 limit 1000)", "work work_subject work_author", **sources),
        "cross_source_classes": sql(
            "select work_id, min(other) class_id from reach group by 1", "work work_subject work_author", True, **sources,
            links="select distinct shop.work_id a, shelf.work_id b from shop join near on near.x = shop.name join shelf on shelf.name = near.y",
            edge="select a, b from links union select b, a from links",
            reach="select a work_id, a other from edge union select reach.work_id, edge.b from reach join edge on edge.a = reach.other",
        ),
    }
