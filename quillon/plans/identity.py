"""Queries over identity resolution with look-ups, merges, enrichment and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scoring, text
from quillon.operators import identity as idn
from quillon.operators import resolve as rs
from quillon.operators.lineage import cut, shuffled, table
from quillon.plans.resolve import BI, NORM, TRI
from quillon.sources.fixtures import Catalogue, sql

NEW = 1 << 61  # ids from here on are of works and authors that a query makes; its rows show null for them


def _k():
    return F.col("p_partkey")


def _pad(prefix: str, n: int):
    return F.concat(F.lit(prefix), F.lpad(_k().cast("string"), n, "0"))


def _tag(letter: str, n=None):
    return F.concat(F.lit(letter), (_k() if n is None else n).cast("string"))


def _editions(c: Catalogue):
    """Editions with identifiers of every kind, one a work."""
    pick = lambda m, x: F.when(_k() % m == 0, x)
    return c.table("part").select(
        _k().alias("edition_id"), _k().alias("work_id"), pick(2, _pad("979", 10)).alias("isbn13"), pick(3, F.concat(_pad("", 9), F.lit("X"))).alias("isbn10"), pick(4, _tag("v")).alias("volume_id"), pick(5, _pad("B", 9)).alias("asin"),
        pick(7, _k().cast("string")).alias("serial_id"), pick(11, _k().cast("string")).alias("goodreads_id"), pick(6, _tag("c")).alias("cover_url"), F.when(_k() % 8 != 0, (_k() % 900).cast("int")).alias("page_count"),
    )


def _works(c: Catalogue):
    return c.table("part").select(_k().alias("work_id"), F.col("p_name").alias("title"), F.when(_k() % 3 == 0, _tag("D")).alias("description"), F.when(_k() % 5 != 0, 1950 + F.col("p_size")).alias("first_publish_year"), (_k() % 4 == 1).alias("is_stub"))


def _inputs(c: Catalogue):
    """Ten kinds of requests by the last digit."""
    m = _k() % 10
    is_ = lambda k, x: F.when(m == k, x)
    ten = F.concat(F.substring(_pad("", 9), 1, 4), F.lit("-"), F.substring(_pad("", 9), 5, 5), F.lit("-X"))
    title = F.when(m == 4, F.col("p_name")).when(m == 5, F.concat(F.col("p_name"), F.lit(" x"))).when(m == 9, F.concat(F.lit("qzx "), _k().cast("string")))
    author = F.when(m == 4, F.concat(F.lit("Supplier#"), F.lpad((_k() % 50).cast("string"), 9, "0"))).when(m == 5, F.lit("Nobody"))
    return c.table("part").select(
        _k().alias("id"), F.when(m == 0, _pad("979", 10)).when(m == 2, _pad("977", 10)).alias("isbn13"), is_(1, ten).alias("isbn10"), is_(3, _tag("v", _k() + 1)).alias("volume_id"), is_(6, _pad("b", 9)).alias("asin"),
        is_(7, _k().cast("string")).alias("serial_id"), is_(8, _k().cast("string")).alias("goodreads_id"), title.alias("title"), author.alias("author"), F.when(_k() % 2 == 0, _tag("I")).alias("description"), F.when(_k() % 3 == 0, F.lit("June 1977")).alias("published"),
    )


def _lookup(c: Catalogue):
    m = _k() % 10
    rows = c.table("part").where(((m == 2) & (_k() % 4 == 2)) | ((m == 3) & (_k() % 3 == 0)) | ((m == 5) & (_k() % 3 == 0)))
    return rows.select(
        F.when(m == 2, _pad("977", 10)).alias("isbn13"), F.when(m == 3, _tag("v", _k() + 1)).otherwise(_tag("L")).alias("volume_id"), F.when(m == 5, F.concat(F.col("p_name"), F.lit(" x"))).alias("asked_title"),
        F.when(m == 5, F.lit("nobody")).alias("asked_author"), F.col("p_name").alias("title"), _tag("R").alias("description"), F.lit("1999-05-01").alias("published"),
    )


def _author_names(c: Catalogue):
    return c.work_author.join(shuffled(c.author), "author_id").select("work_id", "name")


def _resolved(c: Catalogue):
    """Resolutions of all requests, written once: what follows uses them."""
    return table(c.spark, c.dir, "resolved", lambda: idn.resolve(_inputs(c), _works(c), _editions(c), _author_names(c), _lookup(c)))


def _shown(rows, *ids: str):
    """rows with the ids that a query makes as null."""
    return rows.withColumns({i: F.when(F.col(i) < NEW, F.col(i)) for i in ids})


def _urls(c: Catalogue):
    k = _k().cast("string")
    url = (
        F.when(_k() % 6 == 0, F.concat(F.lit("https://www.amazon.com/Some-Title/dp/"), _pad("b", 9), F.lit("?ref=x"))).when(_k() % 6 == 1, F.concat(F.lit("https://read.amazon.com/kindle-dbs/detail?x=1&asin="), _pad("B", 9)))
        .when(_k() % 6 == 2, F.concat(F.lit("https://goodreads.com/book/show/"), k, F.lit("-a-book"))).when(_k() % 6 == 3, F.concat(F.lit("http://www.royalroad.com/fiction/"), k, F.lit("/x")))
        .when(_k() % 6 == 4, F.concat(F.lit("https://books.google.com/books?id=v"), k)).otherwise(F.concat(F.lit("https://example.org/dp/"), _pad("B", 9)))
    )
    return c.table("part").select(_k().alias("id"), url.alias("url"), F.when(_k() % 12 == 5, F.col("p_name")).alias("title"))


def _by_url(c: Catalogue):
    """Identifiers from addresses, then the resolver; what has none fails and is left out."""
    rows = _urls(c).withColumn("x", text.external_ids("url"))
    none = F.lit(None).cast("string")
    inputs = rows.select("id", none.alias("isbn13"), none.alias("isbn10"), "x.*", "title", none.alias("author"))
    return idn.resolve(inputs, _works(c), _editions(c), _author_names(c), _lookup(c)).select("id", "path", F.round("confidence", 6).alias("confidence"), "work_id", "lookup_key")


def _merges(c: Catalogue):
    m = table(c.spark, c.dir, "merges", lambda: rs.merge_map(c.redirect.select(F.col("old_key").alias("a"), F.col("new_key").alias("b")), checkpoint=cut))
    return m.withColumn("reason", F.lit("redirect"))


def _merged(c: Catalogue) -> dict:
    rating = c.rating.withColumn("last_updated", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("work_id") % 100).cast("int")))
    return idn.merge_all(_merges(c), {"edition": _editions(c), "work_author": c.work_author, "work_subject": c.work_subject, "user_event": c.user_event, "rating": rating, "work": _works(c)})


def _records(c: Catalogue):
    """Outside records of two thirds of the works."""
    return c.table("part").where("p_partkey % 3 <> 1").select(
        _k().alias("work_id"), F.when(_k() % 2 == 0, _tag("R")).alias("description"), F.when(_k() % 5 == 0, F.lit("May 1985")).alias("published"), F.when(_k() % 4 != 0, _tag("u")).alias("cover_url"), _tag("L").alias("volume_id"), F.lit(321).alias("page_count"),
        F.when(_k() % 2 == 0, F.array(F.lit("Science  Fiction"), F.lit("R&D!"), F.lit("??"))).otherwise(F.array(F.col("p_type"))).alias("categories"), F.when(_k() % 7 == 0, F.lit("Ann Lee & supplier#000000003, New One")).alias("authors"), (_k() % 6).cast("double").alias("avg"), (_k() % 10).alias("n"),
    )


def _library(c: Catalogue):
    m = _k() % 3
    return c.table("part").select(_k().alias("book_id"), F.when(m == 0, _pad("979", 10)).when(m == 1, F.concat(_pad("977", 10))).alias("isbn13"), F.when(m == 2, F.concat(_pad("", 9), F.lit("X"))).alias("isbn10"), F.concat(F.lit("qzx "), _k().cast("string")).alias("title"), F.lit("Nobody").alias("author"))


def _imported(c: Catalogue):
    return idn.import_library(_library(c), c.user_event.where("user_id = 1"), _works(c), _editions(c), _author_names(c), _lookup(c))


def _legacy(c: Catalogue):
    rows = idn.resolve_legacy(_inputs(c).where("title is not null").select("id", "title", F.coalesce("author", F.lit("")).alias("author")), _works(c), _author_names(c))
    return rows.select("id", "work_id", F.round("confidence", 6).alias("confidence"))


def _linked(c: Catalogue):
    named = _records(c).where("authors is not null").select("work_id", "authors")
    authors, pairs = idn.link_names(c.work_author, c.author, named, fold=True)
    return pairs.join(authors, "author_id").select("work_id", "name")


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    inputs = lambda c: _inputs(c)
    return {
        "resolve_works": on(lambda c: _resolved(c).select("id", "path", F.round("confidence", 6).alias("confidence"), "work_id", "edition_id", "created", "is_stub", "lookup_key", F.col("record.volume_id").alias("record_id"))),
        "resolve_legacy": on(_legacy),
        "resolve_urls": on(_by_url),
        "url_shop_ids": on(lambda c: _urls(c).select("id", text.external_ids("url").alias("x"), text.first_external_id("url").alias("f")).select("id", "x.*", F.col("f.type").alias("first_type"), text.is_book_asin("x.asin").alias("book_asin"), text.external_url("asin", "x.asin").alias("asin_url"))),
        "upsert_works": on(lambda c: _shown(idn.upsert_works(_works(c), _resolved(c), inputs(c)), "work_id")),
        "upsert_editions": on(lambda c: _shown(idn.upsert_editions(_editions(c), _resolved(c), inputs(c)), "work_id", "edition_id")),
        "merged_editions": on(lambda c: _merged(c)["edition"].select("edition_id", "work_id")),
        "merged_work_subjects": on(lambda c: _merged(c)["work_subject"]),
        "merged_events": on(lambda c: _merged(c)["user_event"].select("user_id", "work_id", "shelf", "rating")),
        "merged_ratings": on(lambda c: _merged(c)["rating"].select("work_id", "source", F.round("avg", 6).alias("avg"), "n", "last_updated")),
        "merged_works": on(lambda c: _merged(c)["work"]),
        "merge_log": on(lambda c: _merged(c)["log"]),
        "merge_history": on(lambda c: idn.merge_history(_merges(c).withColumn("merged_at", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("from_id") % 1000).cast("int"))), 1)),
        "enriched_works": on(lambda c: idn.enrich(_works(c), _editions(c), _records(c))["work"]),
        "enriched_editions": on(lambda c: idn.enrich(_works(c), _editions(c), _records(c))["edition"].select("edition_id", "volume_id", "cover_url", "page_count")),
        "enriched_subjects": on(lambda c: idn.add_subjects(c.work_subject, _records(c))),
        "enriched_ratings": on(lambda c: idn.add_ratings(c.rating, _records(c)).withColumn("avg", F.round("avg", 6))),
        "enriched_authors": on(_linked),
        "library_import": on(lambda c: _shown(_imported(c), "work_id")),
        "asin_memo": on(lambda c: idn.resolve_asins(c.table("part").select(_pad("b", 9).alias("asin"), F.when(_k() % 2 == 0, F.col("p_name")).alias("title")), _editions(c))),
    }


def _dice(a: str, b: str) -> str:
    p, q = NORM.format(a), NORM.format(b)
    x, y = BI.format(p), BI.format(q)
    return f"(case when {p} = {q} then 1.0::double when length({p}) < 2 or length({q}) < 2 then 0.0::double else 2.0::double * len(list_intersect({x}, {y})) / (len({x}) + len({y})) end)"


def _resolve_sql(inputs: str) -> dict[str, str]:
    """Common tables that resolve `inputs`; the last one is `res`."""
    both = "len(list_intersect(g, h))"
    path = " ".join(f"when '{k}' then {v}::double" for k, v in scoring.PATH_CONFIDENCE.items())
    return {
        "inp": inputs,
        "prep": """select *, trim(lower(title)) q, case when isbn13 is not null then isbn13 end n13, case when isbn13 is null and isbn10 is not null then upper(replace(isbn10, '-', '')) end n10,
          case when isbn13 is not null or isbn10 is not null then 'isbn' when volume_id is not null then 'gbid' when title is not null and author is not null then 'title' when asin is not null then 'asin' when serial_id is not null then 'royalroad' when goodreads_id is not null then 'goodreads' when title is not null then 'title' end kind from inp""",
        "ids": """select id, min(work_id) work_id, min(edition_id) edition_id from (
          select id, e.work_id, e.edition_id from prep p join ed e on p.kind = 'isbn' and (p.n13 = e.isbn13 or p.n10 = e.isbn10) union all select id, e.work_id, e.edition_id from prep p join ed e on p.kind = 'gbid' and upper(p.volume_id) = upper(e.volume_id)
          union all select id, e.work_id, e.edition_id from prep p join ed e on p.kind = 'asin' and upper(p.asin) = upper(e.asin) union all select id, e.work_id, e.edition_id from prep p join ed e on p.kind = 'royalroad' and p.serial_id = e.serial_id
          union all select id, e.work_id, e.edition_id from prep p join ed e on p.kind = 'goodreads' and p.goodreads_id = e.goodreads_id) group by 1""",
        "qs": f"select q, {TRI.format('q')} g from (select distinct q from prep where kind = 'title')",
        "ts": f"select t, {TRI.format('t')} h from (select distinct lower(title) t from wk)",
        "near": f"select q, t, {both}::double / (len(g) + len(h) - {both}) s from qs, ts where {both}::double / (len(g) + len(h) - {both}) >= 0.3",
        "hits": "select *, row_number() over (partition by q order by round(s, 9) desc, work_id, edition_id nulls last, name nulls last) r from (select q, s, w.work_id, e.edition_id, n.name from near join wk w on lower(w.title) = t left join ed e on e.work_id = w.work_id left join nm n on n.work_id = w.work_id) qualify r <= 10",
        "liked": f"select id, r, work_id, edition_id, s, case when author is not null and name is not null then {_dice('trim(lower(author))', 'lower(name)')} end a from prep join hits using (q) where kind = 'title'",
        "tit": """select id, case when single or not b then bw else lw end t_work, case when single or not b then be else le end t_edition, case when single then least(0.95, 0.7 + 0.3 * bs) when b then least(0.95, 0.7 + 0.15 * ls + 0.15 * la) else least(0.8, 0.5 + 0.35 * bs) end sure from (
          select *, n = 1 and bs >= 0.8 single, lr is not null b from (select id, count(*) n, min_by(work_id, r) bw, min_by(edition_id, r) be, min_by(s, r) bs, min(r) filter (a >= 0.7) lr, min_by(work_id, r) filter (a >= 0.7) lw, min_by(edition_id, r) filter (a >= 0.7) le, min_by(s, r) filter (a >= 0.7) ls, min_by(a, r) filter (a >= 0.7) la from liked group by 1))""",
        "out0": f"""select id, l.volume_id rv, l.title rt, l.description rd, l.published rp, l.isbn13 ri from prep p join lk l on p.kind = 'isbn' and coalesce(p.n13, p.n10) = l.isbn13 union all select id, l.volume_id, l.title, l.description, l.published, l.isbn13 from prep p join lk l on p.kind = 'gbid' and p.volume_id = l.volume_id
          union all select id, l.volume_id, l.title, l.description, l.published, l.isbn13 from prep p join (select * from lk qualify row_number() over (partition by lower(asked_title), lower(asked_author) order by volume_id) = 1) l on (p.kind = 'title' or (p.kind not in ('isbn', 'gbid') and p.title is not null and p.author is not null)) and lower(p.title) = lower(l.asked_title) and lower(coalesce(p.author, '')) = lower(coalesce(l.asked_author, '')) where {_dice('lower(p.title)', 'lower(l.title)')} >= 0.6""",
        "outs": "select * from out0 qualify row_number() over (partition by id order by rv) = 1",
        "al": "select p.*, i.work_id, i.edition_id, t_work, t_edition, coalesce(sure, 0) sure, rv, rt, rd, rp, ri, kind = 'title' and (coalesce(sure, 0) >= 0.85 or (rv is null and coalesce(sure, 0) >= 0.7)) bt from prep p left join ids i on p.id = i.id left join tit t on p.id = t.id left join outs o on p.id = o.id where kind is not null",
        "pa": "select *, case when kind = 'isbn' then case when work_id is not null then 'isbn_ol' when rv is not null then 'isbn_gb' else 'isbn_local' end when kind = 'title' then case when bt or rv is not null then 'title_gb' else 'manual' end else kind end path from al",
        "res0": f"""select id, path, case when bt then sure when kind = 'gbid' and work_id is null and rv is null then 0.4 else case path {path} end end confidence, case when bt then t_work when kind <> 'title' then work_id end work_id, case when bt then t_edition when kind <> 'title' then edition_id end edition_id,
          case when isbn13 is not null then 'isbn13:' || isbn13 when isbn10 is not null then 'isbn10:' || isbn10 when volume_id is not null then 'gbid:' || volume_id when asin is not null then 'asin:' || upper(asin) when serial_id is not null then 'rr:' || serial_id when goodreads_id is not null then 'gr:' || goodreads_id else concat('title:', q, '|author:', trim(lower(coalesce(author, '')))) end lookup_key, rv, rt, rd, rp, ri from pa""",
        "res": "select id, path, confidence, work_id, edition_id, work_id is null created, work_id is null and confidence < 0.7 is_stub, lookup_key, case when work_id is null then rv end rv, case when work_id is null then rt end rt, case when work_id is null then rd end rd, case when work_id is null then rp end rp, case when work_id is null then ri end ri from res0",
    }


def oracle_sql() -> dict[str, str]:
    pad = lambda p, n: f"concat('{p}', lpad(p_partkey::varchar, {n}, '0'))"
    base = {
        "ed": f"""select p_partkey edition_id, p_partkey work_id, case when p_partkey % 2 = 0 then {pad('979', 10)} end isbn13, case when p_partkey % 3 = 0 then concat({pad('', 9)}, 'X') end isbn10, case when p_partkey % 4 = 0 then concat('v', p_partkey) end volume_id, case when p_partkey % 5 = 0 then {pad('B', 9)} end asin,
          case when p_partkey % 7 = 0 then p_partkey::varchar end serial_id, case when p_partkey % 11 = 0 then p_partkey::varchar end goodreads_id, case when p_partkey % 6 = 0 then concat('c', p_partkey) end cover_url, case when p_partkey % 8 <> 0 then (p_partkey % 900)::int end page_count from part""",
        "wk": "select p_partkey work_id, p_name title, case when p_partkey % 3 = 0 then concat('D', p_partkey) end description, case when p_partkey % 5 <> 0 then 1950 + p_size end first_publish_year, p_partkey % 4 = 1 is_stub from part",
        "nm": "select work_id, name from work_author join author using (author_id)",
        "lk": f"""select case when m = 2 then {pad('977', 10)} end isbn13, case when m = 3 then concat('v', p_partkey + 1) else concat('L', p_partkey) end volume_id, case when m = 5 then p_name || ' x' end asked_title, case when m = 5 then 'nobody' end asked_author, p_name title, concat('R', p_partkey) description, '1999-05-01' published
          from (select *, p_partkey % 10 m from part) where (m = 2 and p_partkey % 4 = 2) or (m = 3 and p_partkey % 3 = 0) or (m = 5 and p_partkey % 3 = 0)""",
    }
    inputs = f"""select p_partkey id, case when m = 0 then {pad('979', 10)} when m = 2 then {pad('977', 10)} end isbn13, case when m = 1 then concat(substring({pad('', 9)}, 1, 4), '-', substring({pad('', 9)}, 5, 5), '-X') end isbn10, case when m = 3 then concat('v', p_partkey + 1) end volume_id, case when m = 6 then {pad('b', 9)} end asin,
      case when m = 7 then p_partkey::varchar end serial_id, case when m = 8 then p_partkey::varchar end goodreads_id, case when m = 4 then p_name when m = 5 then p_name || ' x' when m = 9 then concat('qzx ', p_partkey) end title, case when m = 4 then concat('Supplier#', lpad((p_partkey % 50)::varchar, 9, '0')) when m = 5 then 'Nobody' end author,
      case when p_partkey % 2 = 0 then concat('I', p_partkey) end description, case when p_partkey % 3 = 0 then 'June 1977' end published from (select *, p_partkey % 10 m from part)"""
    every = base | _resolve_sql(inputs)
    url = f"""case p_partkey % 6 when 0 then concat('https://www.amazon.com/Some-Title/dp/', {pad('b', 9)}, '?ref=x') when 1 then concat('https://read.amazon.com/kindle-dbs/detail?x=1&asin=', {pad('B', 9)}) when 2 then concat('https://goodreads.com/book/show/', p_partkey, '-a-book') end"""
    shop = f"case when p_partkey % 6 < 2 then {pad('B', 9)} end"
    by_url = base | _resolve_sql(f"select p_partkey id, null::varchar isbn13, null::varchar isbn10, {shop} asin, case when p_partkey % 6 = 2 then p_partkey::varchar end goodreads_id, case when p_partkey % 6 = 3 then p_partkey::varchar end serial_id, case when p_partkey % 6 = 4 then concat('v', p_partkey) end volume_id, case when p_partkey % 12 = 5 then p_name end title, null::varchar author from part")
    views = "work_author author"
    root = "({0} // ({0} & -{0}))"
    merged = {"mg": f"select p_partkey from_id, {root.format('p_partkey')} to_id from part where p_partkey > 0 and p_partkey % 2 = 0"}
    to = lambda x: f"case when {x} > 0 then {root.format(x)} else {x} end"
    rec = {
        "rec": """select p_partkey work_id, case when p_partkey % 2 = 0 then concat('R', p_partkey) end description, case when p_partkey % 5 = 0 then 1985 end y, case when p_partkey % 4 <> 0 then concat('u', p_partkey) end cover_url, concat('L', p_partkey) volume_id, 321 page_count,
          case when p_partkey % 2 = 0 then ['science_fiction', 'rd'] else [regexp_replace(regexp_replace(lower(p_type), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g')] end cats, (p_partkey % 6)::double avg, p_partkey % 10 n from part where p_partkey % 3 <> 1"""
    }
    kinds = ", ".join(f"coalesce(e.{k}, d.{k}) {k}" for k in idn.KINDS)
    new = lambda k: f"coalesce(case when r.work_id is null then r.{ {'isbn13': 'ri', 'volume_id': 'rv'}[k] } end, i.{k})" if k in ("isbn13", "volume_id") else f"i.{k}"
    fresh = ", ".join(f"{new(k)} {k}" for k in idn.KINDS)
    lib = f"select p_partkey book_id, case when p_partkey % 3 = 0 then {pad('979', 10)} when p_partkey % 3 = 1 then {pad('977', 10)} end isbn13, case when p_partkey % 3 = 2 then concat({pad('', 9)}, 'X') end isbn10 from part"
    exact = f"select i.id, work_id, name, row_number() over (partition by i.id order by work_id, name nulls last) r, case when name is not null and i.author <> '' then {_dice('i.author', 'name')} end a from li i join lw w on w.t = i.q"
    return {
        "resolve_works": sql("select id, path, round(confidence, 6) confidence, work_id, edition_id, created, is_stub, lookup_key, rv record_id from res", views, **every),
        "resolve_legacy": sql(
            "select id, work_id, round(confidence, 6) confidence from ex2 union all select id, work_id, round(c, 6) from (select id, work_id, c, row_number() over (partition by id order by round(c, 9) desc, r) z from fz) where z = 1 and c >= 0.7", views,
            **base, inp=inputs, li="select id, trim(lower(title)) q, trim(lower(case when author like '%,%' then author else coalesce(author, '') end)) author from inp where title is not null",
            lw="select w.work_id, lower(title) t, lower(name) name from wk w left join nm n on w.work_id = n.work_id", ex=exact,
            ex2="select id, case when n > 1 and lr is not null then lw else f end work_id, case when n = 1 then 0.9::double when lr is not null then 0.95::double else 0.7::double end confidence from (select id, count(*) n, min_by(work_id, r) f, min(r) filter (a >= 0.8) lr, min_by(work_id, r) filter (a >= 0.8) lw from ex group by 1)",
            ws="select distinct string_split(q, ' ')[1] word from li where id not in (select id from ex2) and length(string_split(q, ' ')[1]) >= 2",
            cand="select word, work_id, t, name, row_number() over (partition by word order by work_id, name nulls last) r from ws join lw on t like word || '%'",
            fz=f"select id, work_id, r, case when a >= 0.7 then least(1.0::double, s + 0.1::double) else s end c from (select i.id, k.work_id, k.r, {_dice('i.q', 'k.t')} s, case when k.name is not null and i.author <> '' then {_dice('i.author', 'k.name')} end a from li i join cand k on k.word = string_split(i.q, ' ')[1] where i.id not in (select id from ex2)) where s >= 0.6",
        ),
        "resolve_urls": sql("select id, path, round(confidence, 6) confidence, work_id, lookup_key from res", views, **by_url),
        "url_shop_ids": f"""select p_partkey id, {shop} asin, case when p_partkey % 6 = 2 then p_partkey::varchar end goodreads_id, case when p_partkey % 6 = 3 then p_partkey::varchar end serial_id, case when p_partkey % 6 = 4 then concat('v', p_partkey) end volume_id,
            case p_partkey % 6 when 0 then 'asin' when 1 then 'asin' when 2 then 'goodreads_id' when 3 then 'serial_id' when 4 then 'volume_id' end first_type, case when p_partkey % 6 < 2 then true end book_asin, case when p_partkey % 6 < 2 then concat('https://www.amazon.com/dp/', {pad('B', 9)}) end asin_url from part""",
        "upsert_works": sql("select w.work_id, coalesce(w.title, n.title) title, coalesce(w.description, n.description) description, coalesce(w.first_publish_year, n.y) first_publish_year, coalesce(w.is_stub, n.is_stub) is_stub from wk w full join n on w.work_id = n.work_id", views, **every,
            n="""select work_id, coalesce(rt, title, 'Unknown Title') title, coalesce(rd, description) description, case when rp is not null then 1999 when published is not null then 1977 end y, is_stub from (
              select r.work_id, rt, i.title, rd, i.description, rp, i.published, r.is_stub, row_number() over (partition by coalesce(r.work_id::varchar, r.lookup_key) order by r.id) z from res r join inp i on r.id = i.id) where z = 1"""),  # fmt: skip
        "upsert_editions": sql(f"select e.edition_id, coalesce(e.work_id, d.work_id) work_id, {kinds} from ed e full join d on e.edition_id = d.edition_id", views, **every, d=f"select r.edition_id, r.work_id, {fresh} from res r join inp i on r.id = i.id qualify row_number() over (partition by coalesce(r.edition_id::varchar, r.work_id::varchar, r.lookup_key) order by r.id) = 1"),
        "merged_editions": sql(f"select p_partkey edition_id, {to('p_partkey')} work_id from part", ""  , **merged),
        "merged_work_subjects": sql(f"select distinct {to('work_id')} work_id, subject from work_subject", "work_subject"),
        "merged_events": sql(f"select user_id, to_id work_id, shelf, rating from (select *, {to('work_id')} to_id from user_event) qualify row_number() over (partition by user_id, to_id, source order by case when work_id = to_id then 0 else 1 end, work_id) = 1", "user_event"),
        "merged_ratings": sql(f"select to_id work_id, source, round(avg, 6) avg, n, l last_updated from (select *, max(d) over (partition by to_id, source) l, row_number() over (partition by to_id, source order by case when work_id = to_id then 1 else 0 end, work_id desc) z from (select *, {to('work_id')} to_id, date '2020-01-01' + (work_id % 100)::int d from rating)) where z = 1", "rating"),
        "merged_works": sql("""select w.work_id, title, coalesce(description, d) description, coalesce(first_publish_year, y) first_publish_year, is_stub and t.to_id is null is_stub from wk w left join (
            select to_id, min_by(description, from_id) filter (description is not null) d, min_by(first_publish_year, from_id) filter (first_publish_year is not null) y from mg join wk on work_id = from_id group by 1) t on w.work_id = t.to_id where w.work_id not in (select from_id from mg)""", "", wk=base["wk"], **merged),
        "merge_log": sql("select from_id, to_id, 'redirect' reason, 1::bigint editions_moved from mg", "", **merged),
        "merge_history": sql("select from_id, 'redirect' reason, date '2020-01-01' + (from_id % 1000)::int merged_at from mg where to_id = 1", "", **merged),
        "enriched_works": sql("select w.work_id, title, coalesce(w.description, r.description) description, coalesce(first_publish_year, y) first_publish_year, is_stub and not coalesce((w.description is null and r.description is not null) or (w.work_id % 6 <> 0 and r.cover_url is not null), false) is_stub from wk w left join rec r on w.work_id = r.work_id", "", wk=base["wk"], **rec),
        "enriched_editions": sql("select edition_id, case when f then coalesce(e.volume_id, r.volume_id) else e.volume_id end volume_id, case when f then r.cover_url else e.cover_url end cover_url, case when f then coalesce(e.page_count, r.page_count) else e.page_count end page_count from ed e left join rec r on e.work_id = r.work_id, lateral (select e.cover_url is null and r.cover_url is not null f)", "", ed=base["ed"], **rec),
        "enriched_subjects": sql("select distinct work_id, subject from (select work_id, subject from work_subject union all select work_id, unnest(cats) from rec)", "work_subject", **rec),
        "enriched_ratings": sql("select work_id, source, round(avg, 6) avg, n from rating where source <> 'googlebooks' or work_id not in (select work_id from rec where avg > 0 and n > 0) union all select work_id, 'googlebooks', avg, n from rec where avg > 0 and n > 0", "rating", **rec),
        "enriched_authors": sql("select distinct work_id, name from (select work_id, name from work_author join author using (author_id) union all select p_partkey, unnest(['Ann Lee', 'New One', coalesce((select min_by(name, author_id) from author where lower(name) = 'supplier#000000003'), 'supplier#000000003')]) from part where p_partkey % 3 <> 1 and p_partkey % 7 = 0)", views),
        "library_import": sql("""select book_id, case when skip then 'skipped' when w is not null then 'isbn' else 'resolver' end step, case when not skip then w end work_id from (
            select l.book_id, a.work_id w, coalesce(a.work_id in (select work_id from user_event where user_id = 1), false) skip from lib l left join ed a on a.isbn13 = l.isbn13 or a.isbn10 = l.isbn10)""", "user_event", ed=base["ed"], lib=lib),
        "asin_memo": f"select {pad('B', 9)} asin, case when p_partkey % 5 = 0 then p_partkey end work_id, case when p_partkey % 2 = 0 then p_name else {pad('B', 9)} end title from part",
    }
