"""Queries over candidates, re-ranking and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scoring, text, vectors
from quillon.operators import collaborative as co
from quillon.operators import graph as gr
from quillon.operators import ratings as rt
from quillon.operators import reading as rd
from quillon.operators import recommend as rc
from quillon.plans.ratings import PAIRS_SQL, QUALITY_SQL, WORK
from quillon.plans.reading import TASTE_SQL, USER, WEIGHT_VIEWS, EDGES_SQL, LPA_SQL, graph_edges, weighted
from quillon.operators.lineage import cut, small, table
from quillon.sources.fixtures import SESSIONS_AS_OF, Catalogue, as_of, sql

#: Sizes of the parts of a reader's candidates, and of those of one book.
GENERAL, GRAPH_ANCHORS, READER_ANCHORS, COMMUNITY_ANCHORS, EACH_READERS, EACH_COMMUNITY = 2000, 5, 10, 3, 30, 50
BY_BOOK, SIMILAR, MATES = 500, 100, 30
SUBJECTS, WITHOUT = ["standard", "promo"], ["red"]


def _own(c: Catalogue):
    """The reader's weighted events, written once: they are what profile, anchors and exclusions come from."""
    return table(c.spark, c.dir, f"events-{USER}", lambda: weighted(c, USER))


def _anchors(c: Catalogue, k: int):
    return rd.anchors(_own(c), k).select(F.col("work_id").alias("anchor"), "weight", "position")


def _blocks(c: Catalogue):
    return c.block.where(F.col("user_id") == USER)


def _excluded(c: Catalogue):
    """Works that the reader has an event with or blocks."""
    return _own(c).select("work_id").union(_blocks(c).where("work_id is not null").select("work_id")).distinct()


def _seen(c: Catalogue):
    return _own(c).select("work_id").distinct()


def _edges(c: Catalogue):
    """The graph's edges, written once."""
    return table(c.spark, c.dir, "graph-edges", lambda: graph_edges(c))


def _pairs(c: Catalogue):
    """Who read what, written once; co-reading looks at it several times."""
    return table(c.spark, c.dir, "reading-pairs", lambda: co.reading_pairs(c.reading_log))


def _nearest(c: Catalogue, one, excluded, k: int):
    """The k works next to a vector (one row)."""
    new = c.work.where("embedding is not null").join(excluded, "work_id", "left_anti")
    sims = new.crossJoin(F.broadcast(one)).select("work_id", vectors.cosine("embedding", "vector").alias("sim"))
    return sims.orderBy(F.col("sim").desc(), "work_id").limit(k).select("work_id", F.lit("vector").alias("source"), F.lit(1).alias("seq"), "sim")


def _general(c: Catalogue):
    """Four sources. The profile is one row and the anchors are ten: these are broadcast."""
    out = cut(_excluded(c), "excluded")
    vec = _nearest(c, rd.profile_vector(_own(c), c.work).select("vector"), out, GENERAL)
    edges, anchors = _edges(c), _anchors(c, READER_ANCHORS)
    some = lambda k: F.broadcast(anchors.where(F.col("position") <= k))
    mid = edges.join(some(GRAPH_ANCHORS), F.col("work_id") == F.col("anchor")).select("node", "anchor", "weight", "position").distinct()
    near = edges.join(small(cut(mid, "mid")), "node").where("work_id <> anchor").select("work_id", "anchor", "weight", "position").distinct()
    near = near.select("work_id", F.lit("graph").alias("source"), F.col("position").alias("seq"), (0.5 * F.col("weight")).alias("sim"))
    batch = co.similar_works_batch(c.cooccurrence, anchors.select(F.col("anchor").alias("work_id")), EACH_READERS)
    cf = batch.join(F.broadcast(anchors), F.col("work_id") == F.col("anchor"))
    cf = cf.select(F.col("related_id").alias("work_id"), F.lit("readers").alias("source"), F.col("position").alias("seq"), (F.col("jaccard").cast("double") * F.col("weight") * 0.8).alias("sim"))
    mates = gr.community_candidates(c.community, anchors.where(F.col("position") <= COMMUNITY_ANCHORS).select(F.col("anchor").alias("work_id")), EACH_COMMUNITY)
    mates = mates.join(F.broadcast(anchors), "anchor").select("work_id", F.lit("community").alias("source"), F.col("position").alias("seq"), (0.3 * F.col("weight")).alias("sim"))
    hits = vec.unionByName(near.unionByName(cf).unionByName(mates).join(out, "work_id", "left_anti"))
    fused = rc.without_blocked(rc.fuse(hits, rc.BOOSTS_GENERAL), c.work_author, authors=_blocks(c))
    return fused.orderBy(F.col("score").desc(), "work_id").limit(GENERAL)


def _by_book(c: Catalogue):
    """R11 for one work: works of the reader, blocked ones and the work itself are left out; a book without a vector has none."""
    out = cut(_excluded(c).union(c.work.where(F.col("work_id") == WORK).select("work_id")), "excluded")
    seed = c.work.where((F.col("work_id") == WORK) & F.col("embedding").isNotNull()).select(F.col("embedding").alias("vector"))
    vec = _nearest(c, seed, out, BY_BOOK)
    near = gr.two_hops(_edges(c), WORK).select("work_id", F.lit("graph").alias("source"), F.lit(1).alias("seq"), F.lit(0.5).alias("sim"))
    cf = co.similar_tiered(c.cooccurrence, _pairs(c), WORK, SIMILAR).select(F.col("related_id").alias("work_id"), F.lit("readers").alias("source"), F.lit(1).alias("seq"), (0.3 + 0.5 * F.col("jaccard").cast("double")).alias("sim"))
    lists = co.list_mates(c.list_seed, WORK, MATES).select("work_id", F.lit("lists").alias("source"), F.lit(1).alias("seq"), F.least(F.lit(0.6), 0.2 + 0.05 * F.col("shared_lists")).alias("sim"))
    hits = vec.unionByName(near.unionByName(cf).unionByName(lists).join(out, "work_id", "left_anti"))
    # A graph hit adds 0.15 whatever it would score alone.
    return rc.fuse(hits.join(F.broadcast(seed.select(F.lit(1)).limit(1)), how="left_semi"), rc.BOOSTS_BOOK).orderBy(F.col("score").desc(), "work_id").limit(BY_BOOK)


def _block_filters(c: Catalogue):
    """Works that are left for the reader."""
    rest = rc.without_blocked(c.work.select("work_id", "title"), c.work_author, works=_blocks(c).where("work_id is not null"), authors=_blocks(c))
    return rest.join(_seen(c), "work_id", "left_anti")


def _category(c: Catalogue):
    rows = rc.works_by_subject(c.work, c.work_subject, SUBJECTS, WITHOUT, 1955, 1995, _excluded(c))
    return rc.category_candidates(rows, rd.profile_vector(_own(c), c.work))


def _base(c: Catalogue):
    """R13 for the candidates, written once. Only the candidates' ratings are added up: there are GENERAL of them at most."""

    def build():
        found, own = cut(_general(c), "general"), c.of_reader(USER)
        features = gr.user_features(own.user_event, c.work, c.work_author, c.work_subject, USER)
        mine = rd.aggregate_sessions(own.session, as_of(SESSIONS_AS_OF)).select("work_id", "total_ms", "last30_ms", "last_read_at")
        return rc.base_scores(found, rt.quality(c.of_works(found).rating), features, mine, as_of(SESSIONS_AS_OF))

    return table(c.spark, c.dir, f"scores-{USER}", build)


def _decorated(c: Catalogue, scored):
    authors = c.work_author.groupBy("work_id").agg(F.array_sort(F.collect_set("author_id")).alias("authors"))
    return scored.join(c.work.select("work_id", "title", "series", "embedding"), "work_id").join(authors, "work_id", "left").withColumn("user_id", F.lit(USER))


def _final(c: Catalogue, k: int = 20):
    scored = _base(c)
    return rc.rerank(_decorated(c, scored), k).join(scored, "work_id")


def general_recommendations(c: Catalogue):
    """The flagship: candidates, scores, greedy re-ranking, then titles, authors and reasons of what is on the page only."""
    first = _anchors(c, 1).join(c.work, F.col("anchor") == F.col("work_id")).select(F.col("title").alias("anchor_title"))
    names = c.work_author.join(c.author, "author_id").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("authors"))
    rows = _final(c).join(c.work.select("work_id", "title"), "work_id").join(names, "work_id", "left").join(F.broadcast(first), F.lit(True), "left")
    return rows.select("position", "work_id", "title", "authors", F.round("final_score", 6).alias("final_score"), scoring.grade(F.col("base")).alias("grade"), scoring.quick_reasons(F.col("anchor_title"), F.col("relevance"), F.col("quality")).alias("reasons")).orderBy("position")


def _diverse(c: Catalogue):
    top = _base(c).orderBy(F.col("base").desc(), "work_id").limit(20)
    return rc.diversity(_decorated(c, top))


def _reasons(c: Catalogue):
    first = _anchors(c, 1).join(c.work, F.col("anchor") == F.col("work_id")).select(F.col("title").alias("anchor_title"))
    rows = _base(c).join(F.broadcast(first), F.lit(True), "left")
    return rows.select("work_id", F.array_join(scoring.quick_reasons(F.col("anchor_title"), F.col("relevance"), F.col("quality")), " | ").alias("reasons"))


def _covers(c: Catalogue):
    pick = lambda m, x: F.when(F.col("work_id") % m == 0, x)
    w = F.col("work_id").cast("string")
    return c.work.select("work_id", text.cover_url(pick(2, w), pick(3, F.concat(F.lit("978"), w)), pick(5, w), pick(7, F.concat(F.lit("OL"), w, F.lit("M"))), pick(11, F.col("ol_work_key")), pick(13, F.concat(F.lit("v"), w))).alias("cover_url"))


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        "category_candidates": on(_category),
        "general_candidates": on(_general),
        "by_book_candidates": on(_by_book),
        "block_filters": on(_block_filters),
        "rerank_base_scores": on(_base),
        "mmr_rerank": on(lambda c: _final(c).select("user_id", "position", "work_id", F.round("final_score", 6).alias("final_score"))),
        "diversity_metrics": on(_diverse),
        "quick_reasons": on(_reasons),
        "cover_ladder": on(_covers),
        "general_recommendations": on(general_recommendations),
    }


def oracle_sql() -> dict[str, str]:
    views = WEIGHT_VIEWS + " work work_subject list_seed reading_log rating author block"
    cos = "list_cosine_similarity(w.embedding, p.v)"
    parts = TASTE_SQL | LPA_SQL | QUALITY_SQL | {
        "known": f"select distinct work_id from user_event where user_id = {USER}",
        "mine": f"select * from block where user_id = {USER}",
        "seen": "select work_id from known union select work_id from mine where work_id is not null",
        "profile": f"select list(x order by k) v from unit where user_id = {USER}",
        "anchor": f"select work_id anchor, w weight, row_number() over (order by w desc, work_id) pos from (select work_id, round(weight, 6) w from weighted where user_id = {USER} and weight > 0)",
        "edges": EDGES_SQL,
        "vec": f"select w.work_id, 'vector' src, 0 o, 1 seq, {cos} sim, 0.0::double boost from work w, profile p where p.v is not null and w.embedding is not null and w.work_id not in (select work_id from seen) order by sim desc, w.work_id limit {GENERAL}",
        "near0": f"select distinct e.work_id, anchor, weight, pos from edges m join anchor a on m.work_id = anchor and pos <= {GRAPH_ANCHORS} join edges e on e.node = m.node and e.work_id <> anchor",
        "near": "select work_id, 'graph' src, 1 o, pos seq, 0.5::double * weight sim, 0.2::double boost from near0",
        "cf": f"""select related_id work_id, 'readers' src, 2 o, pos seq, jaccard::double * weight * 0.8::double sim, 0.3::double boost from (select *, row_number() over (partition by work_id
          order by case when overlap >= 2 then 0 else 1 end, jaccard desc, related_id) r from nb where work_id in (select anchor from anchor where pos <= {READER_ANCHORS})) n join anchor a on n.work_id = anchor where r <= {EACH_READERS}""",
        "mates": f"""select node work_id, 'community' src, 3 o, pos seq, 0.3::double * weight sim, 0.15::double boost from (select m.node, pos, weight, row_number() over (partition by anchor order by md5(concat('7:', m.node)), m.node) r
          from anchor a join community o on o.node = anchor join community m on m.label = o.label and m.node <> anchor where pos <= {COMMUNITY_ANCHORS}) where r <= {EACH_COMMUNITY}""",
        "hits": "select * from vec union all select * from (select * from near union all select * from cf union all select * from mates) where work_id not in (select work_id from seen)",
        "firsts": "select *, row_number() over (partition by work_id order by o, seq, sim desc) r from hits",
        "fused": "select work_id, round(case when count(*) = 1 then max(sim) else least(1.0::double, max(sim) filter (r = 1) + coalesce(sum(boost * sim) filter (r > 1), 0)) end, 9) score, max(src) filter (r = 1) source, count(*) hits from firsts group by 1",
        "general": f"select * from fused where work_id not in (select work_id from work_author where author_id in (select author_id from mine where author_id is not null)) order by score desc, work_id limit {GENERAL}",
    }
    features = {
        "own": f"select * from user_event where user_id = {USER}",
        "readw": "select distinct work_id, rating from own where shelf = 'read'",
        "liked": "select distinct work_id from readw where rating is null or rating >= 4",
        "fa": "select distinct author_id from work_author where work_id in (select work_id from liked)",
        "fs": "select distinct subject from work_subject where work_id in (select work_id from liked)",
        "aff": "select work_id, count(f.author_id) / count(*) a from work_author w left join fa f on w.author_id = f.author_id group by 1",
        "ovl": "select work_id, count(f.subject) / (count(*) + (select count(*) from fs) - count(f.subject)) o from work_subject w left join fs f on w.subject = f.subject group by 1",
        "pieces": f"""select g.work_id, g.score::decimal(6,4)::double relevance, q.blended_avg::decimal(4,3)::double ba, q.wilson::decimal(4,3)::double wi, q.total_ratings n,
          ((coalesce(a, 0) + coalesce(o, 0)) / 2)::decimal(5,4)::double graph, t.total_ms, t.last30_ms, date_diff('day', t.last_read_at, timestamp '{SESSIONS_AS_OF}') age
          from general g left join quality q on g.work_id = q.work_id left join aff on g.work_id = aff.work_id left join ovl on g.work_id = ovl.work_id left join totals t on g.work_id = t.work_id and t.user_id = {USER}""",
        "each": """select work_id, relevance, graph, case when ba is null or n is null then 0.5::double else ((ba - 1) / 4 * 0.6::double + wi * 0.4::double) * (0.5::double + 0.5::double * least(1.0::double, log10(n + 1.0::double) / 4)) end q,
          case when total_ms is null then 0.0::double else least(1.0::double, least(1.0::double, log10(total_ms / 3600000.0::double + 1) / 2) + (case when last30_ms > 0 then 0.1::double else 0 end) + 0.2::double * greatest(0.0::double, 1 - age / 90.0::double)) end e from pieces""",
        "based": "select work_id, round(relevance, 6) relevance, round(q, 6) quality, round(graph, 6) graph, round(e, 6) engagement, round(relevance * 0.4::double + q * 0.25::double + graph * 0.2::double + e * 0.1::double, 6) base from each",
    }
    both = parts | features
    title = "(select title from work join anchor on work_id = anchor where pos = 1)"
    rd_sql = PAIRS_SQL | {
        "readers": f"select distinct user_id from reading_log where work_id = {WORK}",
        "shared": f"select work_id, count(distinct user_id) n from reading_log where work_id <> {WORK} and user_id in (select user_id from readers) group by 1",
        "edges": EDGES_SQL,
        "seen": parts["known"] + f" union select work_id from block where user_id = {USER} and work_id is not null union select {WORK}",
        "profile": f"select embedding v from work where work_id = {WORK} and embedding is not null",
        "vec": f"select w.work_id, 'vector' src, 0 o, 1 seq, {cos} sim, 0.0::double boost from work w, profile p where w.embedding is not null and w.work_id not in (select work_id from seen) order by sim desc, w.work_id limit {BY_BOOK}",
        "near": f"select distinct work_id, 'graph', 1, 1, 0.5::double, 0.3::double from edges where work_id <> {WORK} and node in (select node from edges where work_id = {WORK})",
        "live": f"select work_id related_id, n overlap, round(n / ((select count(*) from readers) + (select count(distinct user_id) from reading_log z where z.work_id = s.work_id) - n), 6)::decimal(6,5) jaccard from shared s where n >= 3",
        "tiers": f"""select *, 1 tier from (select related_id, overlap, jaccard from nb where work_id = {WORK} and overlap >= 2 order by jaccard desc, related_id limit {SIMILAR})
          union all select *, 2 from (select related_id, overlap, jaccard from nb where work_id = {WORK} order by jaccard desc, related_id limit {SIMILAR}) union all select *, 3 from (select * from live order by jaccard desc, related_id limit {SIMILAR})""",
        "cf": "select related_id work_id, 'readers', 2, 1, 0.3::double + 0.5::double * jaccard::double, 0.4::double from tiers where tier = (select min(tier) from tiers)",
        "mates": f"select work_id, 'lists', 3, 1, least(0.6::double, 0.2::double + 0.05::double * n), 0.2::double from (select work_id, count(*) n from list_seed where work_id <> {WORK} and list_id in (select list_id from list_seed where work_id = {WORK}) group by 1 order by 2 desc, 1 limit {MATES})",
        "hits": "select * from vec union all select * from (select * from near union all select * from cf union all select * from mates) where work_id not in (select work_id from seen) and exists (select 1 from profile)",
        "firsts": parts["firsts"],
        "fused": parts["fused"],
    }
    inc, exc = (", ".join(f"'{x}'" for x in xs) for xs in (SUBJECTS, WITHOUT))
    top20 = "(select work_id from based order by base desc, work_id limit 20)"
    return {
        "category_candidates": sql(f"select w.work_id, round(list_dot_product(w.embedding, p.v), 6) score from work w, profile p where p.v is not null and w.embedding is not null and first_publish_year between 1955 and 1995 and w.work_id in (select work_id from work_subject where subject in ({inc})) and w.work_id not in (select work_id from work_subject where subject in ({exc})) and w.work_id not in (select work_id from seen) order by 2 desc, 1 limit 100", views, **{k: v for k, v in parts.items() if k in TASTE_SQL or k in ("known", "mine", "seen", "profile")}),
        "general_candidates": sql("select * from general", views, **parts),
        "by_book_candidates": sql("select * from fused order by score desc, work_id limit 500", "work reading_log list_seed work_author work_subject user_event block", **rd_sql),
        "block_filters": sql("select work_id, title from work where work_id not in (select work_id from seen) and work_id not in (select work_id from work_author where author_id in (select author_id from mine where author_id is not null))", "work work_author user_event block", **{k: parts[k] for k in ("known", "mine", "seen")}),
        "rerank_base_scores": sql("select * from based", views, **both),
        "diversity_metrics": sql(
            f"""select round(coalesce((select avg(1 - list_cosine_similarity(a.embedding, b.embedding)) from work a join work b on a.work_id < b.work_id where a.embedding is not null and b.embedding is not null and a.work_id in {top20} and b.work_id in {top20}), 1.0), 6) ild,
            count(distinct author_id) unique_authors, round(case when count(*) > 0 then 1 - count(distinct author_id) / count(*) else 0.0 end, 6) repeat_rate from work_author where work_id in {top20}""",
            views, **both,
        ),
        "quick_reasons": sql(f"""select work_id, case when {title} is null and relevance <= 0.8 and quality <= 0.7 then '{scoring.REASON_OTHER}' else concat_ws(' | ', '{scoring.REASON_ANCHOR[0]}' || {title} || '{scoring.REASON_ANCHOR[1]}', case when relevance > 0.8 then '{scoring.REASON_MATCH}' when quality > 0.7 then '{scoring.REASON_RATED}' end) end reasons from based""", views, **both),
        "cover_ladder": sql("""select work_id, case when work_id % 2 = 0 then concat('https://covers.openlibrary.org/b/id/', work_id, '-M.jpg') when work_id % 3 = 0 then concat('https://covers.openlibrary.org/b/isbn/978', work_id, '-M.jpg')
          when work_id % 5 = 0 then concat('https://covers.openlibrary.org/b/isbn/', work_id, '-M.jpg') when work_id % 7 = 0 then concat('https://covers.openlibrary.org/b/olid/OL', work_id, 'M-M.jpg')
          when work_id % 11 = 0 then concat('https://covers.openlibrary.org/w/olid/', ol_work_key, '-M.jpg') when work_id % 13 = 0 then concat('https://books.google.com/books/content?id=v', work_id, '&printsec=frontcover&img=1&zoom=1') end cover_url from work""", "work"),
    }
