"""Queries over popularity, ratings, vectors and co-reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors
from quillon.operators import collaborative as co
from quillon.operators import ratings as rt
from quillon.sources.fixtures import Catalogue, sql

WORK = 7
QUALITY_SQL = {
    "sums": "select work_id, sum(w * avg) s, sum(w) w, sum(n)::bigint n from (select *, (case source when 'openlibrary' then 1.2::double else 1.0::double end) * n w from rating) group by 1",
    "q": "select work_id, (35.0::double + s / w * n) / (n + 10.0::double) blended_avg, n total_ratings, greatest(0.0::double, least(1.0::double, (s / w - 1) / 4)) p from sums",
    "quality": "select work_id, blended_avg, total_ratings, (p + 3.8416::double / (2 * n) - 1.96::double * sqrt((p * (1 - p) + 3.8416::double / (4 * n)) / n)) / (1 + 3.8416::double / n) wilson from (select *, total_ratings::double n from q)",
    "scored": "select work_id, blended_avg, total_ratings, wilson, round(((blended_avg - 1) / 4 * 0.6::double + wilson * 0.4::double) * (0.5::double + 0.5::double * least(1.0::double, log10(total_ratings + 1.0::double) / 4)), 6) quality_score from quality",
}
POPULARITY_SQL = "select work_id, count(*) filter (status = 'already-read') read_count, count(*) filter (status = 'currently-reading') reading_count, count(*) filter (status = 'want-to-read') want_count, count(distinct user_id) unique_users, count(*) total_logs from reading_log group by 1"
PAIRS_SQL = {
    "sizes": "select work_id, count(*) n from list_seed group by 1 having count(*) >= 2",
    "lp": "select x.work_id a, y.work_id b, count(*) overlap from list_seed x join list_seed y on x.list_id = y.list_id and x.work_id < y.work_id where x.work_id in (select work_id from sizes) and y.work_id in (select work_id from sizes) group by 1, 2 having count(*) >= 2",
    "list_pairs": "select a, b, overlap, (overlap / (p.n + q.n - overlap))::decimal(6,5) jaccard from lp join sizes p on p.work_id = a join sizes q on q.work_id = b",
    "wsize": "select work_id, count(*) n from work_author group by 1",
    "prolific": "select author_id from work_author group by 1 having count(*) between 2 and 100",
    "ap": "select x.work_id a, y.work_id b, count(*) overlap from work_author x join work_author y on x.author_id = y.author_id and x.work_id < y.work_id where x.author_id in (select author_id from prolific) group by 1, 2",
    "author_pairs": "select a, b, overlap, least(1.0, overlap * 5.0 / greatest(p.n, q.n))::decimal(6,5) jaccard from ap join wsize p on p.work_id = a join wsize q on q.work_id = b",
    "tagged": "select a, b, overlap, jaccard, 0 kind from list_pairs union all select b, a, overlap, jaccard, 0 from list_pairs union all select a, b, overlap, jaccard, 1 from author_pairs union all select b, a, overlap, jaccard, 2 from author_pairs",
    "merged": "select a, b, coalesce(max(overlap) filter (kind < 2), max(overlap)) overlap, coalesce(max(jaccard) filter (kind < 2), max(jaccard)) jaccard from tagged group by 1, 2",
    "cooc": "select a, b, overlap, jaccard from (select *, row_number() over (partition by a order by jaccard desc, overlap desc, b) r from merged) where r <= 100",
    "nb": "select a work_id, b related_id, overlap, jaccard from cooc union all select b, a, overlap, jaccard from cooc",
}
COSINE_SQL = "list_cosine_similarity(x.embedding, y.embedding)"
CO_VIEWS = "list_seed work_author"


def _co(c: Catalogue):
    return co.cooccurrence(c.list_seed, c.work_author)


def _as_double(rows):
    return rows.withColumn("jaccard", F.col("jaccard").cast("double"))


def _knn(c: Catalogue, seed: int, k: int, seen: bool):
    """The seed's vector is one row, held on the driver; with seen, works that reader 1 knows are left out."""
    row = c.work.where(F.col("work_id") == seed).select("embedding").first()
    rows = c.work.where(F.col("work_id") != seed)
    if seen:
        rows = rows.join(c.user_event.where("user_id = 1").select("work_id").distinct(), "work_id", "left_anti")
    if row is None or row[0] is None:
        return rows.limit(0).select("work_id", F.lit(0.0).alias("similarity"))
    found = vectors.knn(rows, F.array(*[F.lit(float(x)) for x in row[0]]), k)
    return found.select("work_id", F.round("sim", 6).alias("similarity"))


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        "work_popularity": on(lambda c: rt.popularity(c.reading_log)),
        "work_rating_histogram": on(lambda c: rt.rating_histogram(c.ol_rating).withColumn("avg_rating", F.col("avg_rating").cast("double"))),
        "popularity_score": on(lambda c: rt.popularity_scores(c.reading_log)),
        "trending_works": on(lambda c: rt.trending(c.reading_log)),
        "work_quality": on(lambda c: rt.quality(c.rating).select("work_id", F.round("blended_avg", 6).alias("blended_avg"), F.round("wilson", 6).alias("wilson"), "total_ratings")),
        "quality_score_grades": on(lambda c: rt.graded(rt.quality(c.rating))),
        "page_median": on(lambda c: rt.page_medians(c.edition)),
        "embedding_eligibility": on(lambda c: rt.embedding_queue(c.work.withColumn("description", F.when(F.col("work_id") % 3 == 0, F.col("title"))), c.reading_log, c.ol_rating)),
        "knn_from_vector": on(lambda c: _knn(c, WORK, 50, True)),
        "knn_from_seed": on(lambda c: _knn(c, WORK, 20, False)),
        "also_read": on(lambda c: co.also_read(c.reading_log, WORK)),
        "also_read_jaccard": on(lambda c: co.also_read_jaccard(c.reading_log, WORK)),
        "list_mates": on(lambda c: co.list_mates(c.list_seed, WORK)),
        "cooccurrence_lists": on(lambda c: _as_double(co.list_pairs(c.list_seed))),
        "cooccurrence_authors": on(lambda c: _as_double(co.author_pairs(c.work_author))),
        "cooccurrence_full": on(lambda c: _as_double(_co(c))),
        "similar_works": on(lambda c: _as_double(co.similar_works(c.cooccurrence, WORK))),
        "similar_works_batch": on(lambda c: _as_double(co.similar_works_batch(c.cooccurrence, c.work.where("work_id % 20 = 0").select("work_id"))).drop("_rank")),
        "similar_works_tiered": on(lambda c: _as_double(co.similar_tiered(c.cooccurrence, c.reading_log, WORK))),
    }


def oracle_sql() -> dict[str, str]:
    knn = f"select x.work_id, {COSINE_SQL} s from work x, (select embedding from work where work_id = {WORK}) y where x.embedding is not null and x.work_id <> {WORK}"
    readers = f"select distinct user_id from reading_log where work_id = {WORK}"
    shared = f"select work_id, count(distinct user_id) n from reading_log where work_id <> {WORK} and user_id in (select user_id from readers) group by 1"
    jac = "select s.work_id, s.n overlap, round(s.n / ((select count(*) from readers) + z.n - s.n), 6) jaccard from shared s join (select work_id, count(distinct user_id) n from reading_log group by 1) z on s.work_id = z.work_id"
    one = f"select related_id, overlap, jaccard from nb where work_id = {WORK}"
    return {
        "work_popularity": sql(POPULARITY_SQL, "reading_log"),
        "work_rating_histogram": sql("select work_id, count(*) n_ratings, (sum(rating)::decimal(18,0) / count(*))::decimal(4,2)::double avg_rating, " + ", ".join(f"count(*) filter (rating = {k}) stars_{k}" for k in range(1, 6)) + " from ol_rating group by 1", "ol_rating"),
        "popularity_score": sql(f"select work_id, round(10 * log10(read_count + 0.8::double * reading_count + 0.3::double * want_count + 1), 6) popularity from ({POPULARITY_SQL})", "reading_log"),
        "trending_works": sql(f"select work_id, round(read_count + 0.5::double * reading_count + 0.2::double * want_count, 6) trend from ({POPULARITY_SQL}) order by 2 desc, 1 limit 50", "reading_log"),
        "work_quality": sql("select work_id, round(blended_avg, 6) blended_avg, round(wilson, 6) wilson, total_ratings from quality", "rating", **QUALITY_SQL),
        "quality_score_grades": sql(
            """select work_id, quality_score, case when quality_score >= 0.85 then 'A+' when quality_score >= 0.75 then 'A' when quality_score >= 0.65 then 'A-' when quality_score >= 0.55 then 'B+' when quality_score >= 0.45 then 'B' else 'B-' end grade,
            case when total_ratings < 5 then 'B-' when a >= 4.5 and total_ratings >= 100 then 'A+' when a >= 4.2 then 'A' when a >= 4.0 then 'A-' when a >= 3.7 then 'B+' when a >= 3.4 then 'B' else 'B-' end browse_grade,
            round(least(0.95::double, 0.6::double + 0.1::double * log10(total_ratings::double)), 6) confidence from (select *, round(blended_avg, 6) a from scored)""",
            "rating",
            **QUALITY_SQL,
        ),
        "page_median": sql("select work_id, round_even(quantile_cont(page_count, 0.5), 0)::int page_count_median from edition group by 1", "edition"),
        "embedding_eligibility": sql(
            "select work_id, title, work_id % 3 = 0 has_description, coalesce(readers, 0)::bigint readers, coalesce(n_ratings, 0)::bigint n_ratings from work join (select coalesce(a.work_id, b.work_id) work_id, readers, n_ratings from (select work_id, count(distinct user_id) readers from reading_log group by 1) a full join (select work_id, count(*) n_ratings from ol_rating group by 1) b on a.work_id = b.work_id) using (work_id) where embedding is null and (coalesce(readers, 0) >= 2 or coalesce(n_ratings, 0) >= 1) order by 4 desc, 3 desc, 5 desc, 1 limit 100",
            "work reading_log ol_rating",
        ),
        "knn_from_vector": sql(f"select work_id, round(s, 6) similarity from ({knn}) where work_id not in (select work_id from user_event where user_id = 1) order by s desc, 1 limit 50", "work user_event"),
        "knn_from_seed": sql(f"select work_id, round(s, 6) similarity from ({knn}) order by s desc, 1 limit 20", "work"),
        "also_read": sql("select work_id, n co_readers from shared where n >= 2 order by 2 desc, 1 limit 20", "reading_log", readers=readers, shared=shared),
        "also_read_jaccard": sql(f"select * from ({jac}) where overlap >= 2 order by jaccard desc, work_id limit 20", "reading_log", readers=readers, shared=shared),
        "list_mates": sql(f"select work_id, count(*) shared_lists from list_seed where work_id <> {WORK} and list_id in (select list_id from list_seed where work_id = {WORK}) group by 1 order by 2 desc, 1 limit 20", "list_seed"),
        "cooccurrence_lists": sql("select a, b, overlap, jaccard::double jaccard from list_pairs", CO_VIEWS, **PAIRS_SQL),
        "cooccurrence_authors": sql("select a, b, overlap, jaccard::double jaccard from author_pairs", CO_VIEWS, **PAIRS_SQL),
        "cooccurrence_full": sql("select a, b, overlap, jaccard::double jaccard from cooc", CO_VIEWS, **PAIRS_SQL),
        "similar_works": sql(f"select related_id, overlap, jaccard::double jaccard from ({one}) order by 3 desc, 1 limit 20", CO_VIEWS, **PAIRS_SQL),
        "similar_works_batch": sql("select work_id, related_id, overlap, jaccard::double jaccard from (select *, row_number() over (partition by work_id order by case when overlap >= 2 then 0 else 1 end, jaccard desc, related_id) r from nb where work_id % 20 = 0 and work_id in (select work_id from work)) where r <= 5", "work " + CO_VIEWS, **PAIRS_SQL),
        "similar_works_tiered": sql(
            f"""select related_id, overlap, jaccard::double jaccard, tier from (select *, min(tier) over () best from (
            select *, 1 tier from ({one} and overlap >= 2 order by jaccard desc, related_id limit 20) union all select *, 2 from ({one} order by jaccard desc, related_id limit 20)
            union all select work_id, overlap, jaccard::decimal(6,5), 3 from (select * from ({jac}) where overlap >= 3 order by jaccard desc, work_id limit 20))) where tier = best""",
            "reading_log " + CO_VIEWS, readers=readers, shared=shared, **PAIRS_SQL,
        ),
    }
