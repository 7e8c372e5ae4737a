"""Queries over tables that are kept and changed: derived pairs kept up to date, caches, events of several sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import reading as rd
from quillon.operators import refresh as rf
from quillon.operators.lineage import shared_folder
from quillon.plans.ratings import CO_VIEWS, PAIRS_SQL
from quillon.plans.reading import TOTALS_SQL, WEIGHT_SQL, WEIGHT_VIEWS, totals
from quillon.sources.fixtures import EVENTS_AS_OF, Catalogue, as_of, sql
from quillon.sources.versions import Cache, Store


def new_folder(c: Catalogue, name: str) -> str:
    return f"{shared_folder(c.spark)}/quillon/{name}-{uuid.uuid4().hex}"


def _refreshed(c: Catalogue):
    """Pairs of six sevenths of the lists, with works that the lists don't have; then the changes to the lists as they are."""
    now = c.list_seed
    before = now.where("list_id % 7 <> 3").unionByName(now.where("list_id % 5 = 1").select("list_id", (F.col("work_id") + 1).alias("work_id"))).distinct()
    store = Store(c.spark, new_folder(c, "pairs"), rf.PAIR_TABLES)
    rf.refresh_pairs(store, before)
    rf.refresh_pairs(store, now)
    return rf.stored_pairs(store).withColumn("jaccard", F.col("jaccard").cast("double"))


def _cached(c: Catalogue):
    """A cache through its life: results written, later ones put over them, readers' results voided, expired ones deleted,
    and read."""
    e = c.table("events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("work_id"), "event_type", "value", "ts", (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"), "event_id")
    last = Window.partitionBy("user_id", "work_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    batch = lambda rows: rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("user_id", "work_id", "event_type", "value", "expires_at")
    cache = Cache(c.spark, new_folder(c, "cache"), "user_id long, work_id long, event_type string, value double, expires_at timestamp", ["user_id", "work_id", "event_type"])
    cache.write(batch(e.where("ts < timestamp '2024-01-15 00:00:00'")))
    cache.write(batch(e.where("ts >= timestamp '2024-01-12 00:00:00' and ts < timestamp '2024-01-25 00:00:00'")))
    cache.invalidate(e.where("user_id % 10 = 3").select("user_id").distinct())
    cache.delete_expired(as_of("2024-01-20 00:00:00"))
    return cache.read(as_of("2024-01-22 00:00:00"))


def _two_sources(c: Catalogue):
    """Events of two sources; the second has a third of the works again, on the same shelf, another one, or none."""
    k = F.col("user_id") + F.col("work_id")
    again = c.user_event.where(k % 3 == 0)
    shelf = F.when(k % 7 == 0, None).when(k % 2 == 0, F.col("shelf")).otherwise("to-read")
    return c.user_event.unionByName(again.withColumns({"source": F.lit("device"), "shelf": shelf, "finished_at": F.col("finished_at") + F.expr("interval 1 day")}))


TWO_SQL = "select * from user_event union all select user_id, work_id, case when (user_id + work_id) % 7 = 0 then null when (user_id + work_id) % 2 = 0 then shelf else 'to-read' end, rating, finished_at + interval 1 day, 'device' from user_event where (user_id + work_id) % 3 = 0"
FAN_SQL = {
    "two": TWO_SQL,
    "prev": "select *, date_diff('day', lag(finished_at) over (partition by user_id order by finished_at nulls last, work_id, source), finished_at) gap from two",
    "fan": "select p.* from two e join prev p on e.user_id = p.user_id and e.work_id = p.work_id and e.shelf = p.shelf",
}


def _weights(c: Catalogue):
    rows = rd.weighted_events(_two_sources(c), totals(c), c.completion, c.ownership, c.work_author, as_of(EVENTS_AS_OF))
    return rows.select("user_id", "work_id", "shelf", "source", F.round("weight", 6).alias("weight"))


def queries() -> dict:
    on = lambda f: lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    return {
        "cooccurrence_refresh": on(_refreshed),
        "cache_life_cycle": on(_cached),
        "profile_event_rows": on(lambda c: rd.fan_out(_two_sources(c)).select("user_id", "work_id", "shelf", "rating", "finished_at", "source", "days_since_previous")),
        "profile_event_weights_sources": on(_weights),
    }


def oracle_sql() -> dict[str, str]:
    batch = "select * from (select *, row_number() over (partition by user_id, work_id, event_type order by ts desc, event_id desc) r from e where {0}) where r = 1"
    of_two = {k: WEIGHT_SQL[k] for k in ("totals", "done", "owned")} | {
        "by_author": "select user_id, e.work_id, author_id from two e join work_author a on e.work_id = a.work_id",
        "loyalty": WEIGHT_SQL["loyalty"],
        "ev": "select * from fan",
        **{k: WEIGHT_SQL[k] for k in ("joined", "parts", "weighted")},
    }
    return {
        "cooccurrence_refresh": sql("select a, b, overlap, jaccard::double jaccard from list_pairs", CO_VIEWS, **PAIRS_SQL),
        "cache_life_cycle": sql(
            "select user_id, work_id, event_type, value, expires_at from (select * from b2 union all select * from b1 where (user_id, work_id, event_type) not in (select user_id, work_id, event_type from b2)) where user_id % 10 <> 3 and expires_at > timestamp '2024-01-22 00:00:00'", "",
            e="select user_id, json_extract_string(props, '$.k')::bigint work_id, event_type, value, ts, event_id, ts + interval 7 days expires_at from events",
            b1=batch.format("ts < timestamp '2024-01-15 00:00:00'"), b2=batch.format("ts >= timestamp '2024-01-12 00:00:00' and ts < timestamp '2024-01-25 00:00:00'"),
        ),
        "profile_event_rows": sql("select user_id, work_id, shelf, rating, finished_at, source, gap::int days_since_previous from fan", "user_event", **FAN_SQL),
        "profile_event_weights_sources": sql("select user_id, work_id, shelf, source, round(weight, 6) weight from weighted", WEIGHT_VIEWS, **FAN_SQL, **of_two),
    }
