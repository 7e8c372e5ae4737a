"""The domain tables as views over the driver's star schema: parts are works, suppliers authors, customers readers, orders
lists, events reading sessions. Each view has its DataFrame and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import collaborative, graph
from quillon.operators.lineage import cut, shuffled, small, table

#: The order of "latest line": total over the fixture's rows.
LATEST = ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
STATUS = {"A": "already-read", "N": "currently-reading"}
SESSIONS_AS_OF = "2024-01-31 00:00:00"
EVENTS_AS_OF = "2001-08-02 00:00:00"


class Catalogue:
    """Views of one folder; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.dir, self.keep = spark, sf_dir, keep or {}

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.keep[name](rows) if name in self.keep else rows

    def of_reader(self, user_id: int) -> Catalogue:
        """The same views over one reader's orders and events: lines meet a broadcast table and are not shuffled."""
        own = small(cut(self.table("orders").where(F.col("o_custkey") == user_id), "own-orders"))
        return Catalogue(self.spark, self.dir, self.keep | {"orders": lambda _: own, "events": lambda rows: rows.where(F.col("user_id") == user_id)})

    def of_works(self, ids: DataFrame) -> Catalogue:
        """The same views over the lines of some works (work_id), few enough to be broadcast."""
        wanted = F.broadcast(ids.select(F.col("work_id").alias("l_partkey")).distinct())
        return Catalogue(self.spark, self.dir, self.keep | {"lineitem": lambda rows: rows.join(wanted, "l_partkey", "left_semi")})

    @cached_property
    def work(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", "embedding")
        p = self.table("part")
        return p.join(e, F.col("p_partkey") == F.col("vec_id"), "left").select(
            F.col("p_partkey").alias("work_id"),
            F.concat(F.lit("OL"), F.col("p_partkey").cast("string"), F.lit("W")).alias("ol_work_key"),
            F.col("p_name").alias("title"),
            (1950 + F.col("p_size")).alias("first_publish_year"),
            F.col("p_brand").alias("series"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )

    @cached_property
    def author(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))

    @cached_property
    def work_author(self) -> DataFrame:
        rows = self.table("lineitem").where("l_linenumber = 1 and l_quantity = 50")
        return rows.select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("author_id")).distinct()

    @cached_property
    def work_subject(self) -> DataFrame:
        words = F.concat(F.array(F.lower("p_type")), F.split("p_name", " "))
        return self.table("part").select(F.col("p_partkey").alias("work_id"), F.explode(words).alias("subject")).distinct()

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def reading_log(self) -> DataFrame:
        status = F.when(F.col("l_returnflag") == "A", STATUS["A"]).when(F.col("l_returnflag") == "N", STATUS["N"]).otherwise("want-to-read")
        return self._lines.select(F.col("l_partkey").alias("work_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("logged_at"))

    @cached_property
    def list_seed(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("work_id")).distinct()

    @cached_property
    def _latest(self) -> DataFrame:
        last = F.max(F.struct(*LATEST, "o_orderstatus")).alias("x")
        return self._lines.groupBy(F.col("l_partkey").alias("work_id"), F.col("o_custkey").alias("user_id")).agg(last).select("work_id", "user_id", "x.*")

    @cached_property
    def ol_rating(self) -> DataFrame:
        return self._latest.select("work_id", "user_id", F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"))

    @cached_property
    def rating(self) -> DataFrame:
        ol = self.ol_rating.groupBy("work_id").agg(F.avg("rating").alias("avg"), F.count("*").alias("n")).withColumn("source", F.lit("openlibrary"))
        gb = self.table("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("work_id"))
        gb = gb.agg(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.avg(F.col("l_discount") * 50))).alias("avg"), F.count("*").alias("n")).withColumn("source", F.lit("googlebooks"))
        return ol.unionByName(gb)

    @staticmethod
    def _as_events(latest: DataFrame) -> DataFrame:
        shelf = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "to-read").when(F.col("l_linestatus") == "F", "dnf").otherwise("currently-reading")
        rating = F.when(F.col("l_returnflag") != "N", F.ceil(F.col("l_quantity") / 10).cast("int"))
        return latest.select("user_id", "work_id", shelf.alias("shelf"), rating.alias("rating"), F.col("o_orderdate").alias("finished_at"), F.lit("library").alias("source"), *[c for c in latest.columns if c == "l_orderkey"])

    @cached_property
    def user_event(self) -> DataFrame:
        return self._as_events(self._latest).drop("l_orderkey")

    def _all_events(self) -> DataFrame:
        """user_event for all readers: an order's lines of a work are cut to the last one where the join has brought them, so the
        rows that are shuffled by reader have a day, an order, a shelf and a rating, not all that LATEST names."""
        lines = self.table("lineitem").join(shuffled(self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")), F.col("l_orderkey") == F.col("o_orderkey"))
        keys = [F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("work_id"), "o_orderdate", "l_orderkey"]
        one = lines.groupBy(*keys).agg(F.max(F.struct(*LATEST[2:], "o_orderstatus")).alias("x")).select("user_id", "work_id", "o_orderdate", "l_orderkey", "x.*")
        last = F.max(F.struct("finished_at", "l_orderkey", "shelf", "rating", "source")).alias("x")
        rows = self._as_events(one).repartition("user_id").groupBy("user_id", "work_id").agg(last)
        return rows.select("user_id", "work_id", "x.shelf", "x.rating", "x.finished_at", "x.source")

    @cached_property
    def kept_events(self) -> DataFrame:
        """user_event of all readers, written once for an application: what looks at it several times reads it from there."""
        return table(self.spark, self.dir, "user-events", self._all_events)

    @cached_property
    def edition(self) -> DataFrame:
        asin = F.concat(F.lit("B"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        return self.table("lineitem").select(asin.alias("asin"), F.col("l_partkey").alias("work_id"), (F.floor("l_extendedprice").cast("int") % 900).alias("page_count"))

    @cached_property
    def session(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").where("event_type <> 'error'").select("user_id", k.alias("work_id"), F.col("ts").alias("start_at"), F.round(F.col("value") * 60000).cast("long").alias("duration_ms"))

    @cached_property
    def reading_day(self) -> DataFrame:
        return self.table("events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()

    def _of(self, kind: str) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").where(F.col("event_type") == kind).select("user_id", k.alias("work_id"), F.col("ts").alias("at"))

    @cached_property
    def completion(self) -> DataFrame:
        return self._of("purchase")

    @cached_property
    def ownership(self) -> DataFrame:
        return self._of("signup")

    @cached_property
    def block(self) -> DataFrame:
        """Works and authors that a reader doesn't want to see: a row has one of the two."""
        k = F.get_json_object("props", "$.k").cast("long")
        even = F.col("event_id") % 2 == 0
        return self.table("events").where("event_type = 'error'").select("user_id", F.when(even, k).alias("work_id"), F.when(~even, k).alias("author_id"))

    @cached_property
    def cooccurrence(self) -> DataFrame:
        """The table that a batch job builds from lists and authors; written once for an application."""
        return table(self.spark, self.dir, "cooccurrence", lambda: collaborative.cooccurrence(self.list_seed, self.work_author))

    @cached_property
    def label(self) -> DataFrame:
        """node, label of the graph of co-occurrences; written once for an application."""
        return table(self.spark, self.dir, "label", lambda: graph.label_propagation(graph.strong_edges(self.cooccurrence)))

    @cached_property
    def community(self) -> DataFrame:
        """node, label, size of the communities."""
        return graph.communities(self.label)

    @cached_property
    def redirect(self) -> DataFrame:
        return self.table("part").where("p_partkey > 0 and p_partkey % 2 = 0").select(F.col("p_partkey").alias("old_key"), F.expr("p_partkey div 2").alias("new_key"))


def as_of(text: str) -> Column:
    return F.lit(text).cast("timestamp")


_LATEST_SQL = """select * from (select l.*, o_custkey, o_orderstatus, o_orderdate, row_number() over (partition by l_partkey, o_custkey
 order by o_orderdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_returnflag desc, l_linestatus desc) rn
 from lineitem l join orders o on l_orderkey = o_orderkey) where rn = 1"""

#: The same views in DuckDB's SQL, in an order in which each uses those before it.
VIEWS_SQL = {
    "work": "select p_partkey work_id, concat('OL', p_partkey, 'W') ol_work_key, p_name title, 1950 + p_size first_publish_year, p_brand series, embedding::double[] embedding from part left join embeddings on vec_id = p_partkey",
    "author": "select s_suppkey author_id, s_name name from supplier",
    "work_author": "select distinct l_partkey work_id, l_suppkey author_id from lineitem where l_linenumber = 1 and l_quantity = 50",
    "work_subject": "select distinct work_id, subject from (select p_partkey work_id, lower(p_type) subject from part union all select p_partkey, unnest(string_split(p_name, ' ')) from part)",
    "reading_log": "select l_partkey work_id, o_custkey user_id, case l_returnflag when 'A' then 'already-read' when 'N' then 'currently-reading' else 'want-to-read' end status, o_orderdate logged_at from lineitem join orders on l_orderkey = o_orderkey",
    "list_seed": "select distinct l_orderkey list_id, l_partkey work_id from lineitem",
    "latest": _LATEST_SQL,
    "ol_rating": "select l_partkey work_id, o_custkey user_id, ceil(l_quantity / 10)::int rating from latest",
    "rating": "select work_id, avg(rating) avg, count(*) n, 'openlibrary' source from ol_rating group by 1 union all select l_partkey, least(5.0, greatest(1.0, avg(l_discount * 50))), count(*), 'googlebooks' from lineitem where l_returnflag = 'R' group by 1",
    "user_event": "select o_custkey user_id, l_partkey work_id, case when o_orderstatus = 'F' then 'read' when o_orderstatus = 'O' then 'to-read' when l_linestatus = 'F' then 'dnf' else 'currently-reading' end shelf, case when l_returnflag <> 'N' then ceil(l_quantity / 10)::int end rating, o_orderdate finished_at, 'library' source from latest",
    "edition": "select concat('B', l_orderkey, '-', l_linenumber) asin, l_partkey work_id, floor(l_extendedprice)::int % 900 page_count from lineitem",
    "session": "select user_id, json_extract_string(props, '$.k')::bigint work_id, ts start_at, round(value * 60000)::bigint duration_ms from events where event_type <> 'error'",
    "reading_day": "select distinct user_id, ts::date as day from events",
    "completion": "select user_id, json_extract_string(props, '$.k')::bigint work_id, ts as at from events where event_type = 'purchase'",
    "ownership": "select user_id, json_extract_string(props, '$.k')::bigint work_id, ts as at from events where event_type = 'signup'",
    "block": "select user_id, case when event_id % 2 = 0 then k end work_id, case when event_id % 2 <> 0 then k end author_id from (select *, json_extract_string(props, '$.k')::bigint k from events where event_type = 'error')",
    "redirect": "select p_partkey old_key, p_partkey // 2 new_key from part where p_partkey > 0 and p_partkey % 2 = 0",
}


def sql(query: str, names: str, recursive: bool = False, **more: str) -> str:
    """query after the named views (and those they use) and more common tables of its own."""
    wanted = set(names.split())
    if wanted & {"ol_rating", "rating", "user_event"}:
        wanted.add("latest")
    if "rating" in wanted:
        wanted.add("ol_rating")
    parts = [f"{k} as ({v})" for k, v in VIEWS_SQL.items() if k in wanted] + [f"{k} as ({v})" for k, v in more.items()]
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" + query
