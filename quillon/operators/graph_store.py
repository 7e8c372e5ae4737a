"""A stored typed graph with size caps (G1): edges from works to authors, subjects and series, bucketed for hops in both
directions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.collaborative import keep_top


def typed_edges(work_author: DataFrame, work_subject: DataFrame, works: DataFrame) -> DataFrame:
    """work_id, kind, node of the three kinds of edges; works without a series have none of that kind."""
    named = lambda rows, kind, node: rows.select("work_id", F.lit(kind).alias("kind"), F.col(node).cast("string").alias("node"))
    return named(work_author, "author", "author_id").unionByName(named(work_subject, "subject", "subject")).unionByName(named(works.where("series is not null"), "series", "series"))


def capped(edges: DataFrame, per_node: int, per_work: int, seed: int = 7) -> DataFrame:
    """At most per_node works of each node, then at most per_work nodes of each work: a seeded sample by a hash of the edge, the
    same at every run and on any partitions. Ranks are cut before the shuffle too, so a node of a third of all works sends
    per_node rows from each task."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), "kind", "node", F.col("work_id").cast("string")))
    rows = edges.distinct().withColumn("_drawn", drawn)
    rows = keep_top(rows, ["kind", "node"], ["_drawn", "work_id"], per_node)
    return keep_top(rows, ["work_id"], ["_drawn", "kind", "node"], per_work).drop("_drawn")


@dataclass
class Graph:
    """Two tables of the same edges, bucketed and sorted by work and by node."""

    spark: SparkSession
    by_work: str
    by_node: str

    def edges(self) -> DataFrame:
        return self.spark.table(self.by_work)

    def two_hops(self, works: DataFrame) -> DataFrame:
        """work_id, other_id, shared: works that share nodes with each of works (work_id). Only what the hops find is shuffled:
        the tables lie in buckets of the columns that they are joined on."""
        out = self.spark.table(self.by_work).join(works.select("work_id").distinct(), "work_id")
        near = out.select("kind", "node", "work_id").join(self.spark.table(self.by_node).select("kind", "node", F.col("work_id").alias("other_id")), ["kind", "node"])
        return near.where("work_id <> other_id").groupBy("work_id", "other_id").agg(F.count("*").alias("shared"))

    def drop(self) -> None:
        for name in (self.by_work, self.by_node):
            self.spark.sql(f"drop table if exists {name}")


def store(edges: DataFrame, name: str = "graph", buckets: int = 16) -> Graph:
    """Write edges as a stored graph in the session's warehouse."""
    tag = uuid.uuid4().hex
    graph = Graph(edges.sparkSession, f"{name}_by_work_{tag}", f"{name}_by_node_{tag}")
    for table, keys in ((graph.by_work, ["work_id"]), (graph.by_node, ["kind", "node"])):
        by: list[Column] = [F.col(k) for k in keys]
        edges.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return graph
