"""Operator 9. Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are added up by membership pattern; a small network then routes each
pattern's words to its sources' quotas, where the second repetition of a pattern's words costs more than the first, the
third more than the second. What flows out of a pattern is filled by its documents in a seeded order: whole rounds of all
of them, then the first ones of one more round, the last of these in part, so the plan meets quotas to the word.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.quality_rules import words_of
from quillon.llm.shared import materialize, small_side

#: Slices of a pattern's documents in seeded order; only the slice at the border is put in full order.
SLICES = 4096


def default_weights(sources: list[str | None]) -> dict[str | None, int]:
    """3, 1, 2, repeating, over the sources by code point, null last."""
    ordered = sorted((x for x in sources if x is not None)) + [x for x in sources if x is None]
    return {x: (3, 1, 2)[k % 3] for k, x in enumerate(ordered)}


def quotas(sizes: dict[str | None, int], weights: dict[str | None, int], share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source: share of all sizes by weight, at most `most` times the source's size; the excess goes
    to the others by weight until none is above."""
    left, open_, out = share * sum(sizes.values()), dict.fromkeys(sizes), {}
    while open_:
        total = sum(weights[x] for x in open_)
        full = [x for x in open_ if left * weights[x] / total > most * sizes[x]]
        if not full:
            return out | {x: left * weights[x] / total for x in open_}
        for x in full:
            out[x] = most * sizes[x]
            del open_[x]
        left -= sum(out[x] for x in full)
    return out


def route(patterns: dict[tuple, int], targets: dict[str | None, float], most: int = 2) -> dict[tuple, dict[str | None, float]]:
    """Words of each pattern to each of its sources: a flow of the largest amount at the least cost, round r of a pattern's
    words (1 to most) costing r - 1 each. Successive cheapest paths; the network has a node for each pattern and source."""
    nodes = {("s",): 0, ("t",): 1}
    for p in patterns:
        nodes[("p", p)] = len(nodes)
    for x in targets:
        nodes[("q", x)] = len(nodes)
    edges: list[list] = []  # [from, to, room, cost]; edge k and k ^ 1 are each other's reverse
    at = defaultdict(list)

    def add(a: int, b: int, room: float, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            at[x].append(len(edges))
            edges.append([x, y, r, c])
        return len(edges) - 2

    uses = {}
    for p, size in sorted(patterns.items(), key=repr):
        for r in range(most):
            add(0, nodes[("p", p)], float(size), r)
        for x in p:
            uses[p, x] = add(nodes[("p", p)], nodes[("q", x)], float("inf"), 0)
    for x, target in targets.items():
        add(nodes[("q", x)], 1, float(target), 0)
    tiny = 1e-6
    while True:
        cost, by, queue = {0: 0}, {}, [0]
        while queue:
            below = []
            for a in queue:
                for k in at[a]:
                    _, b, room, c = edges[k]
                    if room > tiny and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], by[b] = cost[a] + c, k
                        below.append(b)
            queue = below
        if 1 not in by:
            break
        path, b = [], 1
        while b:
            path.append(by[b])
            b = edges[by[b]][0]
        flow = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= flow
            edges[k ^ 1][2] += flow
    out: dict[tuple, dict] = defaultdict(dict)
    for (p, x), k in uses.items():
        out[p][x] = edges[k ^ 1][2]
    return dict(out)


def text_size(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _keyed(docs: DataFrame, sources: Column, seed: int, id_col: str, text_col: str) -> list[Column]:
    """Columns _id, _pattern (sorted distinct sources), _order (seeded), _slice of docs' rows."""
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.when(F.size(sources) > 0, sources), F.array(F.lit(None).cast("string")))))
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.xxhash64(text_col))
    return [F.col(id_col).alias("_id"), pattern.alias("_pattern"), order.alias("_order"), F.pmod(F.shiftright(order, 20), F.lit(SLICES)).cast("int").alias("_slice")]


def _routes(docs: DataFrame, sources: Column, weights: dict | None, share: float, most: int, seed: int, id_col: str, text_col: str):
    """Rows' sizes; for each pattern p the whole rounds, the slice _at up to which one more round goes, and the words _left
    there; what is known of the rows in those slices: size, m equal rows, and total, the words that these give to the last
    round; sizes and targets of the sources; the number of patterns."""
    rows = docs.select(*_keyed(docs, sources, seed, id_col, text_col), text_size(F.col(text_col)).alias("size"))
    rows = materialize(rows, "mix-sizes")
    slices = materialize(rows.groupBy("_pattern", "_slice").agg(F.sum("size").alias("words")), "mix-slices")
    totals = {tuple(p): int(n) for p, n in slices.groupBy("_pattern").agg(F.sum("words")).collect()}
    sizes: dict = defaultdict(int)
    for p, n in totals.items():
        for x in p:
            sizes[x] += n
    targets = quotas(sizes, weights or default_weights(list(sizes)), share, most)
    flows = route(totals, targets, most)
    plans = []
    for p, n in totals.items():
        words = min(most * n, round(sum(flows[p].values())))
        plans.append((list(p), words // n if n else 0, words % n if n else 0))
    names = T.ArrayType(T.StringType())
    kinds = T.StructType([T.StructField("p", names), T.StructField("rounds", T.LongType()), T.StructField("more", T.LongType())])
    plan = docs.sparkSession.createDataFrame(plans, kinds)  # a row for each pattern, as many as the driver has routed
    before = Window.partitionBy("_pattern").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(small_side(plan, len(plans)), F.col("_pattern").eqNullSafe(F.col("p")))
    last = starts.where("_before < more").groupBy("p").agg(F.max(F.struct("_slice", (F.col("more") - F.col("_before")).alias("left"))).alias("last"))
    last = last.select(F.col("p").alias("q"), F.col("last._slice").alias("_at"), F.col("last.left").alias("_left"))
    routes = plan.join(last, F.col("p").eqNullSafe(F.col("q")), "left").select("p", "rounds", F.coalesce("_at", F.lit(-1)).alias("_at"), F.coalesce("_left", F.lit(0)).alias("_left"))
    routes = materialize(routes, "mix-routes")
    marked = rows.join(small_side(routes, len(plans)), F.col("_pattern").eqNullSafe(F.col("p")))
    equal = marked.where("_slice = _at").groupBy("_pattern", "_order", "_id", "size", "rounds", "_left").agg(F.count("*").alias("m"))
    within = Window.partitionBy("_pattern").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    all_ = F.col("size") * F.col("m")
    room = F.col("_left") - F.coalesce(F.sum(all_).over(within), F.lit(0))
    border = materialize(equal.select("_pattern", "_order", "_id", "size", "rounds", "m", F.greatest(F.lit(0).cast("long"), F.least(all_, room)).alias("total")), "mix-border")
    return marked, routes, border, dict(sizes), targets, len(plans)


def plan_mix(docs: DataFrame, sources: Column, weights: dict | None = None, share: float = 1.5, most: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, size, _pattern (sorted distinct sources), rounds, rest, taken for each row.

    sources: an array of source names for each row (null elements are a source of their own; a null or empty array is the
    null source). taken = rounds * size + rest: rounds whole copies and rest words of one more. weights default to
    default_weights. Null, empty and wordless texts have size 0 and take 0; a table without words takes nothing; very long
    texts count whole. Equal ids are ordered by their text's hash; of rows equal in both the first ones, in any order, are
    taken. Extra columns, whatever their names, don't matter. The driver gets a row for each pattern and source, never one
    for each document; the plan that rows are joined with has a row for each pattern.
    """
    marked, _, border, sizes, targets, _ = _routes(docs, sources, weights, share, most, seed, id_col, text_col)
    zero = F.lit(0).cast("long")
    whole = marked.where("_slice <> _at").withColumn("rest", F.when(F.col("_slice") < F.col("_at"), F.col("size")).otherwise(zero))
    parts = border.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    parts = parts.withColumn("rest", F.greatest(zero, F.least("size", F.col("total") - (F.col("_j") - 1) * F.col("size"))))
    columns = [F.col("_id").alias(id_col), "size", "_pattern", "rounds", "rest", (F.col("rounds") * F.col("size") + F.col("rest")).alias("taken")]
    out = whole.select(*columns).unionByName(parts.select(*columns))
    out._mix = (sizes, targets)
    return out


def mixed_documents(docs: DataFrame, sources: Column, weights: dict | None = None, share: float = 1.5, most: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: docs' rows, each once for every round it is in, whole. The document at the border of a pattern, which
    plan_mix takes in part, goes in if that is half of it or more; so a pattern is off its flow by half a document at most.

    Columns as docs has them, whatever their names. Null, empty and wordless texts, and documents that no round takes, are
    left out. Of rows with equal id and text as many are taken as the plan has. An empty table gives an empty mix. Texts are
    not shuffled unless the table of patterns or that of their border slices is too large to be broadcast.
    """
    _, routes, border, _, _, n = _routes(docs, sources, weights, share, most, seed, id_col, text_col)
    word = F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.where(word).select(row, *_keyed(docs, sources, seed, id_col, text_col))
    rows = rows.join(small_side(routes, n), F.col("_pattern").eqNullSafe(F.col("p"))).select("_row", "_id", "_order", "_slice", "rounds", "_at")
    # Of m equal rows of a border slice, k are in the last round.
    half = (2 * (F.col("total") % F.col("size")) >= F.col("size")).cast("long")
    units = border.where("size > 0").select(F.col("_order").alias("_o"), F.col("_id").alias("_i"), "m", (F.floor(F.col("total") / F.col("size")) + half).alias("k"))
    inner = rows.where("_slice = _at").join(small_side(units, units.count()), (F.col("_order") == F.col("_o")) & F.col("_id").eqNullSafe(F.col("_i")))
    copies = F.col("rounds") + (F.col("_slice") < F.col("_at")).cast("long")
    out = rows.where("_slice <> _at").select("_row", copies.alias("_copies"))
    out = out.unionByName(inner.where("k = 0 or k = m").select("_row", (F.col("rounds") + (F.col("k") > 0).cast("long")).alias("_copies")))
    if units.where("k > 0 and k < m").limit(1).count():
        # Equal rows are numbered by file and place in it, so no task gets all of them.
        some = materialize(inner.where("k > 0 and k < m").select("_row", "_order", "_id", "rounds", "k"), "mix-equal").withColumn("_file", F.input_file_name())
        by = Window.partitionBy("_order", "_id")
        ahead = some.groupBy("_order", "_id", "_file").agg(F.count("*").alias("n")).withColumn("_ahead", F.sum("n").over(by.orderBy("_file")) - F.col("n"))
        ahead = ahead.select(F.col("_order").alias("_o"), F.col("_id").alias("_i"), F.col("_file").alias("_f"), "_ahead")
        here = some.withColumn("_at", F.row_number().over(Window.partitionBy("_order", "_id", "_file").orderBy(F.to_json("_row"))))
        here = here.join(ahead, (F.col("_order") == F.col("_o")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_file") == F.col("_f")))
        out = out.unionByName(here.select("_row", (F.col("rounds") + (F.col("_ahead") + F.col("_at") <= F.col("k")).cast("long")).alias("_copies")))
    out = out.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select("_row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, each a member of its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = plan_mix(docs, F.array("source"))
    sizes, targets = plan._mix
    names = T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    table = spark.createDataFrame([(x, int(n), float(targets[x])) for x, n in sizes.items()], names)
    return plan.join(F.broadcast(table), F.get("_pattern", F.lit(0)).eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")
