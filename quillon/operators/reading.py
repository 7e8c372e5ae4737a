"""Reading sessions, streaks, completions, shelves and the reader's profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scoring
from quillon.operators.lineage import cut, parts, shuffled, small

#: K8's order of shelves.
SHELF_PRIORITY = {"dnf": 4, "read": 3, "currently-reading": 2, "to-read": 1}


def aggregate_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Totals of each reader and work; the last 30 days before as_of apart."""
    recent = F.col("start_at") >= as_of - F.expr("interval 30 days")
    return sessions.groupBy("user_id", "work_id").agg(
        F.sum("duration_ms").alias("total_ms"),
        F.count("*").alias("sessions"),
        F.max("duration_ms").alias("max_ms"),
        F.avg("duration_ms").alias("avg_ms"),
        F.coalesce(F.sum(F.when(recent, F.col("duration_ms"))), F.lit(0)).alias("last30_ms"),
        F.max("start_at").alias("last_read_at"),
    )


def streaks(days: DataFrame) -> DataFrame:
    """Length and last day of the run of days that ends at each reader's latest day."""
    w = Window.partitionBy("user_id").orderBy("day")
    island = F.date_sub("day", F.row_number().over(w))
    runs = days.select("user_id", "day", island.alias("island")).groupBy("user_id", "island").agg(F.count("*").alias("streak"), F.max("day").alias("last_day"))
    last = F.max(F.struct("last_day", "streak")).alias("x")
    return runs.groupBy("user_id").agg(last).select("user_id", F.col("x.last_day").alias("last_day"), F.col("x.streak").alias("streak"))


def auto_dnf(totals: DataFrame, completions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Works not read for so many days and never completed."""
    done = completions.select("user_id", "work_id").distinct()
    stale = totals.where(F.col("last_read_at") < as_of - F.expr(f"interval {days} days"))
    return stale.join(done, ["user_id", "work_id"], "left_anti").select("user_id", "work_id", "last_read_at")


def mark_stale(events: DataFrame, totals: DataFrame, completions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Events of works that are being read but were not for so many days, and never completed, are given up, on the day
    of the last reading; others stay."""
    stale = auto_dnf(totals, completions, as_of, days).select("user_id", "work_id", F.col("last_read_at").alias("_last"))
    rows = events.join(stale, ["user_id", "work_id"], "left")
    on = F.col("_last").isNotNull() & (F.col("shelf") == "currently-reading")
    day = F.col("_last").cast("date").cast("timestamp")
    return rows.select("user_id", "work_id", F.when(on, "dnf").otherwise(F.col("shelf")).alias("shelf"), "rating", F.when(on, F.coalesce(day, "finished_at")).otherwise(F.col("finished_at")).alias("finished_at"), F.when(on, "auto-dnf-stale").alias("notes"))


def _rank() -> Column:
    rank = F.lit(0)
    for name, n in SHELF_PRIORITY.items():
        rank = F.when(F.col("shelf") == name, n).otherwise(rank)
    return rank


def best_shelf(events: DataFrame) -> DataFrame:
    """K8: one row for each reader and work: the shelf of the highest priority and the latest finish among its rows; where events
    have `notes` and `ordinal` (the order of input), the first notes there are among that shelf's rows."""
    best = F.max(F.struct(_rank().alias("rank"), "finished_at", "shelf")).alias("x")
    if "notes" not in events.columns:
        return events.groupBy("user_id", "work_id").agg(best).select("user_id", "work_id", "x.shelf", "x.finished_at")
    noted = F.min(F.when(F.col("notes").isNotNull(), F.struct((-_rank()).alias("rank"), "ordinal", "notes"))).alias("y")
    rows = events.groupBy("user_id", "work_id").agg(best, noted)
    notes = F.when(-F.col("y.rank") == F.col("x.rank"), F.col("y.notes"))
    return rows.select("user_id", "work_id", "x.shelf", "x.finished_at", notes.alias("notes"))


def merge_shelves(old: DataFrame, new: DataFrame) -> DataFrame:
    """K7: an existing shelf of read or dnf stays, else the new one counts; the later finish counts, and, where both have them, the
    new notes before the old ones."""
    noted = "notes" in old.columns and "notes" in new.columns
    o = old.select("user_id", "work_id", F.col("shelf").alias("o_shelf"), F.col("finished_at").alias("o_at"), *([F.col("notes").alias("o_notes")] if noted else []))
    both = o.join(best_shelf(new), ["user_id", "work_id"], "full")
    shelf = F.when(F.col("o_shelf").isin("read", "dnf"), F.col("o_shelf")).otherwise(F.coalesce("shelf", "o_shelf"))
    more = [F.coalesce("notes", "o_notes").alias("notes")] if noted else []
    return both.select("user_id", "work_id", shelf.alias("shelf"), F.greatest("o_at", "finished_at").alias("finished_at"), *more)


def with_previous(events: DataFrame, *first: str) -> DataFrame:
    """Days since the reader's work before, by finish (nulls last), work and source; by the columns `first` before these."""
    w = Window.partitionBy("user_id").orderBy(*first, F.col("finished_at").asc_nulls_last(), "work_id", "source")
    return events.withColumn("days_since_previous", F.datediff("finished_at", F.lag("finished_at").over(w)))


def _counted(events: DataFrame) -> DataFrame:
    return events.withColumn("_n", F.count("*").over(Window.partitionBy("user_id", "work_id", "shelf")))


def _copied(events: DataFrame) -> DataFrame:
    return events.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def fan_out(events: DataFrame) -> DataFrame:
    """What the profile's query makes of the events: each joined to the reader's events of its work and shelf, so n
    sources that put a work on one shelf give n * n rows, and events without a shelf none. The rows joined to are alike in all
    columns that are read, so each event comes as often as the window counts it: no group is joined with itself."""
    return _copied(_counted(with_previous(events).where("shelf is not null")))


def weighted_events(events: DataFrame, totals: DataFrame, completions: DataFrame, ownership: DataFrame, work_author: DataFrame, as_of: Column) -> DataFrame:
    """The events, as fan_out has them, with their weight. What is looked up for each event is added up first; an author's
    works are counted among the reader's own. Events and what is looked up are shuffled by reader once, as one table: there a row
    takes what stands at its reader and work, which all have once at most."""
    done = completions.groupBy("user_id", "work_id").agg(F.count("*").alias("completions"))
    owned = ownership.select("user_id", "work_id").distinct().withColumn("origin", F.lit("Purchase"))
    by = events.select("user_id", "work_id").join(work_author.select("work_id", "author_id"), "work_id").where("user_id is not null and author_id is not null")
    by = by.repartition("user_id").distinct().withColumn("n", F.count("*").over(Window.partitionBy("user_id", "author_id")))
    loyalty = by.groupBy("user_id", "work_id").agg(F.max("n").alias("author_works"))
    keys = ["user_id", "work_id"]
    sides = totals.select(*keys, F.struct(*[c for c in totals.columns if c not in keys]).alias("_totals"))
    for more in (done, owned, loyalty):
        sides = sides.unionByName(more, allowMissingColumns=True)
    sides = sides.where("user_id is not null and work_id is not null").withColumn("_side", F.lit(True))
    both = events.withColumn("_side", F.lit(False)).unionByName(sides, allowMissingColumns=True).repartition("user_id")
    at = Window.partitionBy(*keys)
    rows = _counted(with_previous(both, "_side")).withColumns({c: F.max(c).over(at) for c in ("_totals", "completions", "origin", "author_works")})
    rows = _copied(rows.where("not _side and shelf is not null")).select("*", "_totals.*").drop("_side", "_totals")
    names = ("rating", "finished_at", "last_read_at", "total_ms", "completions", "last30_ms", "author_works", "days_since_previous", "origin", "shelf")
    e = {n: F.col(n) for n in names} | {"avg_minutes": F.col("avg_ms") / 60000.0, "max_minutes": F.col("max_ms") / 60000.0}
    return rows.withColumn("weight", scoring.event_weight(e, as_of))


def signals(weighted: DataFrame) -> DataFrame:
    """P10: what stands behind a weight."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return weighted.select(
        "user_id",
        "work_id",
        yes(F.col("rating") == 5).alias("five_stars"),
        yes(F.col("completions") >= 2).alias("reread"),
        yes(F.col("max_ms") / 60000 >= 240).alias("binge"),
        yes(F.col("avg_ms") / 60000 >= 15).alias("long_sessions"),
        yes(F.col("last30_ms") > 0).alias("active"),
        yes(F.col("author_works") >= 3).alias("loyal"),
        yes(F.col("days_since_previous").between(0, 3)).alias("quick_next"),
    )


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Sum of two vectors, the shorter one padded."""
    if a is None or not len(a):
        return b
    if len(a) != len(b):
        a, b = (np.pad(x, (0, max(len(a), len(b)) - len(x))) for x in (a, b))
    return a + b


#: Readers whose sums a task holds before it hands them on.
HELD_READERS = 2_000


def _reader_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """user_id, plus, plus_weight, minus, minus_weight: weighted sums of vectors by sign of the weight, added up over rows."""
    held: dict = {}

    def flush() -> pa.RecordBatch:
        lists = lambda k: pa.array([None if x[k] is None else x[k].tolist() for x in held.values()], pa.list_(pa.float64()))
        plain = lambda k: pa.array([x[k] for x in held.values()], pa.float64())
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), lists(0), plain(1), lists(2), plain(3)], ["user_id", "plus", "plus_weight", "minus", "minus_weight"])
        held.clear()
        return out

    for batch in batches:
        users, weights, vectors = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
        ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        for k, (user, w) in enumerate(zip(users, weights, strict=True)):
            sums, at = held.setdefault(user, [None, 0.0, None, 0.0]), 0 if w > 0 else 2
            sums[at] = _added(sums[at], w * flat[ends[k] : ends[k + 1]])
            sums[at + 1] += w
        if len(held) > HELD_READERS:
            yield flush()
    if held:
        yield flush()


def _reader_taste(against: float):
    def one(key: tuple, table: pa.Table) -> pa.Table:
        sums = {}
        for side in ("plus", "minus"):
            total = None
            for x in table[side].to_pylist():
                total = total if x is None else _added(total, np.array(x))
            sums[side] = (total, sum(table[f"{side}_weight"].to_pylist()))
        (plus, n), (minus, m) = sums["plus"], sums["minus"]
        if plus is None:
            return pa.table({"user_id": pa.array([], pa.int64()), "vector": pa.array([], pa.list_(pa.float64()))})
        taste = plus / n if minus is None else _added(plus / n, -against * (minus / m))
        length = float(np.sqrt(taste @ taste))
        return pa.table({"user_id": pa.array([key[0].as_py()], pa.int64()), "vector": pa.array([(taste / length if length > 0 else taste).tolist()], pa.list_(pa.float64()))})

    return one


def profile_vector(weighted: DataFrame, works: DataFrame, against: float = 0.3) -> DataFrame:
    """V6, V7: each reader's taste: mean of the works with positive weight less against times that of the others, length 1; none
    for a reader without positive weights. Each task adds up its vectors by reader, so a row for each reader and task is
    shuffled, not one for each event and dimension."""
    rows = weighted.where("weight <> 0").join(works.where("embedding is not null").select("work_id", F.col("embedding").cast("array<double>").alias("embedding")), "work_id")
    sums = rows.select(F.col("user_id").cast("long").alias("user_id"), F.col("weight").cast("double").alias("weight"), "embedding").mapInArrow(_reader_sums, "user_id long, plus array<double>, plus_weight double, minus array<double>, minus_weight double")
    return sums.groupBy("user_id").applyInArrow(_reader_taste(against), "user_id long, vector array<double>")


def anchors(weighted: DataFrame, k: int = 10) -> DataFrame:
    """Each reader's k works of the largest positive weight (to six decimals), ties by id."""
    rows = weighted.where("weight > 0").withColumn("weight", F.round("weight", 6))
    w = Window.partitionBy("user_id").orderBy(F.col("weight").desc(), "work_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("user_id", "work_id", "weight", "position")


#: A value's number is a block and a place in it, which two bytes hold.
PLACES = 1 << 15
#: Values of readers' works that a task counts.
VALUES_EACH = 2_000_000


def _numbered(kinds: dict[str, tuple[DataFrame, DataFrame | None]]) -> tuple[DataFrame, DataFrame]:
    """Of each kind's values: their numbers (code, value), in the order of kinds and values, and the works' lists of them (work_id,
    kind, block, places)."""
    values = None
    for i, (name, (rows, names)) in enumerate(kinds.items()):
        some = (rows if names is None else names).select(F.lit(i).alias("kind"), F.col(name).alias("value"))
        values = some if values is None else values.unionByName(some)
    codes = cut(values.distinct().orderBy("kind", "value").withColumn("code", F.monotonically_increasing_id()), "values")
    found = None
    for i, (name, (rows, names)) in enumerate(kinds.items()):
        mine = small(codes.where(F.col("kind") == i).select("value", "code"))
        if names is None:
            some = rows.join(mine, F.col(name).eqNullSafe(F.col("value")))
        else:
            key = next(c for c in names.columns if c != name)
            some = rows.join(shuffled(names.join(mine, F.col(name).eqNullSafe(F.col("value"))).select(key, "code")), key)
        some = some.select("work_id", F.lit(i).alias("kind"), "code")
        found = some if found is None else found.unionByName(some)
    block, place = F.floor(F.col("code") / PLACES).alias("block"), F.pmod("code", F.lit(PLACES)).cast("short").alias("place")
    lists = found.select("work_id", "kind", block, place).repartition("work_id").groupBy("work_id", "kind", "block").agg(F.collect_list("place").alias("places"))
    return codes.select("code", "value"), cut(lists, "value-lists")


def _favourites(read: DataFrame, kinds: dict[str, tuple[DataFrame, DataFrame | None]], k: int) -> DataFrame:
    """user_id and, for each kind, the array top_<kind>s of the k most frequent values among the works read, ties by the value; null
    where there is none. kinds: by name a table of work_id and the value, or of work_id and an id that a second one (id, value)
    names.

    A reader has many values, most of them once, so counting before the shuffle would send a row for each. What is sent instead
    is a work's list of numbers, two bytes a value; lists are spelt out and counted where all of a reader's are."""
    codes, lists = _numbered(kinds)
    total, works = lists.agg(F.sum(F.size("places")), F.approx_count_distinct("work_id")).first()
    n = parts(read.sparkSession, read.count() * ((total or 0) // max(works, 1) + 1), VALUES_EACH)
    sent = read.select("user_id", "work_id").join(shuffled(lists), "work_id").select("user_id", "kind", "block", "places").repartition(n, "user_id")
    key = ["user_id", "kind", "block", "place"]
    counts = sent.select(*key[:3], F.explode("places").alias("place")).groupBy(*key).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id", "kind").orderBy(F.col("n").desc(), "block", "place")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).withColumn("code", F.col("block") * PLACES + F.col("place"))
    named = top.join(small(codes), "code").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("kind", "r", "value"))).alias("all"))
    of = lambda i: F.transform(F.filter("all", lambda x: x["kind"] == i), lambda x: x["value"])
    return named.select("user_id", *[F.when(F.size(of(i)) > 0, of(i)).alias(f"top_{name}s") for i, name in enumerate(kinds)])


def taste(events: DataFrame, work_subject: DataFrame, work_author: DataFrame | None = None, k: int = 5, authors: DataFrame | None = None) -> DataFrame:
    """A10: each reader's works read, mean rating, and the k most frequent subjects (top_subjects) and, where work_author (work_id,
    name; or, with authors (author_id, name), work_id and author_id) is given, authors (top_authors) among them, as arrays."""
    read = cut(events.where("shelf = 'read'").select("user_id", "work_id", "rating"), "read")
    out = read.groupBy("user_id").agg(F.count("*").alias("works_read"), F.round(F.avg("rating"), 6).alias("avg_rating"))
    kinds = {"subject": (work_subject, None)}
    if work_author is not None:
        kinds["name"] = (work_author, authors)
    return out.join(_favourites(read, kinds, k).withColumnRenamed("top_names", "top_authors"), "user_id", "left")


def taste_summary(events: DataFrame, work_subject: DataFrame, work_author: DataFrame | None = None, k: int = 5) -> DataFrame:
    """A10 as text: the same with the top values joined by commas."""
    rows = taste(events, work_subject, work_author, k)
    return rows.withColumns({c: F.array_join(c, ", ") for c in rows.columns if c.startswith("top_")})


def get_or_build(stored: DataFrame, stale: DataFrame, build) -> DataFrame:
    """The stored profiles (user_id, vector) of readers for whom nothing is newer, and for all others of stale (user_id, stale)
    what build(user_ids) gives, in the same columns; `origin` says which. Only readers without a fresh profile are built."""
    fresh = stored.join(stale.where("not stale").select("user_id"), "user_id", "left_semi")
    todo = stale.select("user_id").join(fresh.select("user_id"), "user_id", "left_anti")
    return fresh.withColumn("origin", F.lit("stored")).unionByName(build(todo).select(*stored.columns).withColumn("origin", F.lit("built")))


def stale_profiles(profiles: DataFrame, *changes: DataFrame) -> DataFrame:
    """Whether anything (user_id, at) is newer than a reader's profile (user_id, updated_at)."""
    seen = changes[0]
    for more in changes[1:]:
        seen = seen.unionByName(more)
    last = seen.groupBy("user_id").agg(F.max("at").alias("at"))
    return profiles.join(last, "user_id", "left").select("user_id", F.coalesce(F.col("at") > F.col("updated_at"), F.lit(False)).alias("stale"))
