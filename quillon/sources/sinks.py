"""Sinks: upserts by policy, keep-top, expiry (K1-K20). Parquet has no update in place: each is a join of old and new rows
whose result replaces the old table in one directory write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Policy: the value from the old row o and the new row n; there says whether the new row exists.
POLICIES = {
    "new": lambda o, n, there: F.when(there, n).otherwise(o),  # K3: the new value, null or not
    "coalesce": lambda o, n, there: F.coalesce(n, o),  # K4: the new value unless it is null
    "fill": lambda o, n, there: F.coalesce(o, n),  # K5: only where there is none
    "greatest": lambda o, n, there: F.greatest(o, n),  # K6
    "least": lambda o, n, there: F.least(o, n),
    "sum": lambda o, n, there: F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """K3-K6: old with new merged in by keys (null keys match each other); a column without a policy is `coalesce`. new has
    one row a key (see latest)."""
    o, n = old.alias("o"), new.withColumn("_there", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.join(n, on, "full")
    there = F.coalesce(F.col("n._there"), F.lit(False))
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
            out.append(POLICIES[policies.get(c, "coalesce")](F.col(f"o.{c}"), fresh, there).alias(c))
    return both.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K2: old and those rows of new whose key is in neither; of equal keys in new, one row."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K3's input: of equal keys the row that is last by order."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("x")
    return rows.groupBy(*keys).agg(best).select(*keys, "x.*").select(*rows.columns)


def live(rows: DataFrame, as_of: Column, except_users: list[int] = ()) -> DataFrame:
    """Cached rows that have not expired, less those of users whose cache is void."""
    kept = rows.where(F.col("expires_at") > as_of)
    return kept.where(~F.col("user_id").isin(*except_users)) if except_users else kept


def merge_json(old: Column, new: Column) -> Column:
    """Two JSON objects as one, the new fields winning; null fields of new are dropped."""
    kind = "map<string,string>"
    a, b = F.coalesce(F.from_json(old, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(new, kind), F.create_map().cast(kind))
    fresh = F.map_filter(b, lambda k, v: v.isNotNull())
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.to_json(F.map_concat(kept, fresh))


def replace_table(rows: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Overwrite a table."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """K1."""
    rows.write.mode("append").parquet(path)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], only_null: bool = False) -> DataFrame:
    """K9: target with columns taken from the source's row of equal keys; a row without one stays. only_null: where it has none."""
    new = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    joined = target.join(new, keys, "left")
    pick = lambda c: F.coalesce(c, f"_{c}") if only_null else F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.withColumns({c: pick(c) for c in columns}).select(*target.columns)


def toggle(old: DataFrame, add: DataFrame, remove: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after some were put in, where they weren't there, and others were deleted."""
    return insert_ignore(old, add, keys).join(remove.select(*keys), keys, "left_anti").select(*old.columns)


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """the rows that hold to all rules (name: condition), and the others with the name of the first rule they break. A rule
    that is neither true nor false is broken."""
    broken = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    marked = rows.withColumn("broken_rule", broken)
    return marked.where("broken_rule is null").drop("broken_rule"), marked.where("broken_rule is not null")


def seed_ids(seeds: DataFrame) -> DataFrame:
    """Seeds with the id in their key where it is a work's, else null."""
    id_ = F.when(F.col("seed_key").like("/works/%"), F.nullif(F.regexp_extract("seed_key", "^/works/(OL[0-9]+W)", 1), F.lit("")))
    return seeds.withColumn("work_key", id_)
