"""Merges, deduplication and keyed sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order, which should end with a unique column."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def union_by_priority(*feeds: DataFrame) -> DataFrame:
    """Bag union with the feed's number as priority; missing columns are null."""
    numbered = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def priority_fallback(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope only the rows of the first feed that has any."""
    first = rows.groupBy(*scope).agg(F.min("priority").alias("_first"))
    return rows.join(first, scope).where(F.col("priority") == F.col("_first")).drop("_first")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], overwrite: list[str], keep_old_if_null: bool = True) -> DataFrame:
    """Full outer merge: listed columns take the new value, others keep the stored one; new keys are added whole."""
    old, new = base.alias("b"), changes.alias("c")
    joined = old.join(new, [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full_outer")
    stored = reduce(lambda x, y: x | y, [F.col(f"b.{k}").isNotNull() for k in keys])
    changed = reduce(lambda x, y: x | y, [F.col(f"c.{k}").isNotNull() for k in keys])

    def pick(c: str) -> Column:
        b, n = F.col(f"b.{c}"), F.col(f"c.{c}")
        if c in keys:
            return F.coalesce(b, n).alias(c)
        if c not in overwrite:
            return F.when(stored, b).otherwise(n).alias(c)
        return (F.coalesce(n, b) if keep_old_if_null else F.when(changed, n).otherwise(b)).alias(c)

    return joined.select(*[pick(c) for c in base.columns])


def merge_fields(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Every given field overwrites, absent (null) ones stay."""
    return upsert(base, changes, keys, [c for c in base.columns if c not in keys])


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows to append: the first of each key that isn't stored yet."""
    return first_per_key(rows, keys, *order).join(base.select(*keys).distinct(), keys, "left_anti")


def replace_documents(base: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Whole documents by key: the first new one in the given order, else the stored one, with no field carried over."""
    newest = first_per_key(rows, keys, *order)
    return base.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def append_unseen(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def save_coupons(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New coupons by day; a stored one that is already settled stays."""
    settled = stored.where(F.col("status").isNotNull() & (F.col("status") != "pending"))
    fresh = new.join(settled.select("day"), "day", "left_anti")
    rest = stored.join(fresh.select("day"), "day", "left_anti")
    return rest.unionByName(fresh, allowMissingColumns=True)


def set_status(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Write status and pick results onto stored coupons."""
    return upsert(stored, results.join(stored.select("day"), "day", "left_semi"), ["day"], ["status", "pick_results"])


def write_keyed(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace only the partitions that df holds; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append(df: DataFrame, path: str, partition: list[str]) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def fresh(captures: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Captures that haven't expired, the newest per key."""
    return first_per_key(captures.where(F.col("expires_at") > now), keys, F.desc("captured_at"))


def purged(captures: DataFrame, now: Column) -> DataFrame:
    """The cache without expired captures."""
    return captures.where(F.col("expires_at") > now)
