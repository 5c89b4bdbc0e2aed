"""A partitioned and bucketed store of matches and of what belongs to them.

Tables are partitioned by a column of few values, which filters prune, and
bucketed by match, so joins on it need no shuffle. Files lie under a shared path; the
tables' names are of the session's catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, BUCKETS = "match_id", 16


def write(rows: DataFrame, table: str, path: str, partition: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Store rows as a table under path; every file holds one bucket (of one partition), sorted by match."""
    keys = [partition] if partition else []
    # One task per bucket writes its file of each partition.
    writer = rows.repartition(buckets, KEY).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, KEY).sortBy(KEY)
    (writer.partitionBy(*keys) if keys else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


def seasons_where(matches: DataFrame, condition: Column) -> DataFrame:
    """The seasons with a match that meets a condition: a row per season, so small enough to prune a scan with."""
    return matches.where(condition).select("season").distinct()


def of_seasons(stored: DataFrame, seasons: DataFrame) -> DataFrame:
    """Rows of the stored table in the given seasons (one row each); other partitions are not read."""
    return stored.join(F.broadcast(seasons.select("season")), "season")


def with_quotes(matches: DataFrame, quotes: DataFrame) -> DataFrame:
    """Join on the bucketed key of both tables, without a shuffle."""
    return matches.join(quotes, KEY)


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"drop table if exists {table}")
