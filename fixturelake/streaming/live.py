"""Structured Streaming jobs over score, odds and prediction updates; those with timers are in ``state``.

``event_time`` is a timestamp. Older events never overwrite newer state; what
is later than the watermark is dropped and counted in the query's progress.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 hour"


def odds_windows(quotes: DataFrame, width: str = "1 hour") -> DataFrame:
    """Odds history: number, range and last home odds per match and window."""
    return quotes.withWatermark("event_time", LATE).groupBy("match_id", F.window("event_time", width)).agg(
        F.count(F.lit(1)).alias("quotes"), F.min("home_odds").alias("low"), F.max("home_odds").alias("high"),
        F.max_by("home_odds", F.struct("event_time", "home_odds")).alias("last"),
    )


def without_repeats(updates: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Each distinct update once within the watermark."""
    return updates.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def predictions_with_odds(predictions: DataFrame, quotes: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Stream-stream join: the quotes of the same match within an interval before each prediction."""
    p = predictions.withWatermark("event_time", late).withColumnRenamed("event_time", "predicted_at")
    q = quotes.withWatermark("event_time", late).withColumnRenamed("event_time", "quoted_at").withColumnRenamed("match_id", "q_match")
    near = F.expr(f"match_id = q_match and quoted_at <= predicted_at and quoted_at >= predicted_at - interval {within}")
    return p.join(q, near).drop("q_match")


def daily_hits(settled: DataFrame, key: str = "source", late: str = "1 day") -> DataFrame:
    """Running totals and hits per day and source."""
    return settled.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("w"), key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct")
    ).select(F.col("w.start").alias("day"), key, "total", "correct")


def insert_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that stores each key once; a batch that runs again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return write


def run_to_table(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now; every change is written with its batch number, then read back.

    A second run on the same path goes on where the first ended.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query: StreamingQuery = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data")


def newest_change(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream from its changes."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, *[F.col(f"s.{c}") for c in rest])


def job_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's checkpoint and output, shared by all executors; a temporary one on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay(rows: DataFrame, last: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", steps: int = 3, late: int = 3600) -> DataFrame:
    """Run a stream over rows (event_time, ...) that arrive in several steps, out of order by less than ``late`` seconds.

    Each step is a run that goes on from the checkpoint of the one before. ``last`` (same columns) arrives at the end;
    rows far in the future there let the watermark pass everything else.
    """
    spark = rows.sparkSession
    path = job_path(spark, name)
    schema = rows.schema
    arrival = F.unix_seconds("event_time") + F.pmod(F.xxhash64(*rows.columns), F.lit(late))
    first, end = rows.agg(F.min(arrival), F.max(arrival)).first()
    step = F.expr("0") if first is None else F.least(F.lit(steps - 1), F.floor((arrival - first) * steps / (end - first + 1)))
    out = None
    for k in range(steps + 1):
        part = last if k == steps else rows.where(step == k)
        part.select(*rows.columns).write.mode("append").parquet(f"{path}/in")
        out = run_to_table(build(spark.readStream.schema(schema).parquet(f"{path}/in")), path, mode)
    return out
