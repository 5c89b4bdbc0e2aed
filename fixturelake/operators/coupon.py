"""Daily coupons: best candidates, total odds and settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X


def candidates(scored: DataFrame) -> DataFrame:
    """Matches whose picked outcome has odds over 1; scored has probabilities, odds and fair probabilities."""
    h, d, a = F.col("home_p"), F.col("draw_p"), F.col("away_p")
    pick = X.argmax_outcome(h, d, a)
    odds = X.of_outcome(F.col("pick"), F.col("home_odds"), F.col("draw_odds"), F.col("away_odds"))
    fair = X.of_outcome(F.col("pick"), F.col("fair_home"), F.col("fair_draw"), F.col("fair_away"))
    out = scored.withColumn("pick", pick).select(
        "match_id", "match_date", "pick", odds.alias("odds"), F.greatest(h, d, a).alias("confidence"), (X.of_outcome(F.col("pick"), h, d, a) - fair).alias("edge")
    )
    return out.where(F.col("odds") > 1)


def top_picks(picks: DataFrame, n: int = 4) -> DataFrame:
    """The n best candidates of each day by confidence and edge, then id."""
    order = W.partitionBy("day").orderBy(F.desc("confidence"), F.desc_nulls_last("edge"), "match_id")
    ranked = picks.withColumn("day", F.to_date("match_date")).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= n)


def total_odds(picks: DataFrame) -> DataFrame:
    """Product of the odds of each day's picks, in the picks' order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "odds"))), lambda x: x["odds"])
    return picks.groupBy("day").agg(F.count(F.lit(1)).alias("picks"), F.aggregate(ordered, F.lit(1.0), lambda p, x: p * x).alias("total_odds"))


def settle(picks: DataFrame, results: DataFrame) -> DataFrame:
    """Result of each pick and status of each day's coupon; results has match_id and actual of finished matches."""
    joined = picks.join(results.select("match_id", "actual"), "match_id", "left")
    result = F.when(F.col("actual").isNull(), "pending").when(F.col("actual") == F.col("pick"), "won").otherwise("lost")
    each = joined.withColumn("result", result)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "result"))), lambda x: x["result"])
    status = F.when(F.bool_or(F.col("result") == "pending"), "pending").when(F.bool_and(F.col("result") == "won"), "won").otherwise("lost")
    return each.groupBy("day").agg(status.alias("status"), F.array_join(ordered, ",").alias("pick_results"))
