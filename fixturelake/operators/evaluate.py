"""Predictions against results: accuracy, Brier score, log loss, return, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X
from fixturelake.operators.stats import finished


def verified(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Predictions of finished matches with the actual outcome and a hit flag; predictions has source, outcome and confidence."""
    results = finished(matches).select("match_id", "league_code", "match_date", X.outcome_of_score(F.col("home_score"), F.col("away_score")).alias("actual"))
    return predictions.join(results, "match_id").withColumn("hit", F.col("outcome") == F.col("actual"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Totals, hits, accuracy and mean confidence per key, or overall without one."""
    measures = [
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct"), (F.count_if("hit") / F.count(F.lit(1))).alias("accuracy"),
        F.avg("confidence").alias("avg_confidence"),
    ]
    return rows.groupBy(*by).agg(*measures)


def accuracy_all_levels(rows: DataFrame) -> DataFrame:
    """Overall, by source, by league and by day in one pass over grouping sets."""
    rows = rows.withColumn("day", F.to_date("match_date"))
    return rows.groupingSets([[], ["source"], ["league_code"], ["day"]], "source", "league_code", "day").agg(
        F.grouping_id("source", "league_code", "day").alias("level"), F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct")
    )


def recent(rows: DataFrame, n: int = 100) -> DataFrame:
    """The newest n verified predictions; ties by id, source and scrape time."""
    return rows.orderBy(F.desc("match_date"), F.desc("match_id"), "source", "scraped_at", "confidence").limit(n)


def by_day(rows: DataFrame, days: int = 30) -> DataFrame:
    daily = rows.groupBy(F.to_date("match_date").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct"))
    return daily.orderBy(F.desc("day")).limit(days)


def scorecard(rows: DataFrame, least: int = 3) -> DataFrame:
    """Accuracy, mean Brier score, log loss and flat-stake return of each source with enough rows.

    roi_fair pays 1 / own probability, roi_market the market odds.
    """
    h, d, a = F.col("home_p"), F.col("draw_p"), F.col("away_p")
    own = X.of_outcome(F.col("outcome"), h, d, a)
    scored = rows.select(
        "source", "hit", X.brier(h, d, a, F.col("actual")).alias("brier"), X.log_loss(h, d, a, F.col("actual")).alias("log_loss"),
        X.flat_roi(F.col("outcome"), F.col("actual"), 1 / F.nullif(own, F.lit(0.0))).alias("roi_fair"),
        X.flat_roi(F.col("outcome"), F.col("actual"), X.of_outcome(F.col("outcome"), F.col("home_odds"), F.col("draw_odds"), F.col("away_odds"))).alias("roi_market"),
    )
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if("hit").alias("correct"), (F.count_if("hit") / F.count(F.lit(1))).alias("accuracy"),
        F.avg("brier").alias("brier_score"), F.avg("log_loss").alias("log_loss"), F.avg("roi_fair").alias("roi_fair"), F.avg("roi_market").alias("roi_market"),
    ).where(F.col("predictions") >= least)


def source_weights(card: DataFrame, floor: float = 0.01) -> DataFrame:
    """max(1 - Brier, floor), scaled to sum 1; one row per source, so the total is a small window."""
    raw = F.greatest(1 - F.col("brier_score"), F.lit(floor))
    return card.select("source", (raw / F.sum(raw).over(W.partitionBy())).alias("weight"))


def ensemble_accuracy(by_model: DataFrame) -> DataFrame:
    """Mean of the positive accuracies, and overall accuracy from totals, in percent."""
    return by_model.agg(
        F.avg(F.when(F.col("accuracy") > 0, F.col("accuracy"))).alias("mean_accuracy"),
        (F.sum("correct") * 100 / F.nullif(F.sum("total"), F.lit(0))).alias("overall_percent"),
    )
