"""Views for a front end, lookups by key, and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X

#: Matches that are to be played or are running.
OPEN = ("SCHEDULED", "IN_PLAY")


def upcoming_view(matches: DataFrame, today: str) -> DataFrame:
    """Open matches from today on, without scores; matches: home, away, league_name, match_date and status."""
    rows = matches.where(F.col("status").isin(*OPEN) & (F.col("match_date") >= F.lit(today).cast("date")))
    none = F.lit(None).cast("long")
    return rows.select(
        F.col("home").alias("home_team_name"), F.col("away").alias("away_team_name"), none.alias("home_score"), none.alias("away_score"),
        F.lit("SCHEDULED").alias("status"), "match_date", "league_name",
    )


def _percent(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def predictions_view(scores: DataFrame) -> DataFrame:
    """Ensemble predictions in whole percent; scores as of ``attach.pipeline_scores`` with home, away, league_code and match_date."""
    return scores.select(
        "match_id", F.col("home").alias("home_team"), F.col("away").alias("away_team"), F.col("league_code").alias("league"), "match_date", F.col("outcome").alias("predicted_outcome"),
        _percent("confidence").alias("confidence"), _percent("home_p").alias("home_prob"), _percent("draw_p").alias("draw_prob"), _percent("away_p").alias("away_prob"),
        F.lit("ML Ensemble").alias("sources"), F.col("outcome").alias("consensus"),
    )


def odds_view(scores: DataFrame) -> DataFrame:
    """Odds, prediction and value of each match; odds that are missing follow from the probabilities."""
    odds = {n: F.when(F.col("has_odds") & (F.col(f"{k}_used") > 0), F.col(f"{k}_used")).otherwise(X.price_from_probability(F.col(f"{k}_p"))).alias(f"odds_{n}") for n, k in (("1", "home"), ("x", "draw"), ("2", "away"))}
    edge = F.coalesce(X.of_outcome(F.col("outcome"), F.col("edge_home"), F.col("edge_draw"), F.col("edge_away")), F.lit(0.0))
    return scores.select(
        F.col("home").alias("home_team"), F.col("away").alias("away_team"), F.col("league_code").alias("league"), "match_date", *odds.values(), F.col("outcome").alias("ai_prediction"),
        _percent("confidence").alias("ai_confidence"), (edge > 0.03).alias("value_bet"), (edge * 100).alias("value_edge"),
    )


def without_result(matches: DataFrame, results: DataFrame) -> DataFrame:
    """Finished matches that have no stored result."""
    return matches.where(F.col("status") == "FINISHED").join(results.select("match_id"), "match_id", "left_anti")


def by_key(rows: DataFrame, key: str, *values, order: tuple = ()) -> DataFrame:
    """Documents of the given keys, in the given order."""
    found = rows.where(F.col(key).isin(*values))
    return found.orderBy(*order) if order else found


def in_kickoff_range(matches: DataFrame, start: str, end: str) -> DataFrame:
    """Matches that begin in [start, end), dates or timestamps as text."""
    return matches.where((F.col("match_date") >= F.lit(start).cast("timestamp")) & (F.col("match_date") < F.lit(end).cast("timestamp")))


def todays_predictions(predictions: DataFrame, day: str) -> DataFrame:
    """Predictions of one day, the most confident first."""
    return predictions.where(F.to_date("match_date") == F.lit(day).cast("date")).orderBy(F.desc("confidence"), "match_id", "model")


def pending(coupons: DataFrame) -> DataFrame:
    return coupons.where(F.coalesce("status", F.lit("pending")) == "pending")


def ensemble_rows(scores: DataFrame, name: str = "ensemble") -> DataFrame:
    return scores.where(F.col("model") == name)


def of_day(matches: DataFrame, day: str) -> DataFrame:
    """Matches of a day by league, then time."""
    start = F.lit(day).cast("date")
    return matches.where((F.col("match_date") >= start) & (F.col("match_date") < F.date_add(start, 1))).orderBy("league_code", "match_date", "match_id")


def newest_results(results: DataFrame) -> DataFrame:
    """All results, newest first; a sort by ranges, so no task holds them all."""
    return results.orderBy(F.desc("match_date"), F.desc("match_id"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows with their place; the number is over n rows only."""
    chosen = rows.orderBy(*order).limit(n)
    return chosen.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


def by_ratio(totals: DataFrame) -> DataFrame:
    """All rows by correct per total with their place, best first; totals holds one row per model or league, so they are few."""
    ratio = F.col("correct") / F.greatest(F.col("total"), F.lit(1))
    order = [F.desc("ratio"), F.desc("total"), F.col(totals.columns[0])]
    return totals.withColumn("ratio", ratio).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))
