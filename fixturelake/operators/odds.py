"""Odds tables: bookmaker averages, fair probabilities, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X


def average_and_best(quotes: DataFrame) -> DataFrame:
    """Mean and highest odds of each match over its bookmakers, whatever the order of rows; zero and null odds don't count."""
    real = {k: F.nullif(F.col(f"{k}_odds"), F.lit(0.0)) for k in ("home", "draw", "away")}
    return quotes.groupBy("match_id").agg(
        F.size(F.collect_set("bookmaker")).cast("long").alias("bookmakers"),
        *[X.exact_mean(c).alias(f"avg_{k}") for k, c in real.items()],
        *[F.max(c).alias(f"best_{k}") for k, c in real.items()],
    )


def fair_probabilities(odds: DataFrame, home: str = "avg_home", draw: str = "avg_draw", away: str = "avg_away") -> DataFrame:
    h, d, a = F.col(home), F.col(draw), F.col(away)
    return odds.select(
        "*", X.overround(h, d, a).alias("overround"),
        *[X.fair_probability(o, h, d, a).alias(f"fair_{k}") for k, o in (("home", h), ("draw", d), ("away", a))],
    )


def with_fallback(matches: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary odds of each match, else the averages of the secondary source; odds_source tells which."""
    kinds = ("home", "draw", "away")
    first = primary.select("match_id", *[F.col(f"{k}_odds").alias(f"p_{k}") for k in kinds])
    second = secondary.select("match_id", *[F.col(f"avg_{k}").alias(f"s_{k}") for k in kinds])
    has = F.coalesce((F.col("p_home") > 0) & (F.col("p_draw") > 0) & (F.col("p_away") > 0), F.lit(False))
    joined = matches.join(first, "match_id", "left").join(second, "match_id", "left")
    source = F.when(has, "primary").when(F.col("s_home").isNotNull(), "average")
    picked = [F.when(has, F.col(f"p_{k}")).otherwise(F.col(f"s_{k}")).alias(f"{k}_odds") for k in kinds]
    return joined.select(*matches.columns, *picked, source.alias("odds_source"))


def odds_at_scrape(predictions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Newest quote of the match at or before each prediction, by union and a carried-forward value."""
    kinds = ["home_odds", "draw_odds", "away_odds"]
    q = quotes.groupBy("match_id", F.col("quoted_at").alias("at")).agg(F.max(F.struct("bookmaker", *kinds)).alias("quote"))
    p = predictions.select("match_id", F.col("scraped_at").alias("at"), F.struct(*predictions.columns).alias("prediction"))
    both = q.withColumn("prediction", F.lit(None).cast(p.schema["prediction"].dataType)).withColumn("place", F.lit(0)).unionByName(
        p.withColumn("quote", F.lit(None).cast(q.schema["quote"].dataType)).withColumn("place", F.lit(1))
    )
    carried = both.selectExpr(
        "prediction", "last(quote, true) over (partition by match_id order by at, place rows between unbounded preceding and current row) as quote"
    )
    return carried.where(F.col("prediction").isNotNull()).select("prediction.*", F.col("quote.home_odds").alias("home_at_scrape"), F.col("quote.draw_odds").alias("draw_at_scrape"), F.col("quote.away_odds").alias("away_at_scrape"))
