"""Several predictions of one match: probabilities, votes, agreement and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X


def _outcomes() -> list:
    """The outcomes that a prediction may have, none included."""
    return [F.lit(k).cast("string") for k in (*X.OUTCOMES, None)]


def with_probabilities(predictions: DataFrame) -> DataFrame:
    """Percentages to probabilities by their sum, 0.33/0.33/0.34 without any."""
    h, d, a = F.col("home_w"), F.col("draw_w"), F.col("away_w")
    return predictions.select(
        "*", X.normalised(h, h, d, a, 0.33).alias("home_p"), X.normalised(d, h, d, a, 0.33).alias("draw_p"), X.normalised(a, h, d, a, 0.34).alias("away_p")
    )


def with_tip_fallback(predictions: DataFrame) -> DataFrame:
    """Probabilities from percentages if there is a home percentage, else from the tip alone."""
    out = with_probabilities(predictions)
    pick = lambda c, k: F.when(F.col("home_w").isNotNull(), F.col(c)).otherwise(X.tip_probability(F.col("tip"), k)).alias(c)
    return out.select(*predictions.columns, pick("home_p", "HOME"), pick("draw_p", "DRAW"), pick("away_p", "AWAY"))


def _vote(column: str, yes: str, no: str):
    given = F.count_if(F.col(column).isin(yes, no))
    return F.when(given == 0, F.lit(None)).when(F.count_if(F.col(column) == yes) > given / 2, yes).otherwise(no)


def match_consensus(predictions: DataFrame) -> DataFrame:
    """Mean percentages, winner (ties home, away, draw), confidence, votes, sources and the list of predictions of each match."""
    real = lambda c: F.avg(F.nullif(F.col(c), F.lit(0.0)))
    means = predictions.groupBy("match_id").agg(
        F.array_sort(F.collect_set("source")).alias("names"),
        F.sort_array(F.collect_list(F.struct("source", "scraped_at", "tip", "home_w", "draw_w", "away_w"))).alias("predictions"),
        real("home_w").alias("avg_home"), real("draw_w").alias("avg_draw"), real("away_w").alias("avg_away"),
        _vote("btts", "Yes", "No").alias("btts_consensus"),
    )
    both = F.col("avg_home").isNotNull() & F.col("avg_away").isNotNull()
    draw = F.coalesce("avg_draw", F.lit(0.0))
    winner = F.when(both, X.argmax_outcome(F.col("avg_home"), draw, F.col("avg_away"), "HAD"))
    rest = [c for c in means.columns if c not in ("match_id", "names")]
    return means.select(
        "match_id", F.array_join("names", ",").alias("sources"), F.size("names").cast("long").alias("num_sources"), *rest,
        winner.alias("consensus_winner"), F.when(both, F.greatest("avg_home", draw, "avg_away")).alias("consensus_confidence"),
    )


def majority_vote(predictions: DataFrame, column: str = "btts", yes: str = "Yes", no: str = "No") -> DataFrame:
    """Yes if more than half of the valid votes say so, null without a valid vote."""
    return predictions.groupBy("match_id").agg(_vote(column, yes, no).alias("vote"), F.count_if(F.col(column).isin(yes, no)).alias("votes"))


def source_agreement(predictions: DataFrame) -> DataFrame:
    """The most common outcome of each match: its count, the agreed outcome, and whether all agree; ties to the first source."""
    of = X.normal_outcome(F.col("tip"))
    each = predictions.select("match_id", of.alias("outcome"), F.struct("source", "scraped_at").alias("voter"))
    # The outcomes are a fixed few, so all are counted in one pass.
    votes = each.groupBy("match_id").agg(
        *[F.count_if(k.eqNullSafe(F.col("outcome"))).alias(f"n_{i}") for i, k in enumerate(_outcomes())],
        *[F.min(F.when(k.eqNullSafe(F.col("outcome")), F.col("voter"))).alias(f"v_{i}") for i, k in enumerate(_outcomes())],
        F.count(F.lit(1)).alias("predictions"),
    )
    # Most votes, then the smallest first voter, then the name.
    ranked = [F.struct((-F.col(f"n_{i}")).alias("n"), F.col(f"v_{i}").alias("first"), k.alias("outcome")) for i, k in enumerate(_outcomes())]
    best = votes.select("match_id", "predictions", F.array_min(F.filter(F.array(*ranked), lambda x: x["n"] < 0)).alias("best"))
    n = -F.col("best.n")
    agreed = F.when((n >= 2) | (F.col("predictions") == 1), F.col("best.outcome"))
    return best.select(
        "match_id", n.alias("agreement_level"), agreed.alias("agreed_outcome"), ((n == F.col("predictions")) & (n >= 2)).alias("all_agree"), "predictions"
    )


def ai_vote_features(predictions: DataFrame) -> DataFrame:
    """Mean probabilities scaled to sum 1, number of predictions and share of the most common winner; the order of rows doesn't matter."""
    each = predictions.withColumn("winner", X.argmax_outcome(F.col("home_p"), F.col("draw_p"), F.col("away_p"), "HAD"))
    count = lambda k: F.count_if(F.col("winner") == k)
    means = each.groupBy("match_id").agg(
        *[X.exact_mean(F.col(f"{k}_p")).alias(k[0]) for k in ("home", "draw", "away")], F.count(F.lit(1)).alias("ai_num_sources"),
        (F.greatest(count("HOME"), count("DRAW"), count("AWAY")) / F.count(F.lit(1))).alias("ai_agreement"),
    )
    total = F.col("h") + F.col("d") + F.col("a")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.col(c))
    return means.select(
        "match_id", share("h").alias("ai_consensus_home"), share("d").alias("ai_consensus_draw"), share("a").alias("ai_consensus_away"),
        "ai_num_sources", "ai_agreement",
    )


def model_consensus(outputs: DataFrame) -> DataFrame:
    """Modal outcome of the models, its share, and mean confidence and probabilities; ties to the first model."""
    of = [k.eqNullSafe(F.col("outcome")) for k in _outcomes()]
    votes = outputs.groupBy("match_id").agg(
        *[F.count_if(k).alias(f"n_{i}") for i, k in enumerate(of)], *[F.min(F.when(k, F.col("model"))).alias(f"v_{i}") for i, k in enumerate(of)],
        F.count(F.lit(1)).alias("models_total"), *[F.avg(c).alias(f"avg_{c}") for c in ("confidence", "home_p", "draw_p", "away_p")],
    )
    ranked = [F.struct((-F.col(f"n_{i}")).alias("n"), F.col(f"v_{i}").alias("first"), k.alias("outcome")) for i, k in enumerate(_outcomes())]
    best = votes.withColumn("best", F.array_min(F.filter(F.array(*ranked), lambda x: x["n"] < 0)))
    n = -F.col("best.n")
    return best.select(
        "match_id", F.col("best.outcome").alias("consensus_outcome"), n.alias("models_agree"), "models_total", (n / F.col("models_total")).alias("agreement"),
        "avg_confidence", "avg_home_p", "avg_draw_p", "avg_away_p",
    )


def disagreement_features(predictions: DataFrame, market: DataFrame, least: int = 2) -> DataFrame:
    """Count, mean, spread and deviation of the probabilities of a match, and their distance to the market."""
    kinds = ("home", "draw", "away")
    spread = predictions.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("source_count"),
        *[F.avg(f"{k}_p").alias(f"avg_{k}_p") for k in kinds],
        *[F.stddev_pop(f"{k}_p").alias(f"std_{k}_p") for k in kinds],
        *[(F.max(f"{k}_p") - F.min(f"{k}_p")).alias(f"spread_{k}") for k in kinds],
    ).where(F.col("source_count") >= least)
    joined = spread.join(market.select("match_id", *[f"fair_{k}" for k in kinds]), "match_id", "left")
    delta = [(F.col(f"avg_{k}_p") - F.col(f"fair_{k}")).alias(f"delta_{k}") for k in kinds]
    flag = X.disagreement(F.col("spread_home"), F.col("spread_draw"), F.col("spread_away"))
    return joined.select(*spread.columns, *delta, flag.alias("disagreement_flag"))


def merge_consensus(ai: DataFrame, ml: DataFrame) -> DataFrame:
    """Full outer merge of two consensus tables on match_id; AI is listed first."""
    a = ai.select("match_id", F.struct(F.lit("AI Sites").alias("name"), F.col("consensus_winner").alias("prediction"), F.col("consensus_confidence").alias("confidence")).alias("ai"))
    m = ml.select("match_id", F.struct(F.lit("ML Ensemble").alias("name"), F.col("outcome").alias("prediction"), F.col("confidence").alias("confidence")).alias("ml"))
    joined = a.join(m, "match_id", "full_outer").withColumn("sources", F.array_compact(F.array("ai", "ml")))
    votes = F.filter("sources", lambda s: s["prediction"].isNotNull())
    out = joined.select("match_id", "sources", votes.alias("votes"))
    two, first, last = F.size("votes") == 2, F.get("votes", F.lit(0))["prediction"], F.get("votes", F.lit(1))["prediction"]
    same = F.coalesce(two & (first == last), F.lit(False))
    level = F.when(same, 2).when(F.size("votes") > 0, 1).otherwise(0)
    agreed = F.when(same | (F.size("votes") == 1), first)
    names = F.array_join(F.transform("sources", lambda s: s["name"]), ",")
    return out.select("match_id", names.alias("sources"), level.cast("long").alias("agreement_level"), agreed.alias("agreed_outcome"), same.alias("all_agree"))


def consensus_counts(merged: DataFrame, playable: DataFrame) -> DataFrame:
    """Totals of a merged consensus; playable holds the match_id of matches with odds."""
    marked = merged.join(playable.select("match_id").distinct().withColumn("odds", F.lit(True)), "match_id", "left")
    agreed, odds = F.col("agreed_outcome").isNotNull(), F.coalesce("odds", F.lit(False))
    return marked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("sources").contains("AI Sites")).alias("ai_predictions"),
        F.count_if(F.col("sources").contains("ML Ensemble")).alias("ml_predictions"), F.count_if(agreed).alias("agreed"),
        F.count_if(agreed & odds).alias("playable"), F.count_if(agreed & odds & F.col("all_agree")).alias("playable_agree_all"),
    )


def sections(merged: DataFrame, with_odds: DataFrame) -> DataFrame:
    """All rows of a merged consensus with their section: playable (agreed, with odds), agreed, or open."""
    marks = with_odds.select("match_id").distinct().withColumn("_odds", F.lit(True))
    agreed = F.col("agreed_outcome").isNotNull()
    section = F.when(~agreed, "open").when(F.col("_odds"), "playable").otherwise("agreed")
    return merged.join(marks, "match_id", "left").withColumn("section", section).drop("_odds")


def playable(merged: DataFrame, with_odds: DataFrame) -> DataFrame:
    """Rows of a merged consensus with an agreed outcome and odds; with_odds holds the match_id of matches that have any."""
    return merged.where(F.col("agreed_outcome").isNotNull()).join(with_odds.select("match_id").distinct(), "match_id", "left_semi")
