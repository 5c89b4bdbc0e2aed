"""Tables of several sources brought to the matches by the names of their teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.functions import scalars as X
from fixturelake.operators import entity, models

KINDS = ("home", "draw", "away")
#: Odds of a match without any.
DEFAULT_ODDS = {"home": 2.5, "draw": 3.3, "away": 3.0}


def enrich(matches: DataFrame, live: DataFrame) -> DataFrame:
    """Matches with feed id, live status, minute and scores of the events that match them; other events are appended.

    matches: pos, home, away, status, home_score, away_score; live: id, home,
    away, status, minute, home_score, away_score, feed_id. Of several events of a
    match the last one counts for each part; scores come together.
    """
    found = entity.first_of_pairs(live, matches).select("home", "away", "pos")
    score = F.struct("home_score", "away_score")
    last = live.join(found, ["home", "away"]).groupBy("pos").agg(
        F.max_by("feed_id", "id").alias("feed_id"),
        F.max_by("minute", F.when(F.col("status") == "LIVE", F.col("id"))).alias("minute"),
        F.max_by(score, F.when(F.col("home_score").isNotNull(), F.col("id"))).alias("score"),
        F.bool_or(F.col("status") == "LIVE").alias("is_live"),
    )
    joined = matches.join(last, "pos", "left")
    known = joined.select(
        "pos", "home", "away", F.when(F.col("is_live"), "LIVE").otherwise(F.col("status")).alias("status"), F.when(F.col("is_live"), F.col("minute")).alias("minute"),
        *[F.when(F.col("score").isNotNull(), F.col(f"score.{c}")).otherwise(F.col(c)).alias(c) for c in ("home_score", "away_score")], "feed_id",
    )
    new = live.join(found, ["home", "away"], "left_anti").select(F.lit(None).cast(matches.schema["pos"].dataType).alias("pos"), "home", "away", "status", "minute", "home_score", "away_score", "feed_id")
    return known.unionByName(new)


def market_rows(matches: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """Fair probabilities of each odds event as a prediction of its match; events without a match or without all three odds give none.

    matches: pos, home, away; events: id, home, away, home_odds, draw_odds, away_odds and extras.
    """
    odds = [F.col(f"{k}_odds") for k in KINDS]
    found = entity.first_of_pairs(events, matches).select("home", "away", "pos")
    whole = events.join(found, ["home", "away"]).where((odds[0] > 0) & (odds[1] > 0) & (odds[2] > 0))
    extras = [c for c in events.columns if c not in ("id", "home", "away", *[f"{k}_odds" for k in KINDS])]
    return whole.select(
        F.col("pos").alias("match_id"), F.col("id").alias("event_id"), F.lit(source).alias("source"),
        *[X.rounded(X.fair_probability(o, *odds), 4).alias(f"{k}_p") for k, o in zip(KINDS, odds, strict=True)],
        F.struct(*[o.alias(k) for k, o in zip(KINDS, odds, strict=True)]).alias("odds_at_scrape"), *extras,
    )


def attach_predictions(predictions: DataFrame, matches: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions of known matches with probabilities and the market's odds at that time; those without a match are dropped.

    predictions: id, home, away, source, home_pct, draw_pct, away_pct, tip and
    extras; matches: pos, home, away; events: id, home, away and odds, of which
    the last one of a name key counts.
    """
    h, d, a = F.col("home_pct"), F.col("draw_pct"), F.col("away_pct")
    given = h.isNotNull() & a.isNotNull()
    default = dict(zip(KINDS, (0.33, 0.33, 0.34), strict=True))
    tip = F.when(F.coalesce("tip", F.lit("1")).isin("1", "2"), F.coalesce("tip", F.lit("1"))).otherwise("X")
    share = {k: X.normalised(c, h, d, a, default[k]) for k, c in zip(KINDS, (h, d, a), strict=True)}
    probability = [F.when(given, F.round(share[k], 4)).otherwise(X.tip_probability(tip, k.upper())).alias(f"{k}_p") for k in KINDS]
    # Names are normalised for distinct pairs only, and what belongs to a pair is joined to the rows at once.
    key = F.concat_ws("_", N.merge_name(F.col("home")), N.merge_name(F.col("away"))).alias("key")
    last = events.groupBy("home", "away").agg(F.max_by(F.struct(*[F.col(f"{k}_odds").alias(k) for k in KINDS]), "id").alias("odds"), F.max("id").alias("last"))
    market = entity.stored(last).select(key, "odds", "last").groupBy("key").agg(F.max_by("odds", "last").alias("odds_at_scrape"))
    found = entity.first_of_pairs(predictions, matches).select("home", "away", "pos", key)
    pairs = entity.stored(found.join(market, "key", "left").drop("key"))
    extras = [c for c in predictions.columns if c not in ("id", "home", "away", "source", "home_pct", "draw_pct", "away_pct")]
    joined = predictions.join(pairs, ["home", "away"])
    return joined.select(F.col("pos").alias("match_id"), "id", "source", *probability, "odds_at_scrape", *extras)


def votes_by_teams(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Number and mean of the normalised probabilities of all predictions with a match's teams, one row per match that has any.

    Predictions are summed per pair of names first, so only distinct pairs are
    resolved and no prediction is joined with all matches of its pair.
    """
    h, d, a = F.col("home_pct"), F.col("draw_pct"), F.col("away_pct")
    total = sum((F.coalesce(c, F.lit(0.0)) for c in (h, d, a)), F.lit(0.0))
    parts = [F.sum(F.coalesce(c, F.lit(0.0)) / total).alias(f"sum_{k}") for k, c in zip(KINDS, (h, d, a), strict=True)]
    per_pair = entity.stored(predictions.where(total > 0).groupBy("home", "away").agg(F.count(F.lit(1)).alias("n"), *parts))
    known = per_pair.select(F.col("home").alias("r_home"), F.col("away").alias("r_away"), "n", *[f"sum_{k}" for k in KINDS])
    pairs = entity.matching_pairs(matches, per_pair).join(known, ["r_home", "r_away"])
    sums = pairs.groupBy("home", "away").agg(F.sum("n").alias("n"), *[(F.sum(f"sum_{k}") / F.sum("n")).alias(f"{k}_p") for k in KINDS])
    return matches.join(entity.stored(sums), ["home", "away"]).select("pos", "n", *[f"{k}_p" for k in KINDS])


def stored_or_computed(wanted: DataFrame, stored: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of each wanted key: the stored row whole, else the computed one; ``is_stored`` tells which."""
    rest = [c for c in stored.columns if c not in keys]
    first = stored.select(*keys, F.struct(*rest).alias("s"))
    second = computed.select(*keys, F.struct(*rest).alias("c"))
    joined = wanted.join(first, keys, "left").join(second, keys, "left")
    return joined.select(*wanted.columns, F.col("s").isNotNull().alias("is_stored"), F.coalesce("s", "c").alias("x")).select(*wanted.columns, "is_stored", "x.*")


def pipeline_scores(matches: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    """Ensemble, edges and recommendation of matches that are to be played, by the odds of their teams.

    matches: pos, home, away; events: id, home, away and odds; scores: match_id,
    model and probabilities. Edges need an odds event; the models' odds are
    ``DEFAULT_ODDS`` without one.
    """
    first = entity.first_of_pairs(matches, events.withColumnRenamed("id", "pos")).select("home", "away", F.col("pos").alias("event"))
    # The odds of the few first events are joined to the pairs before these are joined to the matches.
    first = entity.stored(first.join(events.select(F.col("id").alias("event"), *[f"{k}_odds" for k in KINDS]), "event", "left"))
    priced = matches.join(first, ["home", "away"], "left").select("event", "pos", *[f"{k}_odds" for k in KINDS])
    n = scores.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    mean = models.ensemble(scores).join(n, "match_id").select("match_id", "n", *[X.settled(F.col(f"{k}_p")).alias(f"{k}_p") for k in KINDS])
    out = priced.join(mean, F.col("pos") == F.col("match_id"))
    odds = [F.when(F.col("event").isNotNull(), F.col(f"{k}_odds")).otherwise(DEFAULT_ODDS[k]) for k in KINDS]
    edges = [F.when(F.col("event").isNotNull(), X.edge(F.col(f"{k}_p"), X.fair_probability(F.col(f"{k}_odds"), *[F.col(f"{x}_odds") for x in KINDS]))).alias(f"edge_{k}") for k in KINDS]
    out = out.select("match_id", "n", F.col("event").isNotNull().alias("has_odds"), *[f"{k}_p" for k in KINDS], *[o.alias(f"{k}_used") for k, o in zip(KINDS, odds, strict=True)], *edges)
    p, e = [F.col(f"{k}_p") for k in KINDS], [F.col(f"edge_{k}") for k in KINDS]
    return out.select(
        "*", X.argmax_outcome(*p).alias("outcome"), F.greatest(*p).alias("confidence"), F.when(e[0].isNotNull(), X.recommended(*p, *e)).alias("recommended"),
        F.concat(F.lit("ensemble_v1_"), F.col("n").cast("string"), F.lit("models")).alias("model_version"),
    )


def consensus_by_names(ai: DataFrame, ml: DataFrame) -> DataFrame:
    """Full outer merge of two consensus tables on the key of their team names, with the list of sources and its agreement.

    ai and ml: home, away, prediction, confidence; one row per key counts, the
    one of greatest confidence, then prediction.
    """
    def side(df: DataFrame, name: str, tag: str) -> DataFrame:
        key = N.match_key(N.bookmaker_name(F.col("home")), N.bookmaker_name(F.col("away")))
        entry = F.struct(F.col("confidence"), F.col("prediction"), F.lit(name).alias("name"))
        # The best row of each pair of names first, so that names are normalised for distinct pairs only.
        pairs = entity.stored(df.groupBy("home", "away").agg(F.max(entry).alias("e")))
        return pairs.select(key.alias("key"), "e").where(F.col("key").isNotNull()).groupBy("key").agg(F.max("e").alias(tag))

    joined = side(ai, "AI Sites", "ai").join(side(ml, "ML Ensemble", "ml"), "key", "full_outer")
    out = joined.select("key", F.array_compact(F.array("ai", "ml")).alias("sources"))
    votes = F.filter(F.transform("sources", lambda s: s["prediction"]), lambda p: p.isNotNull())
    out = out.select("key", "sources", votes.alias("votes"))
    same = (F.size("votes") == 2) & (F.get("votes", F.lit(0)) == F.get("votes", F.lit(1)))
    level = F.when(same, 2).when(F.size("votes") > 0, 1).otherwise(0)
    agreed = F.when(same | (F.size("votes") == 1), F.get("votes", F.lit(0)))
    return out.select("key", F.array_join(F.transform("sources", lambda s: s["name"]), ",").alias("sources"), level.cast("long").alias("agreement_level"), agreed.alias("agreed_outcome"), F.coalesce(same, F.lit(False)).alias("all_agree"))
