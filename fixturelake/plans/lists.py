"""Queries of lookups, ordered lists, store updates, totals and scalar forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.functions import scalars as X
from fixturelake.operators import boosting, consensus, coupon, evaluate, merge, models, serving, stats
from fixturelake.operators.features import FEATURES
from fixturelake.plans import views as V
from fixturelake.plans.catalogue import _MC, _P_ORDER, _SC, _VALUE, _VE, CONS, COUPON, ENSEMBLE, LIVE, PROBS, _coupon, _merged, _newest, _scored, _verified, query
from fixturelake.sources import csv, html
from fixturelake.streaming import live

C = F.col
H, A = (V.club_sql(t, 0) for t in ("home_team", "away_team"))


# Lookups


@query(V.sql("select match_id, league_code, home_team, away_team from m where status = 'FINISHED' and match_id % 3 <> 0", V.M))
def finished_without_result(spark, d):
    m = V.matches(spark, d)
    return serving.without_result(m, m.where("match_id % 3 = 0")).select("match_id", "league_code", "home_team", "away_team")


@query(V.sql(f"select match_id, {A} away, status from m where {H} in ('Arsenal', 'FC Porto')", V.M))
def matches_of_teams(spark, d):
    """Documents of two keys."""
    return serving.by_key(V.named(spark, d), "home", "Arsenal", "FC Porto").select("match_id", "away", "status")


@query(V.sql("select match_id, match_date from m where match_date >= timestamp '1995-05-01 12:00:00' and match_date < timestamp '1995-06-01 00:00:00'", V.M))
def kickoff_range(spark, d):
    return serving.in_kickoff_range(V.matches(spark, d), "1995-05-01 12:00:00", "1995-06-01").select("match_id", "match_date")


def _model_rows(spark, d) -> DataFrame:
    """Latest predictions of three sources in the place of models, with outcome, confidence and the match's day."""
    p = consensus.with_probabilities(V.predictions(spark, d)).where(C("source").isin("S0", "S1", "S2"))
    latest = merge.first_per_key(p, ["match_id", "source"], *_newest())
    name = F.when(C("source") == "S0", "gbt").when(C("source") == "S1", "mlp").otherwise("forest")
    return latest.select("match_id", name.alias("model"), "home_p", "draw_p", "away_p")


_MODELS = f"""lr as (select match_id, case source when 'S0' then 'gbt' when 'S1' then 'mlp' else 'forest' end model, home_p, draw_p, away_p,
  case when home_p = greatest(home_p, draw_p, away_p) then 'HOME' when draw_p = greatest(home_p, draw_p, away_p) then 'DRAW' else 'AWAY' end outcome, greatest(home_p, draw_p, away_p) confidence
  from pp where source in ('S0', 'S1', 'S2') qualify row_number() over (partition by match_id, source order by {_P_ORDER}) = 1)"""


@query(V.sql("select match_id, model, outcome, confidence from lr join m using (match_id) where match_date >= date '1995-03-15' and match_date < date '1995-03-16'", V.M, V.P, PROBS, _MODELS))
def predictions_of_day(spark, d):
    """Predictions of one day, the most confident first."""
    rows = models.decided(_model_rows(spark, d)).join(V.matches(spark, d).select("match_id", "match_date"), "match_id")
    return serving.todays_predictions(rows, "1995-03-15").select("match_id", "model", "outcome", "confidence")


@query(V.sql("select match_id, outcome, confidence from lr where model = 'mlp'", V.P, PROBS, _MODELS))
def ensemble_rows(spark, d):
    """Rows of one model, which stands for the ensemble, out of all models' rows."""
    return serving.ensemble_rows(models.decided(_model_rows(spark, d)), "mlp").select("match_id", "outcome", "confidence")


@query(V.sql("select match_id, model, outcome, confidence from lr qualify row_number() over (partition by match_id order by model = 'gbt' desc, confidence desc, model desc) = 1", V.P, PROBS, _MODELS))
def best_prediction(spark, d):
    """The preferred model's prediction of each match, else the most confident one."""
    return models.best_per_match(models.decided(_model_rows(spark, d)), "gbt")


@query(V.sql("select day from ck group by day having bool_or(status <> 'FINISHED')", *_SC, COUPON))
def pending_coupons(spark, d):
    results = stats.finished(V.matches(spark, d)).select("match_id", X.outcome_of_score(C("home_score"), C("away_score")).alias("actual"))
    return serving.pending(coupon.settle(_coupon(spark, d), results)).select("day")


# Ordered lists


@query(V.sql("select match_id, league_code, match_date from m where match_date >= date '1995-03-15' and match_date < date '1995-03-16'", V.M))
def matches_of_day_by_league(spark, d):
    return serving.of_day(V.matches(spark, d), "1995-03-15").select("match_id", "league_code", "match_date")


@query(V.sql("select match_id, source, outcome, actual, match_date from ve", *_VE))
def all_results_newest_first(spark, d):
    return serving.newest_results(_verified(spark, d)).select("match_id", "source", "outcome", "actual", "match_date")


@query(V.sql("""select match_id, num_sources, consensus_winner, row_number() over (order by num_sources desc, consensus_confidence desc nulls last, match_id) place from cw
 order by num_sources desc, consensus_confidence desc nulls last, match_id limit 80""", V.P, CONS))
def consensus_by_sources(spark, d):
    """The eighty matches with the most sources, then the greatest confidence."""
    rows = consensus.match_consensus(V.predictions(spark, d))
    return serving.top(rows, 80, F.desc("num_sources"), F.desc_nulls_last("consensus_confidence"), C("match_id")).select("match_id", "num_sources", "consensus_winner", "place")


_ODDS = "(select distinct match_id, true has_odds from o where home_odds > 0) e using (match_id)"


@query(V.sql(f"""select match_id, coalesce(has_odds, false) has_odds, agreement_level, all_agree, row_number() over (order by coalesce(has_odds, false) desc, agreement_level desc, all_agree desc, match_id) place
 from mc left join {_ODDS} order by coalesce(has_odds, false) desc, agreement_level desc, all_agree desc, match_id limit 200""", *_MC))
def combined_consensus_order(spark, d):
    """Matches with odds first, then by agreement."""
    marks = V.quotes(spark, d).where("home_odds > 0").select("match_id").distinct().withColumn("has_odds", F.lit(True))
    rows = _merged(spark, d).join(marks, "match_id", "left").withColumn("has_odds", F.coalesce("has_odds", F.lit(False)))
    return serving.top(rows, 200, F.desc("has_odds"), F.desc("agreement_level"), F.desc("all_agree"), C("match_id")).select("match_id", "has_odds", "agreement_level", "all_agree", "place")


@query(V.sql(f"select match_id, agreed_outcome, sources from mc join {_ODDS} where agreed_outcome is not null", *_MC))
def playable_consensus(spark, d):
    """The rows behind the count of playable matches."""
    return consensus.playable(_merged(spark, d), V.quotes(spark, d).where("home_odds > 0")).select("match_id", "agreed_outcome", "sources")


@query(V.sql(f"""select match_id, round({_VALUE}, 4) as value, case when {_VALUE} > 0.5 then 'high' when {_VALUE} > 0.2 then 'medium' else 'low' end tier, row_number() over (order by round({_VALUE}, 4) desc, match_id) place from sc
 where {_VALUE} > 0.05 order by round({_VALUE}, 4) desc, match_id limit 60""", *_SC))
def ranked_suggestions(spark, d):
    """Value bets with their rank, best first."""
    exact = X.value_rating(C("home_p"), C("draw_p"), C("away_p"), C("home_odds"), C("draw_odds"), C("away_odds"))
    rows = _scored(spark, d).withColumn("exact", exact).where("exact > 0.05").select("match_id", F.round("exact", 4).alias("value"), X.value_tier(C("exact")).alias("tier"))
    return serving.top(rows, 60, F.desc("value"), C("match_id"))


@query(V.sql("""select key, kind, total, correct, row_number() over (partition by kind order by correct / greatest(total, 1) desc, total desc, key) place from (
 select source as key, 'model' kind, count(*) total, count(*) filter (where outcome = actual) correct from ve group by 1 union all select league_code, 'league', count(*), count(*) filter (where outcome = actual) from ve group by 1)""", *_VE))
def ranked_by_ratio(spark, d):
    """Models and leagues by their share of hits."""
    rows = _verified(spark, d)
    ranked = [serving.by_ratio(evaluate.accuracy(rows, by).select(C(by).alias("key"), "total", "correct")).withColumn("kind", F.lit(kind)) for by, kind in (("source", "model"), ("league_code", "league"))]
    return ranked[0].unionByName(ranked[1]).select("key", "kind", "total", "correct", "place")


@query(V.sql("select match_id, source, scraped_at, place from (select *, row_number() over (order by match_date desc, match_id desc, source, scraped_at, confidence) place from ve) where place <= 50", *_VE))
def recent_fifty(spark, d):
    """First fifty of the recent predictions."""
    rows = _verified(spark, d)
    return serving.top(rows, 50, F.desc("match_date"), F.desc("match_id"), C("source"), C("scraped_at"), C("confidence")).select("match_id", "source", "scraped_at", "place")


# Votes, lists and totals


@query(V.sql("""select match_id, case when count(*) filter (where g = 'Over') > count(*) filter (where g in ('Over', 'Under')) / 2e0 then 'Over' when count(*) filter (where g in ('Over', 'Under')) > 0 then 'Under' end vote,
 count(*) filter (where g in ('Over', 'Under')) votes from (select match_id, case when draw_w > 13 then 'Over' when draw_w > 9 then 'Under' when draw_w > 7 then '-' end g from p) group by match_id""", V.P))
def over_under_vote(spark, d):
    """Majority of over and under; other and missing votes don't count."""
    g = F.when(C("draw_w") > 13, "Over").when(C("draw_w") > 9, "Under").when(C("draw_w") > 7, "-")
    return consensus.majority_vote(V.predictions(spark, d).withColumn("goals", g), "goals", "Over", "Under")


@query(V.sql("select match_id, string_agg(source || ':' || tip, ',' order by source, scraped_at, tip, home_w nulls first, draw_w, away_w) predictions from p group by match_id", V.P))
def prediction_lists(spark, d):
    """The predictions behind each consensus, in order of source and time."""
    rows = consensus.match_consensus(V.predictions(spark, d))
    return rows.select("match_id", F.array_join(F.transform("predictions", lambda p: F.concat(p["source"], F.lit(":"), p["tip"])), ",").alias("predictions"))


@query(V.sql("select case when home_score > away_score then 0e0 when home_score = away_score then 1e0 else 2e0 end label, count(*) n, (select count(*) from f) / (3e0 * count(*)) weight from f group by 1", V.M, V.F_))
def class_distribution(spark, d):
    """Rows of each label and the weights that balance them."""
    label = F.when(C("home_score") > C("away_score"), 0.0).when(C("home_score") == C("away_score"), 1.0).otherwise(2.0)
    counts = models.class_counts(stats.finished(V.matches(spark, d)).select(label.alias("label")))
    return counts.join(models.weights_of(counts), "label")


@query(V.sql(f"""select (select count(*) from m) matches, (select count(*) from p) predictions, (select count(*) from m where status in ('IN_PLAY', 'PAUSED', 'HALFTIME', 'LIVE')) live,
 (select count(distinct league_code) from m) leagues, (select count(*) from sc where {_VALUE} > 0.05) value_bets""", *_SC))
def dashboard_totals(spark, d):
    """One row of totals over matches, predictions and value bets."""
    exact = X.value_rating(C("home_p"), C("draw_p"), C("away_p"), C("home_odds"), C("draw_odds"), C("away_odds"))
    parts = [
        V.matches(spark, d).agg(F.count(F.lit(1)).alias("matches"), F.count_if(C("status").isin(*LIVE)).alias("live"), F.count_distinct("league_code").alias("leagues")),
        V.predictions(spark, d).agg(F.count(F.lit(1)).alias("predictions")), _scored(spark, d).agg(F.count_if(exact > 0.05).alias("value_bets")),
    ]
    one = F.lit(1).alias("one")
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(F.broadcast(p.select("*", one)), "one")  # one row each
    return out.select("matches", "predictions", "live", "leagues", "value_bets")


@query(V.sql("""select match_id, case when home_p = greatest(home_p, draw_p, away_p) then 'HOME' when draw_p = greatest(home_p, draw_p, away_p) then 'DRAW' else 'AWAY' end outcome, model from (
 select match_id, 'ensemble' model, cast(sum(cast(home_p * w as decimal(20,15))) as double) / cast(sum(cast(w as decimal(20,15))) as double) home_p, cast(sum(cast(draw_p * w as decimal(20,15))) as double) / cast(sum(cast(w as decimal(20,15))) as double) draw_p,
  cast(sum(cast(away_p * w as decimal(20,15))) as double) / cast(sum(cast(w as decimal(20,15))) as double) away_p from (select match_id, home_p, draw_p, away_p, cast(w as double) w from mw) group by match_id)""", V.P, PROBS, ENSEMBLE))
def ensemble_outcomes(spark, d):
    """Outcome of the weighted ensemble of three sources that stand for the models."""
    p = consensus.with_probabilities(V.predictions(spark, d)).where(C("source").isin("S0", "S1", "S2"))
    name = F.when(C("source") == "S0", "gbt").when(C("source") == "S1", "mlp").otherwise("forest")
    return models.decided(models.ensemble(p.select("match_id", name.alias("model"), "home_p", "draw_p", "away_p"))).select("match_id", "outcome", "model")


# Store updates


@query(V.sql("""select match_id, tip, scraped_at from p where source = 'S0' and match_id not in (select match_id from p where source = 'S1') union all
 select match_id, tip, scraped_at from (select match_id, tip, scraped_at from p where source = 'S1' qualify row_number() over (partition by match_id order by scraped_at desc, tip desc) = 1)""", V.P))
def replaced_documents(spark, d):
    """Whole documents replaced by key, the newest of the new ones."""
    p = V.predictions(spark, d).select("match_id", "source", "tip", "scraped_at")
    return merge.replace_documents(p.where("source = 'S0'").drop("source"), p.where("source = 'S1'").drop("source"), ["match_id"], F.desc("scraped_at"), F.desc("tip"))


@query(V.sql("""select match_id, tip from p where source = 'S0' union all select match_id, tip from p where source = 'S2' and match_id not in (select match_id from p where source = 'S0')""", V.P))
def appended_unseen(spark, d):
    """Rows of a second source for matches that the first one lacks."""
    p = V.predictions(spark, d).select("match_id", "source", "tip")
    return merge.append_unseen(p.where("source = 'S0'").drop("source"), p.where("source = 'S2'").drop("source"), ["match_id"])


_COUPONS = """cs as (select day, case when bool_or(status <> 'FINISHED') then 'pending' when bool_and(pick = case when home_score > away_score then 'HOME' when home_score = away_score then 'DRAW' else 'AWAY' end) then 'won' else 'lost' end status,
 count(*) picks from ck group by day)"""


@query(V.sql("""select day, case when status <> 'pending' then status else 'pending' end status, case when status = 'pending' then 99 else picks end picks from cs
 union all select cast(day + interval 50 years as date), 'pending', 99 from cs""", *_SC, COUPON, _COUPONS))
def saved_coupons(spark, d):
    """New coupons replace pending ones of their day, are added for new days, and leave settled ones alone."""
    stored = _stored_coupons(spark, d)
    new = stored.select("day", F.lit("pending").alias("status"), F.lit(99).cast("long").alias("picks"))
    return merge.save_coupons(stored, new.unionByName(new.withColumn("day", F.add_months("day", 600))))


def _stored_coupons(spark, d) -> DataFrame:
    picks = _coupon(spark, d)
    results = stats.finished(V.matches(spark, d)).select("match_id", X.outcome_of_score(C("home_score"), C("away_score")).alias("actual"))
    return coupon.settle(picks, results).select("day", "status").join(picks.groupBy("day").agg(F.count(F.lit(1)).alias("picks")), "day")


@query(V.sql("select day, case when dayofmonth(day) % 2 = 0 then 'closed' else status end status, case when dayofmonth(day) % 2 = 0 then 'x' else cast(picks as varchar) end pick_results from cs", *_SC, COUPON, _COUPONS))
def coupons_with_status(spark, d):
    """Status and results written onto stored coupons only."""
    stored = _stored_coupons(spark, d).select("day", "status", C("picks").cast("string").alias("pick_results"))
    even = stored.where(F.dayofmonth("day") % 2 == 0).select("day", F.lit("closed").alias("status"), F.lit("x").alias("pick_results"))
    strangers = even.withColumn("day", F.add_months("day", 600))
    return merge.set_status(stored, even.unionByName(strangers))


@query(V.sql("""select match_id, source, tip from p where cast(scraped_at as date) + interval 40 days > timestamp '1995-06-01 00:00:00'
 qualify row_number() over (partition by match_id, source order by scraped_at desc, tip desc) = 1""", V.P))
def fresh_captures(spark, d):
    """Captures that are not expired, the newest of each key; expired ones are purged first."""
    now = F.lit("1995-06-01 00:00:00").cast("timestamp")
    p = V.predictions(spark, d).select("match_id", "source", "tip", C("scraped_at").alias("captured_at"), (F.to_date("scraped_at") + F.expr("interval 40 days")).cast("timestamp").alias("expires_at"))
    p = p.withColumn("captured_at", F.struct("captured_at", "tip"))
    return merge.fresh(merge.purged(p, now), now, ["match_id", "source"]).select("match_id", "source", "tip")


# Keys and scalar forms


@query(V.sql(f"""select strftime(match_date, '%Y-%m-%d') || '_' || ([{', '.join(repr(x) for x in ('paris_saint_germain', 'tottenham_hotspur', 'olympique_de_marseille', 'bayern_munich', 'manchester', 'arsenal', 'wolverhampton_wanderers', 'borussia_monchengladbach', 'inter_milan', 'nottingham_forest', 'ssc_napoli', 'de_madrid', 'celta_de_vigo', 'bayer_leverkusen', 'freiburg', 'ajax', 'psv_eindhoven', 'sl_benfica', 'porto', 'az_alkmaar'))}])[home_team + 1]
 || '_' || ([{', '.join(repr(x) for x in ('paris_saint_germain', 'tottenham_hotspur', 'olympique_de_marseille', 'bayern_munich', 'manchester', 'arsenal', 'wolverhampton_wanderers', 'borussia_monchengladbach', 'inter_milan', 'nottingham_forest', 'ssc_napoli', 'de_madrid', 'celta_de_vigo', 'bayer_leverkusen', 'freiburg', 'ajax', 'psv_eindhoven', 'sl_benfica', 'porto', 'az_alkmaar'))}])[away_team + 1] doc_id, min(match_id) match_id from m group by 1""", V.M))
def match_documents(spark, d):
    """One match per deterministic id of day and teams, the first by number."""
    m = V.named(spark, d).withColumn("doc_id", N.match_id(C("match_date"), C("home"), C("away")))
    return merge.first_per_key(m, ["doc_id"], C("match_id")).select("doc_id", "match_id")


@query(V.sql(f"""select {H} home, {A} away, cast(match_date as date) as day, min(priority * 100000000 + match_id) % 100000000 match_id, min(priority) priority from (
 select *, case when status = 'IN_PLAY' then 0 else 1 end priority from m) group by 1, 2, 3""", V.M))
def distinct_pairs_of_day(spark, d):
    """One match per pair of names and day out of two feeds, the live one first."""
    m = V.named(spark, d)
    both = merge.union_by_priority(m.where("status = 'IN_PLAY'"), m.where("status <> 'IN_PLAY'")).withColumn("day", F.to_date("match_date"))
    return merge.first_per_key(both, ["home", "away", "day"], C("priority"), C("match_id")).select("home", "away", "day", "match_id", C("priority").cast("long").alias("priority"))


@query(V.sql("""select match_id, cast(season as int) season_a, cast(season as int) season_b, cast(season as int) season_c, cast(home_score as int) as whole, cast(null as int) no_whole, round(home_score + 0.25, 2) decimal_odds,
 case when home_score > 0 then home_score + 0.0 when away_score > 0 then away_score + 0.5 else 9.9 end first_odds, case when match_id % 6 = 0 then 'FINISHED' when match_id % 6 = 1 then 'HALFTIME' when match_id % 6 = 2 then 'POSTPONED'
  when match_id % 6 = 3 then 'SUSPENDED' when match_id % 6 = 4 then 'CANCELLED' else 'Strange' end status, case when match_id % 101 >= 50 then 'green' when match_id % 101 >= 35 then 'yellow' else 'red' end tier,
 round(100 / greatest(match_id % 101, 1), 2) price, 'as-roma-fc-' || cast(match_id as varchar) slug from m""", V.M))
def scalar_forms(spark, d):
    """Seasons, lenient numbers, first odds, status codes, tiers, price and slug of texts made from the matches."""
    m = V.matches(spark, d)
    text = lambda c: C(c).cast("string")
    code = F.element_at(F.array(*[F.lit(x) for x in ("AET", "HT", "PST", "INT", "CANC", "Strange")]), (C("match_id") % 6).cast("int") + 1)
    share = (C("match_id") % 101).cast("double")
    return m.select(
        "match_id", X.season_start(F.concat(text("season"), F.lit("-"), (C("season") + 1).cast("string"))).alias("season_a"), X.season_start(F.concat(text("season"), F.lit("-08-16"))).alias("season_b"),
        X.season_start(text("season")).alias("season_c"), X.lenient_int(F.concat(F.lit(" "), text("home_score"), F.lit(".0 "))).alias("whole"), X.lenient_int(F.lit("n/a")).alias("no_whole"),
        X.lenient_float(F.concat(text("home_score"), F.lit(".25"))).alias("decimal_odds"), X.first_nonzero(C("home_score").cast("double"), F.when(C("away_score") > 0, C("away_score") + 0.5).otherwise(0.0), F.lit(9.9)).alias("first_odds"),
        X.normal_status(code).alias("status"), X.accuracy_tier(share).alias("tier"), X.price_from_probability(share / 100).alias("price"), X.slug(F.concat(F.lit("A.S. Roma FC "), text("match_id"))).alias("slug"),
    )


@query(V.sql("""select match_id, case when len(x) > 0 then array_to_string(x, ' | ') end as text from (select match_id, list_filter([
 case when ho > 0 and hp * ho > 1.05 then '💚 ' || h || ' VALUE (EV: ' || printf('%.2f', floor(hp * ho * 100 + 0.5000001) / 100) || ')' end, case when do_ > 0 and dp * do_ > 1.10 then '🟡 Draw VALUE (EV: ' || printf('%.2f', floor(dp * do_ * 100 + 0.5000001) / 100) || ')' end,
 case when ao > 0 and ap * ao > 1.05 then '💚 ' || a || ' VALUE (EV: ' || printf('%.2f', floor(ap * ao * 100 + 0.5000001) / 100) || ')' end], lambda v: v is not null) x from (
  select match_id, avg_home / 100 hp, coalesce(avg_draw, 0) / 100 dp, avg_away / 100 ap, 4e0 ho, 9e0 do_, 35e-1 ao, 'H' h, 'A' a from co where avg_home > 1 and avg_away > 1))""", V.P, CONS))
def consensus_value_text(spark, d):
    """Value parts of each consensus at fixed prices; percentages are brought to fractions."""
    co = consensus.match_consensus(V.predictions(spark, d)).where("avg_home > 1 and avg_away > 1")
    return co.select("match_id", X.consensus_value_text(C("avg_home"), C("avg_draw"), C("avg_away"), F.lit(4.0), F.lit(9.0), F.lit(3.5), F.lit("H"), F.lit("A")).alias("text"))


@query(V.sql("""select match_id, ('0x' || substr(md5(length(cast(match_id as varchar))::varchar || ':' || cast(match_id as varchar) || '2:' || league_code), 1, 15))::bigint as id from f""", V.M, V.F_))
def surrogate_ids(spark, d):
    """Stable ids of all finished matches."""
    return stats.finished(V.matches(spark, d)).select("match_id", X.surrogate_id(C("match_id"), C("league_code")).alias("id"))


@query(V.sql(f"""select mc.match_id, case when agreed_outcome is null then 'open' when e.match_id is not null then 'playable' else 'agreed' end as section, agreed_outcome from mc
 left join (select distinct match_id from o where home_odds > 0) e using (match_id)""", *_MC))
def consensus_sections(spark, d):
    """The consensus page's three groups, all rows: agreed with odds, agreed without, and without agreement."""
    return consensus.sections(_merged(spark, d), V.quotes(spark, d).where("home_odds > 0")).select("match_id", "section", "agreed_outcome")


@query("""select page_id, length(t) as n_text, sha256(t) as text_sha256 from (select page_id,
 'x' || chr(233) || chr(8364) || '&' || chr(160) || cast(page_id as varchar) || chr(65 + cast(page_id % 26 as int)) || '&#x;' || chr(233) as t from pages)""")
def page_entities(spark, d):
    """Numeric and named entities in the text of each page's note: decimal, hexadecimal, named, and one that is none."""
    letter = F.concat(F.lit("&#x"), F.hex(65 + C("page_id") % 26), F.lit(";"))
    note = F.concat(F.lit("<i>x</i>&#233;&euro;&amp;&#xA0;"), C("page_id").cast("string"), letter, F.lit("&#x;&eacute;"))
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", html.unescape(F.regexp_replace(note, "<[^>]+>", "")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_text"), F.sha2("t", 256).alias("text_sha256"))


def _season_files(spark, d) -> str:
    """Season files of every league, written from the matches: one file per league and season, named as such."""
    m = stats.finished(V.named(spark, d))
    code = F.concat(F.lpad((C("season") % 100).cast("string"), 2, "0"), F.lpad(((C("season") + 1) % 100).cast("string"), 2, "0"))
    rows = m.select(
        C("league_code"), code.alias("season_code"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.date_format("match_date", "HH:mm").alias("Time"), C("home").alias("HomeTeam"), C("away").alias("AwayTeam"),
        C("home_score").cast("string").alias("FTHG"), C("away_score").cast("string").alias("FTAG"), C("match_id").cast("string").alias("Referee"),
    )
    path = live.job_path(spark, "seasons")
    rows.write.partitionBy("league_code", "season_code").option("header", True).csv(path)
    return path


@query(V.sql("select match_id, league_code, 2000 + season % 100 as season, home_score, away_score from f where league_code in ('L1', 'L3') and season between 1996 and 1998", V.M, V.F_))
def several_seasons(spark, d):
    """Three seasons of two leagues out of files of all; other folders are not read. A code of two digits is a year after 2000."""
    out = csv.read_season_folders(spark, _season_files(spark, d)).where(C("league_code").isin("L1", "L3") & C("season_code").isin("9697", "9798", "9899"))
    found = csv.normalise(out)
    return found.select(C("referee").cast("long").alias("match_id"), "league_code", C("season").cast("long").alias("season"), C("home_score").cast("long").alias("home_score"), C("away_score").cast("long").alias("away_score"))


@query(V.sql("select match_id, source, cast(scraped_at as date) as day, tip from p", V.P))
def appended_predictions(spark, d):
    """Predictions appended to a store by day in two runs and read back."""
    p = V.predictions(spark, d).withColumn("day", F.to_date("scraped_at"))
    path = live.job_path(spark, "appended")
    odd = C("match_id") % 2 == 1
    for part in (p.where(odd), p.where(~odd)):
        merge.append(part.select("match_id", "source", "tip", F.date_format("day", "yyyy").alias("year"), "day"), path, ["year"])
    return spark.read.parquet(path).select("match_id", "source", "day", "tip")


_RATED = f"""rated as (select model, count(*) total, count(*) filter (where outcome = actual) correct from (select lr.*, case when home_score > away_score then 'HOME' when home_score = away_score then 'DRAW' else 'AWAY' end actual
 from lr join f using (match_id)) group by model)"""


@query(V.sql("select model, total, correct, correct / cast(total as double) accuracy, row_number() over (order by correct / cast(total as double) desc, model) place from rated", V.M, V.F_, V.P, PROBS, _MODELS, _RATED))
def models_by_accuracy(spark, d):
    """Comparison of the models, which three sources stand for, on all finished matches, best first."""
    m = stats.finished(V.matches(spark, d))
    label = F.when(C("home_score") > C("away_score"), 0).when(C("home_score") == C("away_score"), 1).otherwise(2)
    out = models.accuracy_by_model(_model_rows(spark, d), m.select("match_id", label.alias("label")))
    return serving.by_ratio(out).select("model", "total", "correct", "accuracy", "place")


@query(V.sql("""select b.match_id, round(n0 / t, 6) home_p, round(n1 / t, 6) draw_p, round(n2 / t, 6) away_p from f b, (select count(*) filter (where home_score > away_score) / 1e0 n0, count(*) filter (where home_score = away_score) / 1e0 n1,
 count(*) filter (where home_score < away_score) / 1e0 n2, count(*) / 1e0 t from f)""", V.M, V.F_))
def stored_model(spark, d):
    """A boosted model without a usable feature, stored, loaded and applied: with weights of one it gives the classes' shares."""
    m = stats.finished(V.matches(spark, d))
    label = F.when(C("home_score") > C("away_score"), 0).when(C("home_score") == C("away_score"), 1).otherwise(2)
    rows = m.select("match_id", label.alias("label"), F.lit(1.0).alias("weight"), *[F.lit(0.0).alias(c) for c in FEATURES])
    path = live.job_path(spark, "model")
    models.save({"gbt": boosting.fit(rows, FEATURES, boosting.Settings(rounds=30, share=1.0, rate=1.0))}, path)
    loaded = models.load(["gbt"], path)["gbt"]
    return models.probabilities(loaded, rows, "gbt").select("match_id", *[F.round(f"{k}_p", 6).alias(f"{k}_p") for k in ("home", "draw", "away")])
