"""All queries over the driver tables, with the SQL that must give the same rows.

Each query runs library operators on the match-shaped views of ``views``; the
SQL states the same result independently for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.functions import scalars as X
from fixturelake.operators import consensus, coupon, entity, evaluate, features, merge, models, odds, stats
from fixturelake.plans import views as V
from fixturelake.sources import csv, delimited, html, json_feeds
from fixturelake.streaming import live

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _r(*columns: str, digits: int = 6) -> list:
    """Rounded columns, as the last step."""
    return [F.round(c, digits).alias(c) for c in columns]


COUNTERS = """count(*) matches_played, count(*) filter (where gf > ga) wins, count(*) filter (where gf = ga) draws, count(*) filter (where gf < ga) losses,
 count(*) filter (where is_home and gf > ga) home_wins, count(*) filter (where is_home and gf = ga) home_draws, count(*) filter (where is_home and gf < ga) home_losses,
 count(*) filter (where not is_home and gf > ga) away_wins, count(*) filter (where not is_home and gf = ga) away_draws, count(*) filter (where not is_home and gf < ga) away_losses,
 cast(sum(gf) as bigint) goals_scored, cast(sum(ga) as bigint) goals_conceded,
 cast(coalesce(sum(gf) filter (where is_home), 0) as bigint) home_goals_scored, cast(coalesce(sum(ga) filter (where is_home), 0) as bigint) home_goals_conceded,
 cast(coalesce(sum(gf) filter (where not is_home), 0) as bigint) away_goals_scored, cast(coalesce(sum(ga) filter (where not is_home), 0) as bigint) away_goals_conceded,
 count(*) filter (where ga = 0) clean_sheets, avg(gf) avg_goals_scored, avg(ga) avg_goals_conceded"""
STATS = f"ts as (select team, league_code, season, {COUNTERS} from s group by team, league_code, season)"
_BASE = (V.M, V.F_, V.SIDES)


@query(V.sql("select * replace (round(avg_goals_scored, 6) as avg_goals_scored, round(avg_goals_conceded, 6) as avg_goals_conceded) from ts", *_BASE, STATS))
def team_season_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.team_season_stats(stats.sides(V.matches(spark, d)))
    return out.select(*[c for c in out.columns if not c.startswith("avg")], *_r("avg_goals_scored", "avg_goals_conceded"))


@query(V.sql("""select team, league_code, season, matches_played, 3 * wins + draws points, goals_scored - goals_conceded goal_difference, goals_scored,
 round((3 * wins + draws) / cast(matches_played as double), 6) points_per_game,
 rank() over (partition by league_code, season order by 3 * wins + draws desc, goals_scored - goals_conceded desc, goals_scored desc) as position from ts""", *_BASE, STATS))
def league_table(spark, d):
    out = stats.league_table(stats.team_season_stats(stats.sides(V.matches(spark, d))))
    return out.select(*[c for c in out.columns if c != "points_per_game"], *_r("points_per_game"))


@query(V.sql("""select count(*) n, round(case when count(*) >= 50 then avg(home_score) else 1.5 end, 6) avg_home_goals,
 round(case when count(*) >= 50 then avg(away_score) else 1.2 end, 6) avg_away_goals from
 (select *, row_number() over (partition by league_code order by match_date desc, match_id desc) rn from f) where rn <= 500""", V.M, V.F_))
def league_goal_averages(spark, d):
    return stats.goal_averages(V.matches(spark, d)).select("n", *_r("avg_home_goals", "avg_away_goals"))


FORM = """lf as (select {by}, string_agg(case when gf > ga then 'W' when gf = ga then 'D' else 'L' end, '' order by rn) form from
 (select *, row_number() over (partition by {by} order by match_date desc, match_id desc) rn from s) where rn <= 5 group by {by})"""


@query(V.sql("select t.team, coalesce(form, '-----') form from (select distinct home_team team from m union select distinct away_team from m) t left join lf using (team)", *_BASE, FORM.format(by="team")))
def team_form_last5(spark, d):
    m = V.matches(spark, d)
    teams = m.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return teams.join(stats.form(stats.sides(m)), "team", "left").withColumn("form", F.coalesce("form", F.lit("-----")))


@query(V.sql("select team, match_id, opponent, is_home, gf, ga, rn from (select *, row_number() over (partition by team order by match_date desc, match_id desc) rn from s) where rn <= 7", *_BASE))
def last_n_matches(spark, d):
    return stats.last_matches(stats.sides(V.matches(spark, d)), 7).select("team", "match_id", "opponent", "is_home", "gf", "ga", F.col("rn").cast("long").alias("rn"))


@query(V.sql("select team, league_code, season, matches_played, wins from ts qualify row_number() over (partition by team, league_code order by season desc) = 1", *_BASE, STATS))
def latest_season_stats(spark, d):
    out = stats.latest_season(stats.team_season_stats(stats.sides(V.matches(spark, d))))
    return out.select("team", "league_code", "season", "matches_played", "wins")


H2H = """hh as (select *, least(home_team, away_team) lo, greatest(home_team, away_team) hi from f),
 h10 as (select * from hh qualify row_number() over (partition by lo, hi order by match_date desc, match_id desc) <= 10),
 hs as (select lo team, hi opponent, case when home_team = lo then home_score else away_score end gf, case when home_team = lo then away_score else home_score end ga from h10
  union all select hi, lo, case when home_team = lo then away_score else home_score end, case when home_team = lo then home_score else away_score end from h10),
 h2h as (select team, opponent, count(*) meetings, avg(case when gf > ga then 1e0 else 0e0 end) h2h_home_wins, avg(case when gf = ga then 1e0 else 0e0 end) h2h_draws,
  avg(case when gf < ga then 1e0 else 0e0 end) h2h_away_wins, avg(gf) h2h_home_goals_avg, avg(ga) h2h_away_goals_avg from hs group by team, opponent)"""


@query(V.sql("""select team, opponent, meetings, round(h2h_home_wins, 6) h2h_home_wins, round(h2h_draws, 6) h2h_draws, round(h2h_away_wins, 6) h2h_away_wins,
 round(h2h_home_goals_avg, 6) h2h_home_goals_avg, round(h2h_away_goals_avg, 6) h2h_away_goals_avg from h2h""", V.M, V.F_, H2H))
def h2h_summary(spark, d):
    out = stats.head_to_head(V.matches(spark, d))
    return out.select("team", "opponent", "meetings", *_r(*[c for c in out.columns if c.startswith("h2h")]))


_W = "over (partition by team, league_code, season order by match_date range between unbounded preceding and interval 1 microsecond preceding)"


@query(V.sql(f"""select match_id, team, league_code, season, match_date, is_home, count(*) {_W} played_before, count(*) filter (where gf > ga) {_W} wins_before,
 count(*) filter (where gf = ga) {_W} draws_before, cast(sum(gf) {_W} as bigint) goals_before, cast(sum(ga) {_W} as bigint) conceded_before from s""", *_BASE))
def asof_team_stats(spark, d):
    return stats.stats_before_match(stats.sides(V.matches(spark, d)))


AVERAGE = f"""ao as (select match_id, count(distinct bookmaker) bookmakers, {", ".join(V.mean_sql(f"nullif({k}_odds, 0)") + f" avg_{k}" for k in ("home", "draw", "away"))},
 max(nullif(home_odds, 0)) best_home, max(nullif(draw_odds, 0)) best_draw, max(nullif(away_odds, 0)) best_away from o group by match_id)"""
FAIR = """fo as (select *, 1 / avg_home + 1 / avg_draw + 1 / avg_away overround, 1 / avg_home / (1 / avg_home + 1 / avg_draw + 1 / avg_away) fair_home,
 1 / avg_draw / (1 / avg_home + 1 / avg_draw + 1 / avg_away) fair_draw, 1 / avg_away / (1 / avg_home + 1 / avg_draw + 1 / avg_away) fair_away from ao)"""


@query(V.sql("""select match_id, bookmakers, round(avg_home, 6) avg_home, round(avg_draw, 6) avg_draw, round(avg_away, 6) avg_away,
 round(best_home, 6) best_home, round(best_draw, 6) best_draw, round(best_away, 6) best_away from ao""", V.O, AVERAGE))
def best_and_avg_odds(spark, d):
    out = odds.average_and_best(V.quotes(spark, d))
    return out.select("match_id", "bookmakers", *_r(*out.columns[2:]))


@query(V.sql("select match_id, round(overround, 6) overround, round(fair_home, 6) fair_home, round(fair_draw, 6) fair_draw, round(fair_away, 6) fair_away from fo", V.O, AVERAGE, FAIR))
def market_fair_probs(spark, d):
    out = odds.fair_probabilities(odds.average_and_best(V.quotes(spark, d)))
    return out.select("match_id", *_r("overround", "fair_home", "fair_draw", "fair_away"))


FIRST = """q1 as (select match_id, max(home_odds) home_odds, max(draw_odds) draw_odds, max(away_odds) away_odds from o where bookmaker = 'B1' group by match_id)"""


@query(V.sql("""select m.match_id, case when q1.home_odds > 0 and q1.draw_odds > 0 and q1.away_odds > 0 then 'primary' when avg_home is not null then 'average' end odds_source,
 round(case when q1.home_odds > 0 and q1.draw_odds > 0 and q1.away_odds > 0 then q1.home_odds else avg_home end, 6) home_odds,
 round(case when q1.home_odds > 0 and q1.draw_odds > 0 and q1.away_odds > 0 then q1.draw_odds else avg_draw end, 6) draw_odds,
 round(case when q1.home_odds > 0 and q1.draw_odds > 0 and q1.away_odds > 0 then q1.away_odds else avg_away end, 6) away_odds
 from m left join q1 using (match_id) left join ao using (match_id)""", V.M, V.O, AVERAGE, FIRST))
def odds_fallback(spark, d):
    q = V.quotes(spark, d)
    first = q.where(F.col("bookmaker") == "B1").groupBy("match_id").agg(*[F.max(f"{k}_odds").alias(f"{k}_odds") for k in ("home", "draw", "away")])
    out = odds.with_fallback(V.matches(spark, d), first, odds.average_and_best(q))
    return out.select("match_id", "odds_source", *_r("home_odds", "draw_odds", "away_odds"))


PROBS = """pp as (select *, case when coalesce(home_w, 0) + draw_w + away_w > 0 then coalesce(home_w, 0) / (coalesce(home_w, 0) + draw_w + away_w) else 0.33 end home_p,
 case when coalesce(home_w, 0) + draw_w + away_w > 0 then draw_w / (coalesce(home_w, 0) + draw_w + away_w) else 0.33 end draw_p,
 case when coalesce(home_w, 0) + draw_w + away_w > 0 then away_w / (coalesce(home_w, 0) + draw_w + away_w) else 0.34 end away_p from p)"""


@query(V.sql("select match_id, source, scraped_at, tip, round(home_p, 6) home_p, round(draw_p, 6) draw_p, round(away_p, 6) away_p from pp", V.P, PROBS))
def normalised_predictions(spark, d):
    return consensus.with_probabilities(V.predictions(spark, d)).select("match_id", "source", "scraped_at", "tip", *_r("home_p", "draw_p", "away_p"))


@query(V.sql("""select match_id, source, scraped_at, tip,
 round(case when home_w is not null then home_p else case tip when '1' then 0.55 when '2' then 0.20 else 0.30 end end, 6) home_p,
 round(case when home_w is not null then draw_p else case tip when '1' then 0.25 when '2' then 0.25 else 0.40 end end, 6) draw_p,
 round(case when home_w is not null then away_p else case tip when '1' then 0.20 when '2' then 0.55 else 0.30 end end, 6) away_p from pp""", V.P, PROBS))
def tip_fallback_probs(spark, d):
    return consensus.with_tip_fallback(V.predictions(spark, d)).select("match_id", "source", "scraped_at", "tip", *_r("home_p", "draw_p", "away_p"))


CONS = """co as (select match_id, string_agg(distinct source, ',' order by source) sources, count(distinct source) num_sources, avg(nullif(home_w, 0)) avg_home,
 avg(nullif(draw_w, 0)) avg_draw, avg(nullif(away_w, 0)) avg_away, case when count(*) filter (where btts = 'Yes') > count(*) / 2e0 then 'Yes' else 'No' end btts_consensus from p group by match_id),
 cw as (select *, case when avg_home is null or avg_away is null then null when avg_home = greatest(avg_home, coalesce(avg_draw, 0), avg_away) then 'HOME'
  when avg_away = greatest(avg_home, coalesce(avg_draw, 0), avg_away) then 'AWAY' else 'DRAW' end consensus_winner,
  case when avg_home is null or avg_away is null then null else greatest(avg_home, coalesce(avg_draw, 0), avg_away) end consensus_confidence from co)"""


@query(V.sql("""select match_id, sources, num_sources, round(avg_home, 6) avg_home, round(avg_draw, 6) avg_draw, round(avg_away, 6) avg_away, btts_consensus,
 consensus_winner, round(consensus_confidence, 6) consensus_confidence from cw""", V.P, CONS))
def match_consensus(spark, d):
    out = consensus.match_consensus(V.predictions(spark, d))
    return out.select("match_id", "sources", "num_sources", "btts_consensus", "consensus_winner", *_r("avg_home", "avg_draw", "avg_away", "consensus_confidence"))


@query(V.sql("select match_id, case when count(*) filter (where btts = 'Yes') > count(*) / 2e0 then 'Yes' else 'No' end vote, count(*) votes from p group by match_id", V.P))
def btts_vote(spark, d):
    return consensus.majority_vote(V.predictions(spark, d))


@query(V.sql("""select match_id, n agreement_level, case when n >= 2 or t = 1 then outcome end agreed_outcome, n = t and n >= 2 all_agree, cast(t as bigint) predictions from (
 select match_id, outcome, n, sum(n) over (partition by match_id) t, row_number() over (partition by match_id order by n desc, s, a, outcome) rn from (
  select match_id, case tip when '1' then 'HOME' when 'X' then 'DRAW' else 'AWAY' end outcome, count(*) n, arg_min(source, (source, scraped_at)) s, min(scraped_at) filter (where true) a0,
   min((source, scraped_at)) a from p group by 1, 2)) where rn = 1""", V.P))
def cross_source_agreement(spark, d):
    return consensus.source_agreement(V.predictions(spark, d))


VOTES = f"""vo as (select match_id, {V.mean_sql("home_p")} h, {V.mean_sql("draw_p")} d, {V.mean_sql("away_p")} a, count(*) ai_num_sources, greatest(
  count(*) filter (where home_p = greatest(home_p, draw_p, away_p)), count(*) filter (where home_p < greatest(home_p, draw_p, away_p) and away_p = greatest(home_p, draw_p, away_p)),
  count(*) filter (where home_p < greatest(home_p, draw_p, away_p) and away_p < greatest(home_p, draw_p, away_p))) / cast(count(*) as double) ai_agreement from pp group by match_id),
 vf as (select match_id, h / (h + d + a) ai_consensus_home, d / (h + d + a) ai_consensus_draw, a / (h + d + a) ai_consensus_away, ai_num_sources, ai_agreement from vo)"""


@query(V.sql("""select match_id, round(ai_consensus_home, 6) ai_consensus_home, round(ai_consensus_draw, 6) ai_consensus_draw, round(ai_consensus_away, 6) ai_consensus_away,
 ai_num_sources, round(ai_agreement, 6) ai_agreement from vf""", V.P, PROBS, VOTES))
def ai_vote_features(spark, d):
    out = consensus.ai_vote_features(consensus.with_probabilities(V.predictions(spark, d)))
    return out.select("match_id", "ai_num_sources", *_r("ai_consensus_home", "ai_consensus_draw", "ai_consensus_away", "ai_agreement"))


@query(V.sql(f"""select match_id, source_count, avg_home_p, avg_draw_p, avg_away_p, {", ".join(V.rounded_sql(f"std_{k}_p", 6) + f" std_{k}_p" for k in ("home", "draw", "away"))},
 spread_home, spread_draw, spread_away, avg_home_p - fair_home delta_home, avg_draw_p - fair_draw delta_draw, avg_away_p - fair_away delta_away,
 greatest(spread_home, spread_draw, spread_away) > 0.15 disagreement_flag from
 (select match_id, count(*) source_count, avg(home_p) avg_home_p, avg(draw_p) avg_draw_p, avg(away_p) avg_away_p, stddev_pop(home_p) std_home_p, stddev_pop(draw_p) std_draw_p, stddev_pop(away_p) std_away_p,
  max(home_p) - min(home_p) spread_home, max(draw_p) - min(draw_p) spread_draw, max(away_p) - min(away_p) spread_away from pp group by match_id having count(*) >= 2) x
 left join fo using (match_id)""", V.P, PROBS, V.O, AVERAGE, FAIR))
def disagreement_features(spark, d):
    """All columns; means and differences are compared as they are, since halves of a last digit round apart."""
    market = odds.fair_probabilities(odds.average_and_best(V.quotes(spark, d)))
    out = consensus.disagreement_features(consensus.with_probabilities(V.predictions(spark, d)), market)
    stds = [f"std_{k}_p" for k in ("home", "draw", "away")]
    return out.select(*[c for c in out.columns if c not in stds], *[X.rounded(F.col(c), 6).alias(c) for c in stds])


_P_ORDER = "scraped_at desc, home_w desc nulls last, draw_w desc, away_w desc, tip desc, btts desc"


def _newest(*last) -> list:
    return [F.desc("scraped_at"), F.desc_nulls_last("home_w"), F.desc("draw_w"), F.desc("away_w"), F.desc("tip"), F.desc("btts")]


@query(V.sql(f"select * from p qualify row_number() over (partition by match_id, source order by {_P_ORDER}) = 1", V.P))
def latest_prediction_per_source(spark, d):
    return merge.first_per_key(V.predictions(spark, d), ["match_id", "source"], *_newest())


@query(V.sql("select * from p qualify row_number() over (partition by match_id order by source, scraped_at, home_w nulls first, draw_w, away_w, tip, btts) = 1", V.P))
def first_seen_dedup(spark, d):
    order = ["source", "scraped_at", F.asc_nulls_first("home_w"), "draw_w", "away_w", "tip", "btts"]
    return merge.first_per_key(V.predictions(spark, d), ["match_id"], *[F.col(c) if isinstance(c, str) else c for c in order])


@query(V.sql(f"""select * from (select * from p where source <> 'S0' qualify row_number() over (partition by match_id order by {_P_ORDER}, source) = 1) x
 where match_id not in (select match_id from p where source = 'S0')""", V.P))
def insert_ignore(spark, d):
    p = V.predictions(spark, d)
    return merge.insert_ignore(p.where("source = 'S0'"), p.where("source <> 'S0'"), ["match_id"], *_newest(), F.col("source"))


SCORED = """sc as (select match_id, match_date, status, league_code, home_team, away_team, home_score, away_score, avg_home home_odds, avg_draw draw_odds, avg_away away_odds, fair_home, fair_draw, fair_away,
  ai_consensus_home home_p, ai_consensus_draw draw_p, ai_consensus_away away_p from m join vf using (match_id) join fo using (match_id))"""
_SC = (V.M, V.P, PROBS, VOTES, V.O, AVERAGE, FAIR, SCORED)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Matches with consensus probabilities, average odds and fair probabilities."""
    votes = consensus.ai_vote_features(consensus.with_probabilities(V.predictions(spark, d)))
    market = odds.fair_probabilities(odds.average_and_best(V.quotes(spark, d)))
    joined = V.matches(spark, d).join(votes, "match_id").join(market, "match_id")
    names = {"ai_consensus_home": "home_p", "ai_consensus_draw": "draw_p", "ai_consensus_away": "away_p", "avg_home": "home_odds", "avg_draw": "draw_odds", "avg_away": "away_odds"}
    return joined.withColumnsRenamed(names)


_BEST_EDGE = "case when eh = greatest(eh, ed, ea) then 'HOME' when ed = greatest(eh, ed, ea) then 'DRAW' else 'AWAY' end"


@query(V.sql(f"""select match_id, eh edge_home, ed edge_draw, ea edge_away, case when greatest(eh, ed, ea) > 0.03 and case {_BEST_EDGE} when 'HOME' then home_p when 'DRAW' then draw_p else away_p end > 0.5
 then {_BEST_EDGE} end recommended from (select *, round(home_p - fair_home, 4) eh, round(draw_p - fair_draw, 4) ed, round(away_p - fair_away, 4) ea from sc
 where fair_home is not null and fair_away is not null)""", *_SC))
def edge_and_recommendation(spark, d):
    s = _scored(spark, d).where(F.col("fair_home").isNotNull() & F.col("fair_away").isNotNull())
    for k in ("home", "draw", "away"):
        s = s.withColumn(f"edge_{k}", X.edge(F.col(f"{k}_p"), F.col(f"fair_{k}")))
    c = F.col
    return s.select("match_id", "edge_home", "edge_draw", "edge_away", X.recommended(c("home_p"), c("draw_p"), c("away_p"), c("edge_home"), c("edge_draw"), c("edge_away")).alias("recommended"))


_VALUE = "greatest(0e0, coalesce((home_p - 1 / home_odds) * home_odds, 0), coalesce((draw_p - 1 / draw_odds) * draw_odds, 0), coalesce((away_p - 1 / away_odds) * away_odds, 0))"


@query(V.sql(f"select match_id, {V.rounded_sql(_VALUE, 6)} value_rating, case when {_VALUE} > 0.5 then 'high' when {_VALUE} > 0.2 then 'medium' else 'low' end tier from sc where {_VALUE} > 0.05", *_SC))
def value_rating(spark, d):
    c = F.col
    value = X.value_rating(c("home_p"), c("draw_p"), c("away_p"), c("home_odds"), c("draw_odds"), c("away_odds"))
    out = _scored(spark, d).withColumn("value_rating", value).where(F.col("value_rating") > 0.05)
    return out.select("match_id", X.value_tier(F.col("value_rating")).alias("tier"), X.rounded(F.col("value_rating"), 6).alias("value_rating"))


def _sql_suggestion() -> str:
    name = lambda t: f"'T' || {t}"
    best = "case when home_p = greatest(home_p, draw_p, away_p) then {h} when draw_p = greatest(home_p, draw_p, away_p) then {d} else {a} end"
    mx = "greatest(home_p, draw_p, away_p)"
    pct = f"cast(cast(round({mx} * 100, 0) as int) as varchar) || '%'"
    high = f"case when {mx} > 0.6 then '🎯 HIGH CONFIDENCE: ' || {best.format(h=name('home_team') + chr(32) + chr(124)*2 + ' chr(32) || ' + repr('Win'), d=repr('Draw'), a=name('away_team') + ' || chr(32) || ' + repr('Win'))} || ' (' || {pct} || ')' end"
    bet = lambda p, o, who, ev, lp, mark: f"case when {o} > 0 and {p} * {o} > {ev} and {p} > {lp} then '{mark} VALUE: ' || {who} || ' @ ' || printf('%.2f', floor({o} * 100 + 0.5000001) / 100) || ' (EV: ' || printf('%.2f', floor({p} * {o} * 100 + 0.5000001) / 100) || ')' end"
    parts = ", ".join([high, bet("home_p", "home_odds", name("home_team") + " || ' to win'", 1.0, 0.4, "💚"), bet("draw_p", "draw_odds", "'Draw'", 1.1, 0.28, "🟡"), bet("away_p", "away_odds", name("away_team") + " || ' to win'", 1.0, 0.35, "💚")])
    lean = f"'📊 Lean: ' || {best.format(h=name('home_team'), d=repr('Draw'), a=name('away_team'))} || ' (' || {pct} || ')'"
    return f"select match_id, case when len(x) = 0 then {lean} else array_to_string(x[1:3], ' | ') end suggestion from (select *, list_filter([{parts}], lambda v: v is not null) x from sc)"


@query(V.sql(_sql_suggestion(), *_SC))
def suggestion_text(spark, d):
    c = F.col
    team = lambda t: F.concat(F.lit("T"), c(t).cast("string"))
    text = X.suggestion(c("home_p"), c("draw_p"), c("away_p"), c("home_odds"), c("draw_odds"), c("away_odds"), team("home_team"), team("away_team"), F.greatest("home_p", "draw_p", "away_p"))
    return _scored(spark, d).select("match_id", text.alias("suggestion"))


VERIFIED = """ve as (select pp.*, league_code, match_date, case tip when '1' then 'HOME' when 'X' then 'DRAW' else 'AWAY' end outcome, greatest(home_p, draw_p, away_p) confidence,
 case when home_score > away_score then 'HOME' when home_score = away_score then 'DRAW' else 'AWAY' end actual from pp join f using (match_id))"""
_VE = (V.M, V.F_, V.P, PROBS, VERIFIED)


def _verified(spark: SparkSession, d: str) -> DataFrame:
    p = consensus.with_probabilities(V.predictions(spark, d)).withColumn("outcome", X.normal_outcome(F.col("tip"))).withColumn("confidence", F.greatest("home_p", "draw_p", "away_p"))
    return evaluate.verified(p, V.matches(spark, d))


_ACC = "count(*) total, count(*) filter (where outcome = actual) correct, round(count(*) filter (where outcome = actual) / cast(count(*) as double), 6) accuracy, round(avg(confidence), 6) avg_confidence"


@query(V.sql(f"select source, {_ACC} from ve group by source", *_VE))
def accuracy_by_model(spark, d):
    return evaluate.accuracy(_verified(spark, d), "source").select("source", "total", "correct", *_r("accuracy", "avg_confidence"))


@query(V.sql(f"select league_code, {_ACC} from ve group by league_code", *_VE))
def accuracy_by_league(spark, d):
    return evaluate.accuracy(_verified(spark, d), "league_code").select("league_code", "total", "correct", *_r("accuracy", "avg_confidence"))


@query(V.sql("""select source, league_code, day, cast(level as bigint) as level, total, correct from (select source, league_code, cast(match_date as date) as day, grouping(source, league_code, cast(match_date as date)) as level,
 count(*) total, count(*) filter (where outcome = actual) correct from ve group by grouping sets ((), (source), (league_code), (cast(match_date as date))))""", *_VE))
def results_all_levels(spark, d):
    return evaluate.accuracy_all_levels(_verified(spark, d))


@query(V.sql("""select match_id, source, scraped_at, outcome, actual, outcome = actual hit, round(confidence, 6) confidence from ve
 order by match_date desc, match_id desc, source, scraped_at, confidence limit 100""", *_VE))
def recent_verified(spark, d):
    return evaluate.recent(_verified(spark, d)).select("match_id", "source", "scraped_at", "outcome", "actual", "hit", *_r("confidence"))


@query(V.sql("select cast(match_date as date) as day, count(*) total, count(*) filter (where outcome = actual) correct from ve group by 1 order by 1 desc limit 30", *_VE))
def results_by_day(spark, d):
    return evaluate.by_day(_verified(spark, d))


CARD = """ca as (select source, count(*) predictions, count(*) filter (where outcome = actual) correct, avg(case when outcome = actual then 1e0 else 0e0 end) accuracy,
 avg(power(home_p - case when actual = 'HOME' then 1 else 0 end, 2) + power(draw_p - case when actual = 'DRAW' then 1 else 0 end, 2) + power(away_p - case when actual = 'AWAY' then 1 else 0 end, 2)) brier_score,
 avg(-ln(greatest(case actual when 'HOME' then home_p when 'DRAW' then draw_p else away_p end, 1e-15))) log_loss,
 avg(case when outcome = actual then 1 / nullif(case outcome when 'HOME' then home_p when 'DRAW' then draw_p else away_p end, 0) - 1 else -1e0 end) roi_fair,
 avg(case when outcome = actual then case outcome when 'HOME' then avg_home when 'DRAW' then avg_draw else avg_away end - 1 else -1e0 end) roi_market
 from ve left join ao using (match_id) group by source having count(*) >= 3)"""


def _card(spark: SparkSession, d: str) -> DataFrame:
    market = odds.average_and_best(V.quotes(spark, d)).select("match_id", *[F.col(f"avg_{k}").alias(f"{k}_odds") for k in ("home", "draw", "away")])
    return evaluate.scorecard(_verified(spark, d).join(market, "match_id", "left"))


@query(V.sql("""select source, predictions, correct, round(accuracy, 6) accuracy, round(brier_score, 6) brier_score, round(log_loss, 6) log_loss, round(roi_fair, 6) roi_fair,
 round(roi_market, 6) roi_market from ca""", *_VE, V.O, AVERAGE, CARD))
def source_scorecard(spark, d):
    return _card(spark, d).select("source", "predictions", "correct", *_r("accuracy", "brier_score", "log_loss", "roi_fair", "roi_market"))


@query(V.sql("select source, round(greatest(1 - brier_score, 0.01) / sum(greatest(1 - brier_score, 0.01)) over (), 6) weight from ca", *_VE, V.O, AVERAGE, CARD))
def source_weights(spark, d):
    return evaluate.source_weights(_card(spark, d)).select("source", *_r("weight"))


@query(V.sql("""select round(avg(case when accuracy > 0 then accuracy end), 6) mean_accuracy, round(sum(correct) * 100 / cast(nullif(sum(predictions), 0) as double), 6) overall_percent from ca""", *_VE, V.O, AVERAGE, CARD))
def ensemble_accuracy(spark, d):
    return evaluate.ensemble_accuracy(evaluate.accuracy(_verified(spark, d), "source")).select(*_r("mean_accuracy", "overall_percent"))


_PICK = "case when home_p = greatest(home_p, draw_p, away_p) then 'HOME' when draw_p = greatest(home_p, draw_p, away_p) then 'DRAW' else 'AWAY' end"
COUPON = f"""cc as (select match_id, match_date, pick, case pick when 'HOME' then home_odds when 'DRAW' then draw_odds else away_odds end odds, greatest(home_p, draw_p, away_p) confidence,
  case pick when 'HOME' then home_p - fair_home when 'DRAW' then draw_p - fair_draw else away_p - fair_away end edge, status, home_score, away_score from (select *, {_PICK} pick from sc)),
 ck as (select *, cast(match_date as date) as day, row_number() over (partition by cast(match_date as date) order by confidence desc, edge desc nulls last, match_id) place from cc where odds > 1 qualify place <= 4)"""


def _coupon(spark: SparkSession, d: str) -> DataFrame:
    return coupon.top_picks(coupon.candidates(_scored(spark, d)))


@query(V.sql("select day, place, match_id, pick, round(odds, 6) odds, round(confidence, 6) confidence from ck", *_SC, COUPON))
def daily_coupon_top4(spark, d):
    return _coupon(spark, d).select("day", "place", "match_id", "pick", *_r("odds", "confidence"))


@query(V.sql(f"select day, count(*) picks, {V.rounded_sql('product(odds)', 6)} total_odds from ck group by day", *_SC, COUPON))
def coupon_total_odds(spark, d):
    return coupon.total_odds(_coupon(spark, d)).select("day", "picks", X.rounded(F.col("total_odds"), 6).alias("total_odds"))


@query(V.sql("""select day, case when bool_or(r = 'pending') then 'pending' when bool_and(r = 'won') then 'won' else 'lost' end status, string_agg(r, ',' order by place) pick_results from
 (select *, case when status <> 'FINISHED' then 'pending' when pick = case when home_score > away_score then 'HOME' when home_score = away_score then 'DRAW' else 'AWAY' end then 'won' else 'lost' end r from ck)
 group by day""", *_SC, COUPON))
def coupon_settlement(spark, d):
    results = stats.finished(V.matches(spark, d)).select("match_id", X.outcome_of_score(F.col("home_score"), F.col("away_score")).alias("actual"))
    return coupon.settle(_coupon(spark, d), results)


@query(V.sql("select match_id, league_code, home_team, away_team, status from m where match_date >= date '1995-03-15' and match_date < date '1995-03-16'", V.M))
def matches_on_date(spark, d):
    return json_feeds.select_matches(V.matches(spark, d), day="1995-03-15").select("match_id", "league_code", "home_team", "away_team", "status")


@query(V.sql("select match_id, match_date, home_team, away_team from m where match_date >= date '1996-01-01' and match_date < date '1996-01-09' and status = 'SCHEDULED'", V.M))
def upcoming(spark, d):
    return json_feeds.select_matches(V.matches(spark, d), start="1996-01-01", end="1996-01-08", status=("SCHEDULED",)).select("match_id", "match_date", "home_team", "away_team")


# Statuses of running matches.
LIVE = ("IN_PLAY", "PAUSED", "HALFTIME", "LIVE")


@query(V.sql("select match_id, status, home_score, away_score from m where status in ('IN_PLAY', 'PAUSED', 'HALFTIME', 'LIVE')", V.M))
def live_matches(spark, d):
    return json_feeds.select_matches(V.matches(spark, d), status=LIVE).select("match_id", "status", "home_score", "away_score")


@query(V.sql("select match_id, match_date, home_score, away_score from f where league_code = 'L1' and season = 1995 order by match_date desc, match_id desc limit 500", V.M, V.F_))
def finished_filter(spark, d):
    m = stats.finished(json_feeds.select_matches(V.matches(spark, d), league="L1", season=1995))
    return m.orderBy(F.desc("match_date"), F.desc("match_id")).limit(500).select("match_id", "match_date", "home_score", "away_score")


@query(V.sql("select match_id, status from m where league_code = 'L2' and (status = 'SCHEDULED' or not exists (select 1 from m x where x.league_code = 'L2' and x.status = 'SCHEDULED'))", V.M))
def scheduled_or_all(spark, d):
    m = V.matches(spark, d).where("league_code = 'L2'").select("match_id", "status")
    one = F.lit(1).alias("one")
    some = m.agg(F.bool_or(F.col("status") == "SCHEDULED").alias("some")).select("some", one)  # one row
    return m.select("*", one).join(F.broadcast(some), "one").where((F.col("status") == "SCHEDULED") | ~F.col("some")).select("match_id", "status")


@query(V.sql("select league_code, count(*) matches, count(*) filter (where status = 'IN_PLAY') live, count(*) filter (where status = 'FINISHED') finished from m group by league_code", V.M))
def dashboard_counts(spark, d):
    return V.matches(spark, d).groupBy("league_code").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("status").isin(*LIVE)).alias("live"), F.count_if(F.col("status") == "FINISHED").alias("finished"))


CHANGES = """ch as (select match_id, league_code, season, match_date, 'FINISHED' status, home_team, away_team, case when match_id % 2 = 0 then home_score + 1 end home_score, away_score + 1 away_score from m where match_id % 3 = 0
  union all select match_id + 100000000, league_code, season, match_date, 'SCHEDULED', home_team, away_team, null, null from m where match_id % 50 = 1)"""


def _changes(m: DataFrame) -> DataFrame:
    a = m.where("match_id % 3 = 0").withColumn("status", F.lit("FINISHED")).withColumn("home_score", F.when(F.col("match_id") % 2 == 0, F.col("home_score") + 1)).withColumn("away_score", F.col("away_score") + 1)
    none = F.lit(None).cast("long")
    b = m.where("match_id % 50 = 1").withColumn("match_id", F.col("match_id") + 100000000).withColumn("status", F.lit("SCHEDULED")).withColumn("home_score", none).withColumn("away_score", none)
    return a.unionByName(b)


@query(V.sql("""select coalesce(m.match_id, ch.match_id) match_id, case when m.match_id is not null then m.league_code else ch.league_code end league_code,
 case when ch.match_id is not null then ch.status else m.status end status, case when ch.match_id is not null then ch.home_score else m.home_score end home_score,
 case when ch.match_id is not null then ch.away_score else m.away_score end away_score from m full join ch on m.match_id = ch.match_id""", V.M, CHANGES))
def upsert_matches(spark, d):
    m = V.matches(spark, d)
    out = merge.upsert(m, _changes(m), ["match_id"], ["status", "home_score", "away_score"], keep_old_if_null=False)
    return out.select("match_id", "league_code", "status", "home_score", "away_score")


@query(V.sql("""select coalesce(m.match_id, ch.match_id) match_id, coalesce(ch.league_code, m.league_code) league_code, coalesce(ch.status, m.status) status,
 coalesce(ch.home_score, m.home_score) home_score, coalesce(ch.away_score, m.away_score) away_score from m full join ch on m.match_id = ch.match_id""", V.M, CHANGES))
def merge_fields(spark, d):
    m = V.matches(spark, d)
    return merge.merge_fields(m, _changes(m), ["match_id"]).select("match_id", "league_code", "status", "home_score", "away_score")


@query(V.sql("""select league_code, season, match_id, priority from (select *, case status when 'IN_PLAY' then 0 when 'FINISHED' then 1 else 2 end priority from m)
 qualify priority = min(priority) over (partition by league_code, season)""", V.M))
def priority_fallback(spark, d):
    m = V.matches(spark, d)
    feeds = [m.where(F.col("status") == s) for s in ("IN_PLAY", "FINISHED", "SCHEDULED")]
    return merge.priority_fallback(merge.union_by_priority(*feeds), ["league_code", "season"]).select("league_code", "season", "match_id", "priority")


MERGED = """ai as (select * from cw where match_id % 3 <> 0), ml as (select match_id, case when home_p = greatest(home_p, draw_p, away_p) then 'HOME' when draw_p = greatest(home_p, draw_p, away_p) then 'DRAW' else 'AWAY' end outcome from sc where match_id % 4 <> 0),
 mg as (select coalesce(ai.match_id, ml.match_id) match_id, case when ai.match_id is null then 'ML Ensemble' when ml.match_id is null then 'AI Sites' else 'AI Sites,ML Ensemble' end sources, consensus_winner w, outcome o from ai full join ml on ai.match_id = ml.match_id),
 mc as (select match_id, sources, cast(case when w = o then 2 when w is null and o is null then 0 else 1 end as bigint) agreement_level,
  case when w = o then w when w is null then o when o is null then w end agreed_outcome, coalesce(w = o, false) all_agree from mg)"""
_MC = (V.M, V.P, PROBS, VOTES, V.O, AVERAGE, FAIR, SCORED, CONS, MERGED)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    ai = consensus.match_consensus(V.predictions(spark, d)).where("match_id % 3 <> 0")
    ml = models.decided(_scored(spark, d).where("match_id % 4 <> 0"))
    return consensus.merge_consensus(ai, ml)


@query(V.sql("select * from mc", *_MC))
def consensus_full_outer(spark, d):
    return _merged(spark, d)


@query(V.sql("""select count(*) total, count(*) filter (where sources like '%AI Sites%') ai_predictions, count(*) filter (where sources like '%ML Ensemble%') ml_predictions,
 count(agreed_outcome) agreed, count(agreed_outcome) filter (where e.match_id is not null) playable, count(agreed_outcome) filter (where e.match_id is not null and all_agree) playable_agree_all
 from mc left join (select distinct match_id from o where home_odds > 0) e using (match_id)""", *_MC))
def consensus_stats(spark, d):
    return consensus.consensus_counts(_merged(spark, d), V.quotes(spark, d).where("home_odds > 0"))


@query("""select min(p_partkey) id, p_name as name, p_name || ' FC' as shown, replace(p_name, ' ', '_') as legacy, p_name as merge_key, p_name || '_vs_' || p_name as pair_key from part group by p_name""")
def name_keys(spark, d):
    t = V.teams(spark, d).withColumn("shown", F.concat("name", F.lit(" FC")))
    shown = F.col("shown")
    return t.select("id", "name", "shown", N.legacy_name(shown).alias("legacy"), N.merge_name(shown).alias("merge_key"), N.match_key(N.bookmaker_name(shown), N.site_name(shown)).alias("pair_key"))


@query("""with n as (select distinct p_name as a, split_part(p_name, ' ', 1) w1, split_part(p_name, ' ', 2) w2 from part)
 select x.a as a, y.a as b from n x, n y where x.w1 in (y.w1, y.w2) or x.w2 in (y.w1, y.w2)""")
def same_team_pairs(spark, d):
    t = V.teams(spark, d)
    return entity.same_teams(t, t)


@query("""with n as (select p_name as name, min(p_partkey) id from part group by p_name), s as (select id, name, split_part(name, ' ', 1) w1, split_part(name, ' ', 2) w2 from n),
 l as (select s.id, s.name h, s.w1 h1, s.w2 h2, s.w2 || ' ' || s.w1 a, s.w2 a1, s.w1 a2 from s),
 sc as (select l.id, r.id pos, case when l.h = r.name then 2 when contains(l.h, r.name) or contains(r.name, l.h) or (length(l.h1) > 3 and l.h1 in (r.w1, r.w2)) or (length(l.h2) > 3 and l.h2 in (r.w1, r.w2)) then 1 else 0 end
  + case when l.a = r.name then 2 when contains(l.a, r.name) or contains(r.name, l.a) or (length(l.a1) > 3 and l.a1 in (r.w1, r.w2)) or (length(l.a2) > 3 and l.a2 in (r.w1, r.w2)) then 1 else 0 end score from l, s r where r.id <> l.id)
 select id, pos, cast(score as bigint) score from sc where score >= 2 qualify row_number() over (partition by id order by score desc, pos) = 1""")
def fuzzy_best_match(spark, d):
    t = V.teams(spark, d)
    words = F.split("name", " ")
    left = t.select("id", F.col("name").alias("home"), F.concat_ws(" ", words[1], words[0]).alias("away"))
    right = t.select(F.col("id").alias("pos"), F.col("name").alias("home"), F.col("name").alias("away"))
    return entity.best_scored_match(left, right, not_itself=True)


@query("""with n as (select p_name as name, min(p_partkey) id from part group by p_name),
 k as (select id, name, case when id % 3 = 0 then upper(name) else split_part(name, ' ', 1) || ' xx' end q from n),
 t as (select id, lower(name) stored from n where id % 2 = 0),
 e as (select k.id, stored, 'exact' how from k join t on lower(k.q) = stored)
 select * from e union all select distinct k.id, stored, 'partial' from k join t on contains(stored, lower(split_part(k.q, ' ', 1))) or contains(lower(k.q), stored)
 where k.id not in (select id from e)""")
def name_lookup(spark, d):
    t = V.teams(spark, d)
    asked = t.select("id", F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.concat(F.split("name", " ")[0], F.lit(" xx"))).alias("name"))
    return entity.exact_then_partial(asked, t.where("id % 2 = 0"))


@query(V.sql("""select m.match_id, case when a.c is not null then 0 when b.c is not null then 1 when x.c is not null then 2 end as tier, coalesce(a.c, b.c, x.c) as value from m
 left join (select match_id, min(tip) c from p where source = 'S1' group by 1) a using (match_id) left join (select match_id, min(tip) c from p where source = 'S2' group by 1) b using (match_id)
 left join (select match_id, min(tip) c from p group by 1) x using (match_id)""", V.M, V.P))
def tiered_lookup(spark, d):
    p = V.predictions(spark, d)
    tier = lambda rows: (rows.groupBy("match_id").agg(F.min("tip").alias("value")), ["match_id"])
    m = V.matches(spark, d).select("match_id", F.col("match_id").alias("id"))
    return entity.tiered_lookup(m, tier(p.where("source = 'S1'")), tier(p.where("source = 'S2'")), tier(p)).select("match_id", "tier", "value")


@query(V.sql("""select match_id, league_code as league, concat('T', cast(home_team as varchar)) home_team, concat('T', cast(away_team as varchar)) away_team, home_score, away_score,
 case status when 'FINISHED' then 'FINISHED' when 'IN_PLAY' then 'LIVE' else 'SCHEDULED' end as status from m""", V.M))
def parse_delimited(spark, d):
    """Feeds of each league and day written from the matches and parsed again."""
    m = V.matches(spark, d)
    text = lambda c: F.col(c).cast("string")
    code = F.when(F.col("status") == "FINISHED", "3").when(F.col("status") == "IN_PLAY", "2").otherwise("1")
    record = F.concat(
        F.lit("AA÷"), text("match_id"), F.lit("¬AE÷T"), text("home_team"), F.lit("¬AF÷T"), text("away_team"), F.lit("¬AB÷"), code,
        F.lit("¬AG÷"), text("home_score"), F.lit("¬AH÷"), text("away_score"),
    )
    # A feed holds a day's matches of at most 20,000 numbers.
    part = F.floor(F.col("match_id") / 20_000).alias("part")
    league = m.groupBy(F.to_date("match_date").alias("day"), part, "league_code").agg(F.array_join(F.collect_list(record), "~").alias("r"))
    head = F.concat(F.lit("ZA÷"), F.col("league_code"), F.lit("¬ZB÷X~"), F.col("r"))
    feeds = league.groupBy(F.concat_ws("/", F.col("day").cast("string"), "part").alias("payload_id")).agg(F.array_join(F.collect_list(head), "~").alias("raw"))
    out = delimited.live_feed(feeds)
    return out.select(F.col("feed_id").cast("long").alias("match_id"), "league", "home_team", "away_team", F.col("home_score").cast("long").alias("home_score"), F.col("away_score").cast("long").alias("away_score"), "status")


@query(V.sql("select match_id, bookmaker, round(max(home_odds), 2) home_odds, round(max(draw_odds), 2) draw_odds, round(max(away_odds), 2) away_odds from o group by match_id, bookmaker", V.O))
def parse_odds_feed(spark, d):
    """Odds feed of each match written from the quotes and parsed again."""
    q = V.quotes(spark, d).groupBy("match_id", "bookmaker").agg(*[F.max(f"{k}_odds").alias(k) for k in ("home", "draw", "away")])
    text = lambda c: F.format_string("%.2f", F.round(c, 2))
    part = F.concat(F.lit("OD÷"), F.col("bookmaker"), F.lit("¬OE÷"), text("home"), F.lit("¬OF÷"), text("draw"), F.lit("¬OG÷"), text("away"))
    feeds = q.groupBy(F.col("match_id").alias("payload_id")).agg(F.array_join(F.collect_list(part), "¬").alias("raw"))
    return delimited.odds_feed(feeds).withColumnRenamed("payload_id", "match_id")


@query(V.sql("""select m.match_id event_id, concat('T', cast(home_team as varchar)) home_team, concat('T', cast(away_team as varchar)) away_team, round(avg_home, 3) home_odds, round(avg_draw, 3) draw_odds,
 round(avg_away, 3) away_odds, round(best_home, 3) over_25_odds, 'PL' league_code, concat('https://bookmaker.example/event/', cast(m.match_id as varchar), '/t', cast(home_team as varchar), '---t', cast(away_team as varchar)) deeplink
 from m join ao using (match_id)""", V.M, V.O, AVERAGE))
def parse_offers(spark, d):
    """Betting-offer payloads written from matches and odds, one per match, and parsed again."""
    m = V.matches(spark, d).join(odds.average_and_best(V.quotes(spark, d)), "match_id")
    milli = lambda c: F.round(F.col(c) * 1000).cast("long")
    outcome = lambda label, c: F.struct(F.lit(label).alias("label"), milli(c).alias("odds"))
    offer = lambda label, kind, *o: F.struct(F.struct(F.lit(label).alias("label")).alias("criterion"), F.struct(F.lit(kind).alias("id"), F.lit("").alias("name")).alias("betOfferType"), F.array(*o).alias("outcomes"))
    name = F.concat(F.lit("T"), F.col("home_team").cast("string"), F.lit(" - T"), F.col("away_team").cast("string"))
    event = F.struct(
        F.col("match_id").alias("id"), name.alias("name"), name.alias("englishName"), F.date_format("match_date", "yyyy-MM-dd").alias("start"), F.lit("NOT_STARTED").alias("state"),
        F.array(F.struct(F.lit("Football").alias("name")), F.struct(F.lit("Premier League").alias("name"))).alias("path"),
    )
    bets = F.array(offer("Match", 2, outcome("1", "avg_home"), outcome("X", "avg_draw"), outcome("2", "avg_away")), offer("Total Over/Under", 6, outcome("Over 2.5", "best_home")))
    bodies = m.select(F.to_json(F.struct(F.array(F.struct(event.alias("event"), bets.alias("betOffers"))).alias("events"))).alias("body"))
    out = json_feeds.offers(bodies)
    return out.select("event_id", "home_team", "away_team", *_r("home_odds", "draw_odds", "away_odds", "over_25_odds", digits=3), "league_code", "deeplink")


@query(V.sql("select match_id, match_date, home_team, away_team, home_score, away_score, season, 'FINISHED' status from f", V.M, V.F_))
def parse_season_rows(spark, d):
    """Season rows written as text columns and normalised again."""
    m = stats.finished(V.matches(spark, d))
    raw = m.select(
        F.concat(F.lit(""), F.col("league_code")).alias("league_code"), F.col("season").cast("string").alias("season_code"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
        F.date_format("match_date", "HH:mm").alias("Time"), F.col("home_team").cast("string").alias("HomeTeam"), F.col("away_team").cast("string").alias("AwayTeam"),
        F.col("home_score").cast("string").alias("FTHG"), F.col("away_score").cast("string").alias("FTAG"), F.col("match_id").cast("string").alias("Referee"),
    )
    out = csv.normalise(raw)
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select(F.col("referee").cast("long").alias("match_id"), F.col("match_date").cast("timestamp_ntz").alias("match_date"), long("home_team"), long("away_team"), long("home_score"), long("away_score"), long("season"), "status")


@query(V.sql("""select concat('T', cast(home_team as varchar)) home_team, concat('T', cast(away_team as varchar)) away_team, cast(1 + home_score * 20 as bigint) home_win_pct, cast(99 - home_score * 20 as bigint) away_win_pct,
 1.5 + home_score odds_home, 1.5 + away_score odds_away, count(*) n from m group by all""", V.M))
def html_rows(spark, d):
    """Prediction tables written as HTML from the matches and cut out again."""
    m = V.matches(spark, d)
    text = lambda c: F.col(c).cast("string")
    row = F.concat(
        F.lit('<tr class="x"><td><img alt="T'), text("home_team"), F.lit(' logo"></td><td><img alt="T'), text("away_team"), F.lit(' logo"></td><td>'), (1 + F.col("home_score") * 20).cast("string"),
        F.lit("%</td><td>"), (1.5 + F.col("home_score")).cast("string"), F.lit(" vs -"), (1.5 + F.col("away_score")).cast("string"), F.lit("</td></tr>"),
    )
    pages = m.groupBy(F.concat_ws("/", F.to_date("match_date").cast("string"), F.floor(F.col("match_id") / 20_000)).alias("url")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    out = html.table_rows(pages)
    return out.groupBy("home_team", "away_team", F.col("home_win_pct").cast("long").alias("home_win_pct"), F.col("away_win_pct").cast("long").alias("away_win_pct"), "odds_home", "odds_away").agg(F.count(F.lit(1)).alias("n"))


@query("""select page_id, length(t) as n_text, sha256(t) as text_sha256 from (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from pages)""")
def page_text(spark, d):
    """Each page's text without tags and with the common entities as characters."""
    text = X.strip_html(F.col("html"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_text"), F.sha2("t", 256).alias("text_sha256"))


@query("select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, case when value > 1 then value / 100 else value end as fraction from events")
def event_props(spark, d):
    """JSON text to a struct, and percentages to fractions."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"), X.to_fraction(F.col("value")).alias("fraction"))


_AVG = """av as (select avg(home_score) ah, avg(away_score) aa from (select *, row_number() over (partition by league_code order by match_date desc, match_id desc) rn from f) where rn <= 500),
 eg as (select f.match_id, round(greatest(0.1, least(5.0, round(h.avg_goals_scored, 2) * round(a.avg_goals_conceded, 2) / aa * ah)), 2) home_goals,
  round(greatest(0.1, least(5.0, round(a.avg_goals_scored, 2) * round(h.avg_goals_conceded, 2) / ah * aa)), 2) away_goals from f join ts h on h.team = f.home_team and h.league_code = f.league_code and h.season = f.season
  join ts a on a.team = f.away_team and a.league_code = f.league_code and a.season = f.season, av)"""
_GRID = """pg as (select match_id, home_goals, away_goals, power(home_goals, i) * exp(-home_goals) / factorial(i::int) * power(away_goals, j) * exp(-away_goals) / factorial(j::int) pr, i, j from eg, range(0, 8) x(i), range(0, 8) y(j))"""


@query(V.sql("""select match_id, round(sum(pr) filter (where i > j), 6) home_p, round(sum(pr) filter (where i = j), 6) draw_p, round(sum(pr) filter (where i < j), 6) away_p from pg group by match_id""", *_BASE, STATS, _AVG, _GRID))
def poisson_probs(spark, d):
    m = V.matches(spark, d)
    team = stats.team_season_stats(stats.sides(m))
    goals = models.expected_goals(stats.finished(m), team, stats.goal_averages(m))
    return models.poisson(goals).select("match_id", *_r("home_p", "draw_p", "away_p"))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, average odds and AI votes."""
    market = odds.average_and_best(V.quotes(spark, d)).select("match_id", *[F.col(f"avg_{k}").alias(f"{k}_odds") for k in ("home", "draw", "away")])
    return V.matches(spark, d), market, consensus.ai_vote_features(consensus.with_probabilities(V.predictions(spark, d)))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m, market, votes = _sources(spark, d)
    return m, features.match_features(stats.finished(m), features.stats_with_form(m), stats.head_to_head(m), market, votes)


def _sql_features() -> str:
    pct = lambda p, t: f"case when {t} > 0 then round({p} / cast({t} as double), 4) else 0e0 end"
    form = "case when {f} is null or {f} = '' then 0.5 else (3 * length(replace(replace({f}, 'D', ''), 'L', '')) + length(replace(replace({f}, 'W', ''), 'L', ''))) / (length({f}) * 3e0) end"
    out = [f"{V.rounded_sql(f'{k}.avg_{g}', 2)} {side}_{g}_avg" for side, k in (("home", "h"), ("away", "a")) for g in ("goals_scored", "goals_conceded")]
    for side, k, at in (("home", "h", "home"), ("away", "a", "away")):
        ground = f"greatest({k}.{at}_wins + {k}.{at}_draws + {k}.{at}_losses, 1)"
        out += [f"{pct(f'{k}.{n}', f'{k}.matches_played')} {side}_{m}_pct" for n, m in (("wins", "win"), ("draws", "draw"), ("losses", "loss"))]
        out += [f"{pct(f'{k}.{at}_wins', ground)} {side}_{at}_win_pct", f"{pct(f'{k}.{at}_draws', ground)} {side}_{at}_draw_pct"]
        out += [f"round({k}.{at}_goals_scored / cast({ground} as double), 6) {side}_{at}_goals_avg", f"round({k}.{at}_goals_conceded / cast({ground} as double), 6) {side}_{at}_conceded_avg"]
        out += [f"round({form.format(f=f'{k}f.form')}, 6) {side}_form_score", f"{pct(f'{k}.clean_sheets', f'{k}.matches_played')} {side}_clean_sheet_pct"]
        out += [f"round(({k}.goals_scored - {k}.goals_conceded) / cast({k}.matches_played as double), 6) goal_diff_{side}", f"round((3 * {k}.wins + {k}.draws) / cast({k}.matches_played as double), 6) {side}_points_per_game"]
    out += [f"round(coalesce({c}, 0), 6) {c}" for c in ("h2h_home_wins", "h2h_draws", "h2h_away_wins", "h2h_home_goals_avg", "h2h_away_goals_avg")]
    real = "coalesce(avg_home > 1 and avg_draw > 1 and avg_away > 1, false)"
    out += [f"round(case when {real} then avg_{k} else 0 end, 6) odds_{k}" for k in ("home", "draw", "away")]
    out += [f"case when {real} then round(1 / avg_{k}, 4) else 0.33 end implied_prob_{k}" for k in ("home", "draw", "away")]
    out += [f"case when {real} then 1e0 else 0e0 end has_real_odds"]
    out += [f"round(coalesce(ai_consensus_{k}, 0.33), 6) ai_consensus_{k}" for k in ("home", "draw", "away")]
    out += ["cast(coalesce(ai_num_sources, 0) as double) ai_num_sources", "round(coalesce(ai_agreement, 0), 6) ai_agreement"]
    return f"""select f.match_id, {', '.join(out)} from f join ts h on h.team = f.home_team and h.league_code = f.league_code and h.season = f.season
 join ts a on a.team = f.away_team and a.league_code = f.league_code and a.season = f.season
 left join lf hf on hf.team = f.home_team and hf.league_code = f.league_code and hf.season = f.season left join lf af on af.team = f.away_team and af.league_code = f.league_code and af.season = f.season
 left join h2h on h2h.team = f.home_team and h2h.opponent = f.away_team left join ao on ao.match_id = f.match_id left join vf on vf.match_id = f.match_id
 where h.matches_played >= 3 and a.matches_played >= 3"""


@query(V.sql(_sql_features(), *_BASE, STATS, FORM.format(by="team, league_code, season"), H2H, V.P, PROBS, VOTES, V.O, AVERAGE))
def match_features(spark, d):
    """All 43 features by the teams' seasons so far, as for matches to come."""
    _, out = _features(spark, d)
    return out.select("match_id", *_r(*features.FEATURES))


def _sql_before() -> str:
    """The feature SQL over running statistics: each side's counters before the match stand in the place of its season's."""
    w = "over (partition by team, league_code, season order by match_date range between unbounded preceding and interval 1 microsecond preceding)"
    n = lambda c: f"count(*) filter (where {c}) {w}"
    total = lambda c, when="true": f"cast(coalesce(sum({c}) filter (where {when}) {w}, 0) as bigint)"
    kinds = (("wins", "gf > ga"), ("draws", "gf = ga"), ("losses", "gf < ga"))
    parts = [f"count(*) {w} matches_played", f"{n('ga = 0')} clean_sheets", f"{total('gf')} goals_scored", f"{total('ga')} goals_conceded", f"avg(gf) {w} avg_goals_scored", f"avg(ga) {w} avg_goals_conceded"]
    parts += [f"{n(c)} {k}" for k, c in kinds] + [f"{n(g + ' and ' + c)} {at}_{k}" for at, g in (("home", "is_home"), ("away", "not is_home")) for k, c in kinds]
    parts += [f"{total(c, g)} {at}_{k}" for at, g in (("home", "is_home"), ("away", "not is_home")) for k, c in (("goals_scored", "gf"), ("goals_conceded", "ga"))]
    running = f"""rs as (select match_id, team, league_code, season, {', '.join(parts)},
 array_to_string(list_transform(list_reverse_sort(list({{'d': match_date, 'i': match_id, 'r': case when gf > ga then 'W' when gf = ga then 'D' else 'L' end}}) {w})[1:5], lambda x: x.r), '') form from s)"""
    met = """hm as (select *, least(home_team, away_team) lo, greatest(home_team, away_team) hi from f),
 hb as (select match_id, home_team, lo, avg(case when lg > hg then 1e0 else 0e0 end) ow lw, avg(case when lg = hg then 1e0 else 0e0 end) ow dw, avg(case when lg < hg then 1e0 else 0e0 end) ow hw, avg(lg) ow lg, avg(hg) ow hg from
  (select *, case when home_team = lo then home_score else away_score end lg, case when home_team = lo then away_score else home_score end hg from hm)),
 h2b as (select match_id, case when home_team = lo then lw else hw end h2h_home_wins, dw h2h_draws, case when home_team = lo then hw else lw end h2h_away_wins, case when home_team = lo then lg else hg end h2h_home_goals_avg,
  case when home_team = lo then hg else lg end h2h_away_goals_avg from hb)""".replace(" ow ", " over (partition by lo, hi order by match_date, match_id rows between 10 preceding and 1 preceding) ")
    head = _sql_features().split(" from f join ts h on")[0].replace("hf.form", "h.form").replace("af.form", "a.form")
    body = f"{head} from f join rs h on h.match_id = f.match_id and h.team = f.home_team join rs a on a.match_id = f.match_id and a.team = f.away_team left join h2b on h2b.match_id = f.match_id left join ao on ao.match_id = f.match_id left join vf on vf.match_id = f.match_id where h.matches_played >= 3 and a.matches_played >= 3"
    return V.sql(body, *_BASE, running, met, V.P, PROBS, VOTES, V.O, AVERAGE)


@query(_sql_before())
def features_before_match(spark, d):
    """All 43 features of finished matches from what was known before each: what models are trained on."""
    m, market, votes = _sources(spark, d)
    return features.features_before_match(m, market, votes).select("match_id", *_r(*features.FEATURES))


@query(V.sql("""select match_id, label, row_number() over (order by cast(match_date as date), match_date, match_id) <= floor(count(*) over () * 0.8) as is_train from
 (select match_id, match_date, case when home_score > away_score then 0e0 when home_score = away_score then 1e0 else 2e0 end as label from f)""", V.M, V.F_))
def training_split(spark, d):
    m = stats.finished(V.matches(spark, d))
    label = F.when(F.col("home_score") > F.col("away_score"), 0.0).when(F.col("home_score") == F.col("away_score"), 1.0).otherwise(2.0)
    return stats.temporal_split(m.select("match_id", "match_date", label.alias("label"))).select("match_id", "label", "is_train")


@query()
def model_scores(spark, d):
    """Three classifiers trained on the earlier matches and scored on the later ones, with their ensemble, value and suggestion."""
    m, market, votes = _sources(spark, d)
    # Stored once: training and each model's scores read it again.
    path = live.job_path(spark, "training")
    features.training_set(m, features.features_before_match(m, market, votes)).write.parquet(path)
    rows = spark.read.parquet(path)
    fitted = models.train(rows)
    scores = models.score_all(fitted, rows.where(~F.col("is_train")))
    both = models.decided(scores.unionByName(models.ensemble(scores)))
    priced = V.named(spark, d).select("match_id", "home", "away").join(market, "match_id", "left")
    out = models.with_value(both, priced)
    return out.select("match_id", "model", "outcome", *_r("home_p", "draw_p", "away_p", "confidence", "value_rating"), "value_tier", "suggestion")


ENSEMBLE = """ms as (select match_id, 'gbt' model, home_p, draw_p, away_p from pp where source = 'S0' union all select match_id, 'mlp', home_p, draw_p, away_p from pp where source = 'S1'
 union all select match_id, 'forest', home_p, draw_p, away_p from pp where source = 'S2'), mw as (select *, case model when 'gbt' then 0.4 when 'mlp' then 0.35 else 0.25 end w from ms)"""


_TOTAL = "cast(sum(cast({} as decimal(20,15))) as double)"
_WEIGHTED = ", ".join(f"{_TOTAL.format(f'{k}_p * cast(w as double)')} / {_TOTAL.format('w')} {k}_p" for k in ("home", "draw", "away"))


@query(V.sql(f"select match_id, {_WEIGHTED} from mw group by match_id", V.P, PROBS, ENSEMBLE))
def ensemble_scores(spark, d):
    """Weighted ensemble with three sources in the place of three models."""
    p = consensus.with_probabilities(V.predictions(spark, d)).where(F.col("source").isin("S0", "S1", "S2"))
    name = F.when(F.col("source") == "S0", "gbt").when(F.col("source") == "S1", "mlp").otherwise("forest")
    return models.ensemble(p.select("match_id", name.alias("model"), "home_p", "draw_p", "away_p")).select("match_id", "home_p", "draw_p", "away_p")


@query(V.sql("""select match_id, outcome consensus_outcome, n models_agree, cast(t as bigint) models_total, n / cast(t as double) agreement, c avg_confidence, ah avg_home_p, ad avg_draw_p, aa avg_away_p from (
 select *, sum(n) over (partition by match_id) t, sum(s) over (partition by match_id) / sum(n) over (partition by match_id) c, sum(sh) over (partition by match_id) / sum(n) over (partition by match_id) ah, sum(sd) over (partition by match_id) / sum(n) over (partition by match_id) ad, sum(sa) over (partition by match_id) / sum(n) over (partition by match_id) aa, row_number() over (partition by match_id order by n desc, first_model) rn from (
  select match_id, outcome, count(*) n, min(model) first_model, sum(confidence) s, sum(home_p) sh, sum(draw_p) sd, sum(away_p) sa from (select match_id, home_p, draw_p, away_p, source model, case tip when '1' then 'HOME' when 'X' then 'DRAW' else 'AWAY' end outcome, greatest(home_p, draw_p, away_p) confidence
   from pp qualify row_number() over (partition by match_id, source order by scraped_at desc, home_w desc nulls last, draw_w desc, away_w desc, tip desc, btts desc) = 1) group by 1, 2)) where rn = 1""", V.P, PROBS))
def model_consensus(spark, d):
    p = merge.first_per_key(consensus.with_probabilities(V.predictions(spark, d)), ["match_id", "source"], *_newest())
    out = p.select("match_id", F.col("source").alias("model"), X.normal_outcome(F.col("tip")).alias("outcome"), F.greatest("home_p", "draw_p", "away_p").alias("confidence"), "home_p", "draw_p", "away_p")
    return consensus.model_consensus(out)


@query(V.sql("""select p.match_id, p.source, p.scraped_at, p.tip, q.home_odds home_at_scrape, q.draw_odds draw_at_scrape, count(*) n from p asof left join
 (select match_id, quoted_at, home_odds, draw_odds, away_odds from o qualify row_number() over (partition by match_id, quoted_at order by bookmaker desc, home_odds desc, draw_odds desc, away_odds desc) = 1) q
 on p.match_id = q.match_id and p.scraped_at >= q.quoted_at group by all""", V.P, V.O))
def stream_odds_asof(spark, d):
    """Batch form of the odds at scrape time: newest quote at or before each prediction."""
    out = odds.odds_at_scrape(V.predictions(spark, d), V.quotes(spark, d))
    return out.groupBy("match_id", "source", "scraped_at", "tip", "home_at_scrape", "draw_at_scrape").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, since a stream's plain path must be a folder.
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("event_time", F.col("ts").cast("timestamp"))


@query("select cast(date_trunc('day', ts) as date) as day, event_type as source, count(*) total, count(*) filter (where value > 50) correct from events group by 1, 2")
def stream_daily_hits(spark, d):
    """Daily totals and hits per source from the event stream."""
    e = _event_stream(spark, d).select("event_time", F.col("event_type").alias("source"), (F.col("value") > 50).alias("hit"))
    changes = live.run_to_table(live.daily_hits(e), live.job_path(spark, "daily"))
    out = live.newest_change(changes, ["day", "source"])
    return out.select(F.to_date("day").alias("day"), "source", "total", "correct")
