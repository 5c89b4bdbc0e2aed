"""Queries that bring other sources' tables to the matches by team names, and what is served from them.

Team names are those of ``views.CLUBS``: the matches have one spelling and the
other sources the other, so the SQL, which joins on team numbers, states the
result that the resolution of names must reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.functions import scalars as X
from fixturelake.operators import attach, consensus, entity, merge, odds, serving, stats
from fixturelake.plans import views as V
from fixturelake.plans.catalogue import _P_ORDER, AVERAGE, PROBS, STATS, _newest, query

FIRST_MATCH = "fm as (select home_team, away_team, min(match_id) pos from m group by home_team, away_team)"
H0, A0, H1, A1 = (V.club_sql(t, k) for k in (0, 1) for t in ("home_team", "away_team"))


def _matches(spark, d) -> DataFrame:
    return V.named(spark, d).withColumnRenamed("match_id", "pos")


def _priced(spark, d) -> DataFrame:
    """Odds events of all matches with the best odds of their bookmakers; every eleventh home team is an unknown one."""
    best = odds.average_and_best(V.quotes(spark, d)).select(F.col("match_id").alias("id"), *[F.col(f"best_{k}").alias(f"{k}_odds") for k in attach.KINDS])
    return V.feed(spark, d).select("id", "home", "away", "home_team", "match_date").join(best, "id")


#: The events with a team that the matches know.
PRICED = "ev as (select match_id id, home_team, away_team, match_date, best_home, best_draw, best_away from m join ao using (match_id) where match_id % 11 <> 0)"


@query(V.sql(f"""select pos, home, away, status, minute, home_score, away_score, feed_id from (
 select match_id pos, {H0} home, {A0} away, case when is_live then 'LIVE' else m.status end status, case when is_live then l.minute end as minute,
  case when hs is not null then hs else m.home_score end home_score, case when hs is not null then aws else m.away_score end away_score, l.feed_id from m left join (
   select pos, max_by(feed_id, id) feed_id, max_by(minute, id) filter (where status = 'LIVE') as minute, max_by(home_score, id) filter (where home_score is not null) hs,
    max_by(away_score, id) filter (where home_score is not null) aws, bool_or(status = 'LIVE') is_live from fd join fm using (home_team, away_team) where not unknown group by pos) l on l.pos = m.match_id
 union all select null, 'Nowhere ' || cast(id % 3 as varchar), {A1}, status, minute, home_score, away_score, feed_id from fd where unknown)""", V.M, V.FEED, FIRST_MATCH))
def enrich_matches(spark, d):
    """Live events found among the matches by name; unknown ones are appended."""
    return attach.enrich(_matches(spark, d).select("pos", "home", "away", "status", "home_score", "away_score"), V.feed(spark, d))


@query(V.sql("""select ev.id, pos from ev join fm using (home_team, away_team)""", V.M, V.O, AVERAGE, PRICED, FIRST_MATCH))
def first_match_by_name(spark, d):
    return entity.first_fuzzy_match(_priced(spark, d), _matches(spark, d)).select("id", "pos")


@query(V.sql("""select id from fd where unknown or (home_team, away_team) not in (select (home_team, away_team) from m where match_date < timestamp '1995-02-01')""", V.M, V.FEED))
def new_matches_by_name(spark, d):
    """Events of a second source whose teams meet in no match of the first one, which ends with January 1995."""
    return entity.keep_new_matches(_matches(spark, d).where("match_date < timestamp '1995-02-01'"), V.feed(spark, d)).select("id")


@query(V.sql(f"""select pos match_id, ev.id event_id, 'bookmaker_market' source, {", ".join(V.rounded_sql(f"1 / best_{k} / (1 / best_home + 1 / best_draw + 1 / best_away)", 4) + f" as {k}_p" for k in attach.KINDS)}, best_home odds_home, best_draw odds_draw, best_away odds_away,
 'https://bookmaker.example/event/' || cast(ev.id as varchar) deeplink from ev join fm using (home_team, away_team) where best_home > 0""", V.M, V.O, AVERAGE, PRICED, FIRST_MATCH))
def market_predictions(spark, d):
    """Odds events attached to matches, each with the market's probabilities as a prediction of its own."""
    events = _priced(spark, d).withColumn("deeplink", F.concat(F.lit("https://bookmaker.example/event/"), F.col("id").cast("string"))).drop("home_team", "match_date")
    out = attach.market_rows(_matches(spark, d), events, "bookmaker_market")
    return out.select("match_id", "event_id", "source", *[f"{k}_p" for k in attach.KINDS], *[F.col(f"odds_at_scrape.{k}").alias(f"odds_{k}") for k in attach.KINDS], "deeplink")


PREDICTED = """pr as (select p.match_id * 10 + cast((draw_w - 5) / 2 as bigint) id, home_team, away_team, source, home_w, draw_w, away_w, tip, btts from p join m using (match_id)),
 le as (select home_team, away_team, best_home eh, best_draw ed, best_away ea from ev qualify row_number() over (partition by home_team, away_team order by id desc) = 1)"""


def _predicted(spark, d) -> DataFrame:
    """Predictions under their own numbers, with the other spelling of the teams."""
    m = V.matches(spark, d).select("match_id", V.club("home_team", 1).alias("home"), V.club("away_team", 1).alias("away"))
    p = V.predictions(spark, d).join(m, "match_id")
    number = (F.col("match_id") * 10 + ((F.col("draw_w") - 5) / 2).cast("long")).alias("id")
    return p.select(number, "home", "away", "source", F.col("home_w").alias("home_pct"), F.col("draw_w").alias("draw_pct"), F.col("away_w").alias("away_pct"), "tip", "btts")


@query(V.sql("""select pos match_id, pr.id, source, round(case when home_w is not null then home_w / (home_w + draw_w + away_w) else case tip when '1' then 0.55 when '2' then 0.20 else 0.30 end end, 4) home_p,
 round(case when home_w is not null then draw_w / (home_w + draw_w + away_w) else case tip when '1' then 0.25 when '2' then 0.25 else 0.40 end end, 4) draw_p,
 round(case when home_w is not null then away_w / (home_w + draw_w + away_w) else case tip when '1' then 0.20 when '2' then 0.55 else 0.30 end end, 4) away_p,
 eh odds_home, ed odds_draw, ea odds_away, btts from pr join fm using (home_team, away_team) left join le using (home_team, away_team)""", V.M, V.P, V.O, AVERAGE, PRICED, FIRST_MATCH, PREDICTED))
def attached_predictions(spark, d):
    """Predictions attached to matches with probabilities and the market's odds at that time."""
    out = attach.attach_predictions(_predicted(spark, d), _matches(spark, d), _priced(spark, d))
    return out.select("match_id", "id", "source", "home_p", "draw_p", "away_p", *[F.col(f"odds_at_scrape.{k}").alias(f"odds_{k}") for k in attach.KINDS], "btts")


def _side_sql(a: str, b: str) -> str:
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: length(w) > 3)"
    return f"case when {a} = {b} then 2 when contains({a}, {b}) or contains({b}, {a}) or list_has_any({words(a)}, {words(b)}) then 1 else 0 end"


_ASKED = f"""ck as (select range as team, (list_value({", ".join("'" + c[1].lower().replace("'", "''") + "'" for c in V.CLUBS)}))[range + 1] as name from range(0, {len(V.CLUBS)})),
 pk as (select m.match_id id, case when m.match_id % 13 = 0 then 'zz qq' when m.match_id % 7 = 0 then h.name || ' fc' else h.name end home, case when m.match_id % 13 = 0 then 'vv ww' else a.name end away
  from m join ck h on h.team = m.home_team join ck a on a.team = m.away_team),
 ofr as (select ev.id pos, h.name home, a.name away, best_home, best_draw, best_away from ev join ck h on h.team = ev.home_team join ck a on a.team = ev.away_team where ev.home_team <> 3),
 ex as (select home, away, max(pos) pos from ofr group by home, away),
 fz as (select l.home, l.away, r.pos from (select distinct home, away from pk where (home, away) not in (select (home, away) from ex)) l, (select home, away, min(pos) pos from ofr group by home, away) r
  where {_side_sql("l.home", "r.home")} + {_side_sql("l.away", "r.away")} >= 2
  qualify row_number() over (partition by l.home, l.away order by {_side_sql("l.home", "r.home")} + {_side_sql("l.away", "r.away")} desc, r.pos) = 1)"""


@query(V.sql("""select pk.id, o.pos is not null as available, o.best_home home_odds, o.best_draw draw_odds, o.best_away away_odds from pk left join ex using (home, away) left join fz using (home, away)
 left join ofr o on o.pos = coalesce(ex.pos, fz.pos)""", V.M, V.O, AVERAGE, PRICED, _ASKED))
def odds_by_name(spark, d):
    """All predictions with the odds of their teams' event and a flag: the last one of equal names, else the first of the best match; some teams have no offers."""
    low = lambda c: F.lower(V.club(c, 1))
    m = V.matches(spark, d)
    unknown, longer = F.col("match_id") % 13 == 0, F.col("match_id") % 7 == 0
    home = F.when(unknown, "zz qq").when(longer, F.concat(low("home_team"), F.lit(" fc"))).otherwise(low("home_team"))
    asked = m.select(F.col("match_id").alias("id"), home.alias("home"), F.when(unknown, "vv ww").otherwise(low("away_team")).alias("away"))
    prices = _priced(spark, d).where(~F.col("home").startswith("Nowhere")).select("id", *[f"{k}_odds" for k in attach.KINDS])
    offers = m.where("home_team <> 3").select(F.col("match_id").alias("id"), low("home_team").alias("home"), low("away_team").alias("away")).join(prices, "id").withColumnRenamed("id", "pos")
    out = entity.attach_odds(asked, offers)
    return out.select("id", "available", *[F.col(f"odds.{k}_odds").alias(f"{k}_odds") for k in attach.KINDS])


@query(V.sql("""select match_id pos, n, home_p, draw_p, away_p from m join (select home_team, away_team, count(*) n, avg(coalesce(home_w, 0) / (coalesce(home_w, 0) + draw_w + away_w)) home_p,
 avg(draw_w / (coalesce(home_w, 0) + draw_w + away_w)) draw_p, avg(away_w / (coalesce(home_w, 0) + draw_w + away_w)) away_p from p join m using (match_id) group by home_team, away_team) using (home_team, away_team)""", V.M, V.P))
def votes_by_teams(spark, d):
    """All predictions of each match's teams, found by name."""
    return attach.votes_by_teams(_matches(spark, d).select("pos", "home", "away"), _predicted(spark, d))


@query(V.sql("""select m.match_id, fd.id from m join fd on fd.home_team = m.home_team and fd.away_team = m.away_team where m.status = 'IN_PLAY' and not unknown and fd.status = 'LIVE'""", V.M, V.FEED))
def all_matches_by_name(spark, d):
    """Every live event with the teams of a running match, one to many."""
    running = _matches(spark, d).where("status = 'IN_PLAY'").withColumnRenamed("pos", "id")
    return entity.all_fuzzy_matches(running, V.feed(spark, d).where("status = 'LIVE'").withColumnRenamed("id", "pos")).select(F.col("id").alias("match_id"), F.col("pos").alias("id"))


@query(V.sql("""select team, league_code, season, season % 2 = 0 is_stored, wins + case when season % 2 = 0 then 1000 else 0 end wins, goals_scored from ts""", V.M, V.F_, V.SIDES, STATS))
def stored_or_computed_stats(spark, d):
    """Stored statistics where there are any, else those computed from the matches."""
    computed = stats.team_season_stats(stats.sides(V.matches(spark, d))).select(*stats.TEAM_SEASON, "wins", "goals_scored")
    stored = computed.where("season % 2 = 0").withColumn("wins", F.col("wins") + 1000)
    return attach.stored_or_computed(computed.select(*stats.TEAM_SEASON), stored, computed, list(stats.TEAM_SEASON))


SCORES = f"""lp as (select * from pp where source in ('S0', 'S1', 'S2') qualify row_number() over (partition by match_id, source order by {_P_ORDER}) = 1),
 en as (select match_id, count(*) n, cast(sum(cast(home_p * w as decimal(20,15))) as double) / cast(sum(cast(w as decimal(20,15))) as double) hp, cast(sum(cast(draw_p * w as decimal(20,15))) as double) / cast(sum(cast(w as decimal(20,15))) as double) dp, cast(sum(cast(away_p * w as decimal(20,15))) as double) / cast(sum(cast(w as decimal(20,15))) as double) ap from (select *, case source when 'S0' then 4e-1 when 'S1' then 35e-2 else 25e-2 end w from lp) group by match_id),
 fe as (select home_team, away_team, min(id) id from ev group by home_team, away_team),
 ps as (select m.match_id, home_team, away_team, league_code, m.match_date, n, floor(hp * 10000 + 0.5000001) / 1e4 home_p, floor(dp * 10000 + 0.5000001) / 1e4 draw_p, floor(ap * 10000 + 0.5000001) / 1e4 away_p, ev.id is not null has, best_home, best_draw, best_away,
  1 / best_home + 1 / best_draw + 1 / best_away t from m join en using (match_id) left join fe using (home_team, away_team) left join (select id, best_home, best_draw, best_away from ev) ev on ev.id = fe.id
  where m.status in ('SCHEDULED', 'IN_PLAY')),
 pe as (select *, case when has then round(home_p - 1 / best_home / t, 4) end edge_home, case when has then round(draw_p - 1 / best_draw / t, 4) end edge_draw, case when has then round(away_p - 1 / best_away / t, 4) end edge_away,
  case when home_p = greatest(home_p, draw_p, away_p) then 'HOME' when draw_p = greatest(home_p, draw_p, away_p) then 'DRAW' else 'AWAY' end outcome, greatest(home_p, draw_p, away_p) confidence from ps)"""
_PS = (V.M, V.P, PROBS, V.O, AVERAGE, PRICED, SCORES)


def _pipeline(spark, d) -> DataFrame:
    m = _matches(spark, d).where(F.col("status").isin("SCHEDULED", "IN_PLAY"))
    p = consensus.with_probabilities(V.predictions(spark, d)).where(F.col("source").isin("S0", "S1", "S2"))
    latest = merge.first_per_key(p, ["match_id", "source"], *_newest())
    name = F.when(F.col("source") == "S0", "gbt").when(F.col("source") == "S1", "mlp").otherwise("forest")
    scores = latest.select("match_id", name.alias("model"), "home_p", "draw_p", "away_p")
    out = attach.pipeline_scores(m.select("pos", "home", "away"), _priced(spark, d), scores)
    return out.join(m.select(F.col("pos").alias("match_id"), "home", "away", "league_code", "match_date"), "match_id")


@query(V.sql("""select match_id, n, home_p, draw_p, away_p, case when has then best_home else 2.5 end home_used, case when has then best_draw else 3.3 end draw_used, case when has then best_away else 3.0 end away_used,
 edge_home, edge_draw, edge_away, outcome, confidence, 'ensemble_v1_' || cast(n as varchar) || 'models' model_version,
 case when greatest(edge_home, edge_draw, edge_away) > 0.03 and case when edge_home = greatest(edge_home, edge_draw, edge_away) then home_p when edge_draw = greatest(edge_home, edge_draw, edge_away) then draw_p else away_p end > 0.5
  then case when edge_home = greatest(edge_home, edge_draw, edge_away) then 'HOME' when edge_draw = greatest(edge_home, edge_draw, edge_away) then 'DRAW' else 'AWAY' end end recommended from pe""", *_PS))
def pipeline_scores(spark, d):
    """Ensemble, edges and recommendation of the matches to be played; three sources stand for the models."""
    return _pipeline(spark, d).drop("home", "away", "league_code", "match_date", "has_odds")


@query(V.sql(f"""select {H0} home_team_name, {A0} away_team_name, cast(null as bigint) home_score, cast(null as bigint) away_score, 'SCHEDULED' status, match_date, league_code league_name
 from m where status in ('SCHEDULED', 'IN_PLAY') and match_date >= date '1996-01-01'""", V.M))
def upcoming_view(spark, d):
    """Served list of matches from a day on that are to be played."""
    return serving.upcoming_view(_matches(spark, d).withColumn("league_name", F.col("league_code")), "1996-01-01")


@query(V.sql(f"""select match_id, {H0} home_team, {A0} away_team, league_code league, match_date, outcome predicted_outcome, cast(round(confidence * 100) as bigint) confidence, cast(round(home_p * 100) as bigint) home_prob,
 cast(round(draw_p * 100) as bigint) draw_prob, cast(round(away_p * 100) as bigint) away_prob, 'ML Ensemble' sources, outcome consensus from pe""", *_PS))
def predictions_view(spark, d):
    """Served ensemble predictions with whole percentages."""
    return serving.predictions_view(_pipeline(spark, d))


@query(V.sql(f"""select {H0} home_team, {A0} away_team, league_code league, match_date, case when has and best_home > 0 then best_home else round(100 / greatest(home_p * 100, 1), 2) end odds_1,
 case when has and best_draw > 0 then best_draw else round(100 / greatest(draw_p * 100, 1), 2) end odds_x, case when has and best_away > 0 then best_away else round(100 / greatest(away_p * 100, 1), 2) end odds_2, outcome ai_prediction,
 cast(round(confidence * 100) as bigint) ai_confidence, coalesce(case outcome when 'HOME' then edge_home when 'DRAW' then edge_draw else edge_away end, 0) > 0.03 value_bet,
 coalesce(case outcome when 'HOME' then edge_home when 'DRAW' then edge_draw else edge_away end, 0) * 100 value_edge from pe""", *_PS))
def odds_view(spark, d):
    """Served odds and predictions; a match without odds has those of its probabilities."""
    return serving.odds_view(_pipeline(spark, d))


NAMED_CONSENSUS = """ai as (select m.home_team, m.away_team, outcome prediction, confidence from (select match_id, case tip when '1' then 'HOME' when 'X' then 'DRAW' else 'AWAY' end outcome, greatest(home_p, draw_p, away_p) confidence from pp
  where source in ('S1', 'S2')) join m using (match_id)),
 ml as (select m.home_team, m.away_team, outcome prediction, confidence from (select match_id, case tip when '1' then 'HOME' when 'X' then 'DRAW' else 'AWAY' end outcome, greatest(home_p, draw_p, away_p) confidence from pp
  where source = 'S0') join m using (match_id)),
 a1 as (select * from ai qualify row_number() over (partition by home_team, away_team order by confidence desc, prediction desc) = 1), m1 as (select * from ml qualify row_number() over (partition by home_team, away_team order by confidence desc, prediction desc) = 1),
 nc as (select coalesce(a1.home_team, m1.home_team) home_team, coalesce(a1.away_team, m1.away_team) away_team, a1.prediction w, m1.prediction o from a1 full join m1 on a1.home_team = m1.home_team and a1.away_team = m1.away_team)"""


@query(V.sql("""select 'team' || cast(home_team as varchar) || '_vs_' || 'team' || cast(away_team as varchar) as key, case when w is null then 'ML Ensemble' when o is null then 'AI Sites' else 'AI Sites,ML Ensemble' end sources,
 cast(case when w = o then 2 else 1 end as bigint) agreement_level, case when w = o then w when w is null then o when o is null then w end agreed_outcome, coalesce(w = o, false) all_agree from nc""", V.M, V.P, PROBS, NAMED_CONSENSUS))
def consensus_by_names(spark, d):
    """Consensus of two sides joined on the key of their names, which carry different club suffixes."""
    p = consensus.with_probabilities(V.predictions(spark, d)).select("match_id", "source", X.normal_outcome(F.col("tip")).alias("prediction"), F.greatest("home_p", "draw_p", "away_p").alias("confidence"))
    rows = p.join(V.matches(spark, d).select("match_id", "home_team", "away_team"), "match_id")
    team = lambda c, before, after: F.concat(F.lit(before + "Team"), F.col(c).cast("string"), F.lit(after)).alias(c.removesuffix("_team"))
    ai = rows.where("source in ('S1', 'S2')").select(team("home_team", "FC ", ""), team("away_team", "", " Calcio"), "prediction", "confidence")
    ml = rows.where("source = 'S0'").select(team("home_team", "", " FC"), team("away_team", "", ""), "prediction", "confidence")
    return attach.consensus_by_names(ai, ml)


@query("""with n as (select p_name as name, min(p_partkey) id from part group by p_name), w as (select id, name, split_part(name, ' ', 1) a, split_part(name, ' ', 2) b from n),
 st as (select a h, b w, id as value from w where id % 2 = 0),
 q as (select id, case id % 3 when 0 then a when 1 then a || ' x' else substr(a, 2) end h, case id % 3 when 0 then b when 1 then b || ' y' else substr(b, 2) end w from w where id % 5 < 3),
 t0 as (select q.id, min(value) v from q join st on q.h = st.h and q.w = st.w group by q.id),
 t1 as (select q.id, min(value) v from q join st on split_part(q.h, ' ', 1) = split_part(st.h, ' ', 1) and split_part(q.w, ' ', 1) = split_part(st.w, ' ', 1) group by q.id),
 t2 as (select q.id, min(value) v from q join st on (contains(q.h, st.h) or contains(st.h, q.h)) and (contains(q.w, st.w) or contains(st.w, q.w)) where q.h <> '' and q.w <> '' group by q.id)
 select q.id, q.h home, q.w away, cast(case when t0.v is not null then 0 when t1.v is not null then 1 when t2.v is not null then 2 end as bigint) tier, coalesce(t0.v, t1.v, t2.v) as value
 from q left join t0 using (id) left join t1 using (id) left join t2 using (id)""")
def pair_lookup(spark, d):
    """Pairs of names looked up exactly, then by their first words, then by containment."""
    t = V.teams(spark, d)
    a, b = F.split("name", " ")[0], F.split("name", " ")[1]
    stored = t.where("id % 2 = 0").select(a.alias("home"), b.alias("away"), F.col("id").alias("value"))
    form = lambda c, tail: F.when(F.col("id") % 3 == 0, c).when(F.col("id") % 3 == 1, F.concat(c, F.lit(tail))).otherwise(F.expr(f"substr({'split(name, chr(32))[0]' if tail == ' x' else 'split(name, chr(32))[1]'}, 2)"))
    asked = t.where("id % 5 < 3").select("id", form(a, " x").alias("home"), form(b, " y").alias("away"))
    return entity.pair_lookup(asked, stored)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


# Spellings of each kind: upper case and blanks around, an alias, a prefix before an alias, an accent, suffixes and prefixes of each scope, punctuation.
# name, canonical, legacy id form, merge key, site key, bookmaker key.
SPELLINGS = (
    ("  PSG ", "paris saint germain", "psg", "psg", "psg", "psg"),
    ("Paris Saint-Germain FC", "paris saint-germain fc", "paris_saint_germain", "paris saintgermain", "paris saintgermain", "psg"),
    ("AC Milan", "milan", "milan", "milan", "milan", "milan"),
    ("FC Bayern München", "bayern munich", "bayern_m_nchen", "bayern munchen", "bayern munchen", "bayern"),
    ("Atlético Madrid", "atletico de madrid", "atl_tico_madrid", "atletico madrid", "atletico madrid", "atletico"),
    ("Fenerbahçe SK", "fenerbahçe sk", "fenerbah_e_sk", "fenerbahce", "fenerbahce", "fenerbahce"),
    ("Sheff Utd", "sheffield united", "sheff_utd", "sheff utd", "sheffield united", "sheffield united"),
    ("1. FC Heidenheim", "1. fc heidenheim", "1_fc_heidenheim", "1 fc heidenheim", "1 fc heidenheim", "fc heidenheim"),
    ("Real Betis Balompié", "real betis balompié", "betis_balompi", "real betis balompie", "real betis balompie", "real betis"),
)


@query(f"""with v as (select * from (values {_values(SPELLINGS)}) t(name, canonical, legacy, merged, site, bookmaker))
 select p_partkey id, (select list(name order by name) from v)[p_partkey % {len(SPELLINGS)} + 1] as name, v.canonical, v.legacy, v.merged, v.site, v.bookmaker from part
 join v on v.name = (select list(name order by name) from v)[p_partkey % {len(SPELLINGS)} + 1]""")
def name_spellings(spark, d):
    """Awkward spellings through all normalisers: aliases, prefixes, suffixes, accents and punctuation."""
    listed = F.array(*[F.lit(s) for s in sorted(s[0] for s in SPELLINGS)])
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.element_at(listed, (F.col("p_partkey") % len(SPELLINGS)).cast("int") + 1).alias("name"))
    n = F.col("name")
    return rows.select("id", "name", N.canonical_name(n).alias("canonical"), N.legacy_name(n).alias("legacy"), N.merge_name(n).alias("merged"), N.site_name(n).alias("site"), N.bookmaker_name(n).alias("bookmaker"))

