"""Queries that write captured payloads of each feed from the driver tables and parse them again.

The payloads hold what the providers send besides plain values: missing scores,
statuses of their own, several forms of a date, teams in either order, blanks.
The SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.operators import odds, stats
from fixturelake.plans import views as V
from fixturelake.plans.catalogue import AVERAGE, STATS, query
from fixturelake.sources import html, json_feeds

C = F.col
H, A = (V.club_sql(t, 0) for t in ("home_team", "away_team"))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


#: Numbers in a range: a payload holds at most as many entries.
RANGE = 20_000


def part_of(number: str, size: int = RANGE) -> Column:
    return F.floor(C(number) / size).alias("part")


def _bodies(rows: DataFrame, entry: Column, field: str | None = "events", *by) -> DataFrame:
    """One payload per key (day, league and range of numbers by default) with the entries as a list, under a field or bare."""
    keys = by or (F.to_date("match_date").alias("day"), F.col("league_code"), part_of("match_id"))
    listed = rows.select(*keys, entry.alias("entry"))
    names = [c for c in listed.columns if c != "entry"]
    grouped = listed.groupBy(*names).agg(F.collect_list("entry").alias(field or "entries"))
    body = F.to_json(F.struct(field)) if field else F.to_json("entries")
    return grouped.select(*names, body.alias("body"))


@query(V.sql(f"""select cast(match_id as varchar) api_id, match_date, {H} home_team, {A} away_team, case when status <> 'SCHEDULED' then cast(home_score as int) end home_score,
 case when status <> 'SCHEDULED' then cast(away_score as int) end away_score, status, cast(match_id % 90 as varchar) as minute, 'V' || cast(match_id % 7 as varchar) venue from m""", V.M))
def feed_scoreboard(spark, d):
    """Scoreboards: competitors in either order, statuses pre, in and post."""
    m = V.named(spark, d)
    side = lambda kind, team, score: F.struct(F.lit(kind).alias("homeAway"), _text(score).alias("score"), F.struct(C(team).alias("displayName")).alias("team"))
    home, away = side("home", "home", "home_score"), side("away", "away", "away_score")
    both = F.when(C("match_id") % 2 == 0, F.array(home, away)).otherwise(F.array(away, home))
    state = F.when(C("status") == "FINISHED", "post").when(C("status") == "IN_PLAY", "in").otherwise("pre")
    status = F.struct(_text(C("match_id") % 90).alias("displayClock"), F.struct(state.alias("state")).alias("type"))
    venue = F.struct(F.concat(F.lit("V"), _text(C("match_id") % 7)).alias("fullName"))
    event = F.struct(_text("match_id").alias("id"), F.date_format("match_date", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.array(F.struct(both.alias("competitors"), status.alias("status"), venue.alias("venue"))).alias("competitions"))
    return _with_plain_time(json_feeds.scoreboard(_bodies(m, event)))


def _with_plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("match_date", C("match_date").cast("timestamp_ntz"))


def _league_entry(progress: bool) -> Column:
    done = C("status") == "FINISHED"
    score = lambda c: F.when(done | progress, _text(c)).otherwise("")
    live = F.when(done, "Match FT").when(C("match_id") % 3 == 0, "HT").otherwise(_text(C("match_id") % 90))
    return F.struct(
        _text("match_id").alias("idEvent"), F.when(C("league_code") == "L0", "English Premier League").when(C("league_code") == "L1", "German Bundesliga").otherwise("Local Cup").alias("strLeague"),
        F.concat(_text("season"), F.lit("-"), _text(C("season") + 1)).alias("strSeason"), _text(C("match_id") % 38).alias("intRound"),
        F.date_format("match_date", "yyyy-MM-dd").alias("dateEvent"), F.lit("20:45:00").alias("strTime"), C("home").alias("strHomeTeam"), C("away").alias("strAwayTeam"),
        score("home_score").alias("intHomeScore"), score("away_score").alias("intAwayScore"), live.alias("strProgress"),
    )


_CODE = "case league_code when 'L0' then 'PL' when 'L1' then 'BL1' else '' end"


@query(V.sql(f"""select cast(match_id as varchar) api_id, {_CODE} league_code, cast(season as int) season, date_trunc('day', match_date) + interval '20 hours 45 minutes' match_date, {H} home_team, {A} away_team,
 case when status = 'FINISHED' then cast(home_score as int) end home_score, case when status = 'FINISHED' then cast(away_score as int) end away_score,
 case when status = 'FINISHED' then 'FINISHED' else 'SCHEDULED' end status, cast(match_id % 38 as int) matchday from m""", V.M))
def feed_league_day(spark, d):
    """Days of a league: a score makes a match finished, a league's name gives its code, a season's text its first year."""
    return _with_plain_time(json_feeds.league_day(_bodies(V.named(spark, d), _league_entry(False))))


@query(V.sql(f"""select cast(match_id as varchar) api_id, {_CODE} league_code, {H} home_team, {A} away_team, cast(home_score as int) home_score, cast(away_score as int) away_score,
 case when status = 'FINISHED' then 'FINISHED' when match_id % 3 = 0 then 'HALFTIME' else 'IN_PLAY' end status,
 case when status = 'FINISHED' then 'Match FT' when match_id % 3 = 0 then 'HT' else cast(match_id % 90 as varchar) end as minute from m""", V.M))
def feed_livescore(spark, d):
    """Live events: the progress text tells full time, half time or the minute."""
    return json_feeds.livescore(_bodies(V.named(spark, d), _league_entry(True)))


@query(V.sql(f"""select match_id api_id, 'BL1' league_code, match_date, {H} home_team, {A} away_team, case when status = 'FINISHED' then cast(home_score as int) end home_score,
 case when status = 'FINISHED' then cast(away_score as int) end away_score, cast(home_score // 2 as int) ht_home_score, case when status = 'FINISHED' then 'FINISHED' else 'SCHEDULED' end status,
 cast(match_id % 34 as int) matchday from m""", V.M))
def feed_result_list(spark, d):
    """Bare lists of matches with typed results: half time first, the final score only when there is one."""
    one = lambda kind, h, a: F.struct(F.lit(kind).alias("resultTypeID"), h.cast("int").alias("pointsTeam1"), a.cast("int").alias("pointsTeam2"))
    half = one(1, F.floor(C("home_score") / 2), F.floor(C("away_score") / 2))
    results = F.when(C("status") == "FINISHED", F.array(half, one(2, C("home_score"), C("away_score")))).otherwise(F.array(half))
    entry = F.struct(
        C("match_id").alias("matchID"), F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("matchDateTimeUTC"), (C("status") == "FINISHED").alias("matchIsFinished"),
        F.struct((C("match_id") % 34).cast("int").alias("groupOrderID")).alias("group"), F.struct(C("home").alias("teamName")).alias("team1"), F.struct(C("away").alias("teamName")).alias("team2"), results.alias("matchResults"),
    )
    return _with_plain_time(json_feeds.result_list(_bodies(V.named(spark, d), entry, None)))


@query(V.sql(f"""select match_id api_id, league_code, cast(season as int) season, match_date, case when match_id % 4 = 0 then 'SCHEDULED' else status end status, cast(match_id % 38 as int) matchday, {H} home_team, {A} away_team,
 case when status = 'FINISHED' then cast(home_score as int) end home_score, case when status = 'FINISHED' then cast(away_score as int) end away_score, cast(0 as int) ht_home_score, cast(null as int) ht_away_score,
 case when match_id % 3 = 0 then 1.5 end home_odds, case when match_id % 3 = 0 then 3.25 end draw_odds, case when match_id % 3 = 0 then 6.0 end away_odds, case when match_id % 5 = 0 then 'R' || cast(match_id % 11 as varchar) end referee from m""", V.M))
def feed_matches(spark, d):
    """Matches with full and half time, odds and referees, each of which may be missing."""
    done = C("status") == "FINISHED"
    pair = lambda h, a: F.struct(h.cast("int").alias("home"), a.cast("int").alias("away"))
    full = pair(F.when(done, C("home_score")), F.when(done, C("away_score")))
    price = F.when(C("match_id") % 3 == 0, F.struct(F.lit(1.5).alias("homeWin"), F.lit(3.25).alias("draw"), F.lit(6.0).alias("awayWin")))
    referee = F.when(C("match_id") % 5 == 0, F.array(F.struct(F.concat(F.lit("R"), _text(C("match_id") % 11)).alias("name")), F.struct(F.lit("second").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    entry = F.struct(
        C("match_id").alias("id"), F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcDate"), F.when(C("match_id") % 4 == 0, "TIMED").otherwise(C("status")).alias("status"),
        (C("match_id") % 38).cast("int").alias("matchday"), F.struct(C("league_code").alias("code")).alias("competition"), F.struct(F.concat(_text("season"), F.lit("-08-16")).alias("startDate")).alias("season"),
        F.struct(C("home").alias("name")).alias("homeTeam"), F.struct(C("away").alias("name")).alias("awayTeam"),
        F.struct(full.alias("fullTime"), pair(F.lit(0), F.lit(None)).alias("halfTime")).alias("score"), price.alias("odds"), referee.alias("referees"),
    )
    return _with_plain_time(json_feeds.matches_feed(_bodies(V.named(spark, d), entry, "matches")))


@query(V.sql(f"""select match_id api_id, case league_code when 'L0' then 'PL' when 'L1' then 'PD' when 'L2' then 'BL1' when 'L3' then 'SA' end league_code, cast(season as int) season, match_date,
 case status when 'FINISHED' then case when match_id % 2 = 0 then 'FINISHED' else 'FINISHED' end when 'IN_PLAY' then case when match_id % 2 = 0 then 'HALFTIME' else 'IN_PLAY' end else case when match_id % 2 = 0 then 'POSTPONED' else 'SCHEDULED' end end status,
 {H} home_team, {A} away_team, case when status <> 'SCHEDULED' then cast(home_score as int) end home_score, case when status <> 'SCHEDULED' then cast(away_score as int) end away_score,
 case when status <> 'SCHEDULED' then cast(0 as int) end ht_home_score, case when match_id % 5 = 0 then 'R' end referee from m""", V.M))
def feed_fixtures(spark, d):
    """Fixtures with short status codes and provider numbers of leagues, one of them unknown."""
    even, started = C("match_id") % 2 == 0, C("status") != "SCHEDULED"
    short = F.when(C("status") == "FINISHED", F.when(even, "FT").otherwise("PEN")).when(C("status") == "IN_PLAY", F.when(even, "HT").otherwise("2H")).otherwise(F.when(even, "PST").otherwise("NS"))
    league = F.when(C("league_code") == "L0", 39).when(C("league_code") == "L1", 140).when(C("league_code") == "L2", 78).when(C("league_code") == "L3", 135).otherwise(9999)
    pair = lambda h, a: F.struct(F.when(started, h.cast("int")).alias("home"), F.when(started, a.cast("int")).alias("away"))
    entry = F.struct(
        F.struct(C("match_id").alias("id"), F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"), F.when(C("match_id") % 5 == 0, "R").alias("referee"), F.struct(short.alias("short")).alias("status")).alias("fixture"),
        F.struct(league.alias("id"), C("season").cast("int").alias("season")).alias("league"), F.struct(F.struct(C("home").alias("name")).alias("home"), F.struct(C("away").alias("name")).alias("away")).alias("teams"),
        pair(C("home_score"), C("away_score")).alias("goals"), F.struct(pair(F.lit(0), F.lit(0)).alias("halftime")).alias("score"),
    )
    return _with_plain_time(json_feeds.fixtures_feed(_bodies(V.named(spark, d), entry, "response")))


@query(V.sql("""select match_id fixture_id, best_home home_odds, best_draw draw_odds, case when match_id % 6 <> 0 then best_away end away_odds from ao""", V.O, AVERAGE))
def feed_bookmakers(spark, d):
    """Odds of the first bookmaker's match-winner market among other markets and bookmakers."""
    b = odds.average_and_best(V.quotes(spark, d))
    value = lambda k, o: F.struct(F.lit(k).alias("value"), _text(o).alias("odd"))
    none = F.lit(None).cast("struct<value:string,odd:string>")
    winner = F.struct(F.lit("Match Winner").alias("name"), F.array_compact(F.array(value("Home", "best_home"), value("Draw", "best_draw"), F.when(C("match_id") % 6 != 0, value("Away", "best_away")).otherwise(none))).alias("values"))
    other = F.struct(F.lit("Goals").alias("name"), F.array(value("Home", F.lit("9.9"))).alias("values"))
    first = F.struct(F.lit("one").alias("name"), F.array(other, winner).alias("bets"))
    second = F.struct(F.lit("two").alias("name"), F.array(F.struct(F.lit("Match Winner").alias("name"), F.array(value("Home", F.lit("99"))).alias("values"))).alias("bets"))
    bodies = b.select(C("match_id").alias("fixture_id"), F.to_json(F.struct(F.array(F.struct(F.array(first, second).alias("bookmakers"))).alias("response"))).alias("body"))
    return json_feeds.bookmaker_odds(bodies)


@query(V.sql(f"""select match_id fixture_id, {H} winner, match_id % 2 = 0 win_or_draw, '-2.5' under_over, '-' || cast(home_score as varchar) goals_home, cast(away_score as varchar) goals_away, 'Double chance' advice,
 cast(45 as double) home_pct, cast(30 as double) draw_pct, case when match_id % 4 <> 0 then cast(25 as double) end away_pct from m""", V.M))
def feed_advice(spark, d):
    """A provider's own predictions: winner, goals and percentages, one of which may not be a number."""
    m = V.named(spark, d)
    p = F.struct(
        F.struct(C("home").alias("name")).alias("winner"), (C("match_id") % 2 == 0).alias("win_or_draw"), F.lit("-2.5").alias("under_over"),
        F.struct(F.concat(F.lit("-"), _text("home_score")).alias("home"), _text("away_score").alias("away")).alias("goals"), F.lit("Double chance").alias("advice"),
        F.struct(F.lit("45%").alias("home"), F.lit("30%").alias("draw"), F.when(C("match_id") % 4 == 0, "n/a").otherwise("25%").alias("away")).alias("percent"),
    )
    return json_feeds.advice(m.select(C("match_id").alias("fixture_id"), F.to_json(F.struct(F.array(F.struct(p.alias("predictions"))).alias("response"))).alias("body")))


_TABLE = "lt as (select *, row_number() over (partition by league_code, season order by 3 * wins + draws desc, goals_scored - goals_conceded desc, goals_scored desc, team) pos from ts)"


@query(V.sql(f"""select league_code, season, cast(pos as int) as position, {V.club_sql('team', 0)} team, cast(matches_played as int) played, cast(3 * wins + draws as int) points, cast(goals_scored - goals_conceded as int) goal_difference
 from lt""", V.M, V.F_, V.SIDES, STATS, _TABLE))
def feed_standings(spark, d):
    """League tables in two providers' forms, one with a home table before the total one."""
    table = stats.team_season_stats(stats.sides(V.matches(spark, d)))
    order = [F.desc("p"), F.desc("g"), F.desc("goals_scored"), C("team")]
    t = table.select("league_code", "season", "team", V.club("team", 0).alias("name"), "matches_played", "goals_scored", (3 * C("wins") + C("draws")).alias("p"), (C("goals_scored") - C("goals_conceded")).alias("g"))
    t = t.withColumn("pos", F.row_number().over(W.partitionBy("league_code", "season").orderBy(*order)))
    team = F.struct(C("team").cast("long").alias("id"), C("name").alias("name")).alias("team")
    one = F.struct(C("pos").alias("position"), team, C("matches_played").cast("int").alias("playedGames"), C("p").cast("int").alias("points"), C("g").cast("int").alias("goalDifference"))
    two = F.struct(C("pos").alias("rank"), team, C("p").cast("int").alias("points"), C("g").cast("int").alias("goalsDiff"), F.struct(C("matches_played").cast("int").alias("played")).alias("all"))
    rows = t.groupBy("league_code", "season").agg(F.collect_list(one).alias("one"), F.collect_list(two).alias("two"))
    kinds = F.array(F.struct(F.lit("HOME").alias("type"), F.slice("one", 1, 1).alias("table")), F.struct(F.lit("TOTAL").alias("type"), C("one").alias("table")))
    first = F.to_json(F.struct(kinds.alias("standings")))
    second = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(C("two"), F.slice("two", 1, 1)).alias("standings")).alias("league"))).alias("response")))
    return json_feeds.standings(rows.select("league_code", "season", F.when(C("season") % 2 == 0, first).otherwise(second).alias("body")))


@query(V.sql(f"""select {V.club_sql('team', 0)} team, case league_code when 'L0' then 'PL' when 'L1' then 'PD' when 'L2' then 'BL1' when 'L3' then 'BSA' end league_code, cast(season as int) season, cast(matches_played as int) matches_played, cast(wins as int) wins, cast(draws as int) draws,
 cast(losses as int) losses, cast(goals_scored as int) goals_scored, cast(goals_conceded as int) goals_conceded, cast(clean_sheets as int) clean_sheets, cast(home_wins as int) home_wins, cast(away_wins as int) away_wins,
 cast(home_draws as int) home_draws, cast(away_draws as int) away_draws, cast(home_losses as int) home_losses, cast(away_losses as int) away_losses, cast(home_goals_scored as int) home_goals_scored, cast(away_goals_scored as int) away_goals_scored,
 cast(home_goals_conceded as int) home_goals_conceded, cast(away_goals_conceded as int) away_goals_conceded, 'WDL' form from ts""", V.M, V.F_, V.SIDES, STATS))
def feed_team_statistics(spark, d):
    """A provider's statistics of each team's season; one league's number is unknown."""
    t = stats.team_season_stats(stats.sides(V.matches(spark, d)))
    three = lambda n: F.struct(C(f"home_{n}").cast("int").alias("home"), C(f"away_{n}").cast("int").alias("away"), C(n).cast("int").alias("total"))
    alone = lambda n: F.struct(C(n).cast("int").alias("total"))
    response = F.struct(
        F.struct(C("team").cast("long").alias("id"), V.club("team", 0).alias("name")).alias("team"), F.struct(F.when(C("league_code") == "L0", 39).when(C("league_code") == "L1", 140).when(C("league_code") == "L2", 78).when(C("league_code") == "L3", 71).otherwise(9999).alias("id"), C("season").cast("int").alias("season")).alias("league"),
        F.lit("WDL").alias("form"), F.struct(alone("matches_played").alias("played"), three("wins").alias("wins"), three("draws").alias("draws"), three("losses").alias("loses")).alias("fixtures"),
        F.struct(F.struct(three("goals_scored").alias("total")).alias("for"), F.struct(three("goals_conceded").alias("total")).alias("against")).alias("goals"), alone("clean_sheets").alias("clean_sheet"),
    )
    return json_feeds.team_statistics(t.select(F.to_json(F.struct(response.alias("response"))).alias("body")))


@query("select p_partkey api_id, p_name as name, split_part(p_name, ' ', 1) short_name, 'Country ' || cast(p_partkey % 9 as varchar) country, 'https://logo.example/' || cast(p_partkey as varchar) logo_url from part")
def feed_teams(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    entry = F.struct(
        C("p_partkey").alias("id"), C("p_name").alias("name"), F.split("p_name", " ")[0].alias("shortName"), F.concat(F.lit("https://logo.example/"), _text("p_partkey")).alias("crest"),
        F.struct(F.concat(F.lit("Country "), _text(C("p_partkey") % 9)).alias("name")).alias("area"),
    )
    return json_feeds.teams(_bodies(p, entry, "teams", part_of("p_partkey", 500)))


def _offer_bodies(spark, d, shown: Column) -> DataFrame:
    """Offer payloads per day and league in three labellings of the result market; shown is the league's label."""
    m = V.named(spark, d).join(odds.average_and_best(V.quotes(spark, d)), "match_id")
    milli = lambda c: F.round(C(c) * 1000).cast("long")
    one = lambda label, c: F.struct(F.lit(label).alias("label"), milli(c).alias("odds"))
    kind = C("match_id") % 3
    label = F.when(kind == 0, "Fuld tid").when(kind == 1, "Resultat").otherwise("Whatever")
    number = F.when(kind == 2, 2).otherwise(77)
    offer = lambda text, number, *o: F.struct(F.struct(text.alias("label")).alias("criterion"), F.struct(number.alias("id")).alias("betOfferType"), F.array(*o).alias("outcomes"))
    bets = F.array(
        offer(label, number, one("1", "best_home"), one("X", "best_draw"), one("2", "best_away")), offer(F.lit("Antal mål"), F.lit(6), one("Over 2.5", "best_home"), one("Under 2.5", "best_away")),
        offer(F.lit("Begge hold scorer"), F.lit(9), one("Ja", "best_draw"), one("Nej", "best_away")),
    )
    sep = F.when(kind == 0, " - ").when(kind == 1, " vs ").otherwise(" v ")
    name = F.concat("home", sep, "away")
    event = F.struct(C("match_id").alias("id"), name.alias("name"), name.alias("englishName"), F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), F.lit("NOT_STARTED").alias("state"), F.array(F.struct(F.lit("Fodbold").alias("name")), F.struct(shown.alias("name"))).alias("path"))
    return _bodies(m, F.struct(event.alias("event"), bets.alias("betOffers")))


_OFFERS = f"""select m.match_id event_id, {H} home_team, {A} away_team, round(best_home, 3) home_odds, round(best_draw, 3) draw_odds, round(best_away, 3) away_odds, round(best_home, 3) over_25_odds, round(best_away, 3) under_25_odds,
 round(best_draw, 3) btts_yes_odds, round(best_away, 3) btts_no_odds, """
_OFFER_COLUMNS = ("event_id", "home_team", "away_team", "home_odds", "draw_odds", "away_odds", "over_25_odds", "under_25_odds", "btts_yes_odds", "btts_no_odds", "league_code")


@query(V.sql(_OFFERS + """case league_code when 'L0' then 'PL' when 'L1' then 'PD' when 'L2' then 'BL1' when 'L3' then 'DK_SL' else '' end league_code from m join ao using (match_id)""", V.M, V.O, AVERAGE))
def odds_of_all_leagues(spark, d):
    """All football in one capture per day: labels of leagues, three markets, three separators of the teams."""
    shown = F.when(C("league_code") == "L0", "Premier League").when(C("league_code") == "L1", "LaLiga Santander").when(C("league_code") == "L2", "1. Bundesliga").when(C("league_code") == "L3", "Superligaen").otherwise("Other Cup")
    everything = _offer_bodies(spark, d, shown)
    return json_feeds.odds_scan(everything, everything.limit(0)).select(*_OFFER_COLUMNS)


@query(V.sql(_OFFERS + "league_code from m join ao using (match_id)", V.M, V.O, AVERAGE))
def odds_by_league(spark, d):
    """The common capture holds no event, so the leagues' captures are read and each one's code counts."""
    by_league = _offer_bodies(spark, d, F.lit("Premier League"))
    empty = by_league.withColumn("body", F.lit('{"events":[]}'))
    return json_feeds.odds_scan(empty, by_league).select(*_OFFER_COLUMNS)


@query(V.sql(_OFFERS + "league_code from m join ao using (match_id) where league_code = 'L2' and match_date >= date '1995-06-01' and match_date < date '1995-09-09'", V.M, V.O, AVERAGE))
def odds_of_days(spark, d):
    """Odds events of one league in a hundred days."""
    by_league = _offer_bodies(spark, d, F.lit("Bundesliga"))
    return json_feeds.odds_events(json_feeds.odds_scan(by_league, by_league, "L2"), "1995-06-01", 100).select(*_OFFER_COLUMNS)


@query(V.sql("""select match_id, league_code, case league_code when 'L0' then 'Premier League' when 'L1' then 'La Liga' when 'L2' then 'Bundesliga' when 'L3' then 'Série A' end league_name,
 case league_code when 'L0' then 'England' when 'L1' then 'Spain' when 'L2' then 'Germany' when 'L3' then 'Brazil' end league_country, case league_code when 'L0' then 39 when 'L1' then 140 when 'L2' then 78 when 'L3' then 71 end league_id from m""", V.M))
def league_dimension(spark, d):
    """Name, country and provider id of each match's league; an unknown league has none."""
    m = V.matches(spark, d).select("match_id", "league_code", F.when(C("league_code") == "L0", "PL").when(C("league_code") == "L1", "PD").when(C("league_code") == "L2", "BL1").when(C("league_code") == "L3", "BSA").otherwise("??").alias("code"))
    return json_feeds.with_league(m, "code").select("match_id", "league_code", "league_name", "league_country", "league_id")


@query(V.sql(f"""select {H} home_team, {A} away_team, cast(40 + match_id % 10 as int) home_win_pct, cast(30 as int) draw_pct, cast(20 + match_id % 7 as int) away_win_pct, case match_id % 3 when 0 then '1' when 1 then 'X' else '2' end predicted_winner,
 cast('1.' || cast(50 + match_id % 40 as varchar) as double) odds_best, cast(home_score as varchar) || '-' || cast(away_score as varchar) predicted_score, count(*) n from m group by all""", V.M))
def page_links(spark, d):
    """Result links of prediction pages with the numbers in the text behind them."""
    m = V.named(spark, d)
    tip = F.when(C("match_id") % 3 == 0, "1").when(C("match_id") % 3 == 1, "X").otherwise("2")
    name = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    # A tip before the percentages would be taken for one, so it stands behind them.
    row = F.concat(
        F.lit('<a href="/result/'), _text("match_id"), F.lit("/"), _text(C("match_id") % 5), F.lit("/"), name("home"), F.lit("/"), name("away"), F.lit('">x</a> <b>'), _text(40 + C("match_id") % 10), F.lit("</b> <b>30</b> <b>"),
        _text(20 + C("match_id") % 7), F.lit("</b> tip "), tip, F.lit(" at 1."), _text(50 + C("match_id") % 40), F.lit(" score "), _text("home_score"), F.lit("-"), _text("away_score"), F.lit("<p>"), F.repeat(F.lit("."), F.lit(600)), F.lit("</p>"),
    )
    pages = m.groupBy(F.concat_ws("/", F.to_date("match_date").cast("string"), part_of("match_id")).alias("url")).agg(F.array_join(F.collect_list(row), "\n").alias("html"))
    out = html.link_context(pages)
    return out.groupBy(*[c for c in out.columns if c != "url"]).agg(F.count(F.lit(1)).alias("n"))


@query(V.sql(f"""select {H} home_team, {A} away_team, cast(match_date as date) as day, tip, home_win_pct, draw_pct, away_win_pct, btts from (
 select *, case match_id % 3 when 0 then '1' when 1 then 'X' else '2' end tip, case when pos < 20 then cast(30 + match_id % 40 as int) end home_win_pct, case when pos < 20 then cast(20 as int) end draw_pct,
  case when pos < 20 then cast(50 - match_id % 40 as int) end away_win_pct, case when pos < 20 and match_id % 2 = 0 then 'Yes' end btts from (
  select *, row_number() over (partition by cast(match_date as date) order by match_id) - 1 pos from (select * from m qualify row_number() over (partition by cast(match_date as date), home_team, away_team order by match_id) = 1)))""", V.M))
def page_tips(spark, d):
    """Tips of each day's list, each pair of teams once, with the percentages of the first twenty detail pages."""
    m = V.named(spark, d).withColumn("day", F.to_date("match_date"))
    first = m.groupBy("day", "home", "away").agg(F.min("match_id").alias("match_id"))
    tip = F.when(C("match_id") % 3 == 0, "1").when(C("match_id") % 3 == 1, "X").otherwise("2")
    item = F.concat(F.lit("<h3>"), "home", F.lit(" vs "), "away", F.lit("</h3><i>"), tip, F.lit("</i>"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("match_id", item.alias("item")))), lambda x: x["item"])
    lists = first.groupBy(_text("day").alias("url")).agg(F.array_join(ordered, "\n").alias("html"))
    found = html.tip_list(lists, r"<h3>(.*?)</h3>", r"<i>(.*?)</i>", by=("url",))
    page = F.concat(
        F.lit("<b>"), "home", F.lit("</b> "), _text(30 + C("match_id") % 40), F.lit("% Draw 20% <b>"), "away", F.lit("</b> "), _text(50 - C("match_id") % 40), F.lit("% "), F.when(C("match_id") % 2 == 0, "btts yes").otherwise("none"),
    )
    details = first.select(_text("day").alias("url"), page.alias("html"), (F.row_number().over(W.partitionBy("day").orderBy("match_id")) - 1).alias("number"))
    out = html.with_details(found, details)
    return out.select("home_team", "away_team", F.to_date("url").alias("day"), "tip", "home_win_pct", "draw_pct", "away_win_pct", "btts")


@query(V.sql(f"""select {H} home_team, {A} away_team, min(match_id) filter (where match_id % 2 = 0) w1, min(match_id) filter (where match_id % 3 = 0) w2, coalesce(min(match_id % 100) filter (where match_id % 2 = 0), min(match_id % 100) filter (where match_id % 3 = 0)) as kickoff
 from m where match_id % 2 = 0 or match_id % 3 = 0 group by home_team, away_team""", V.M))
def page_blocks(spark, d):
    """Blocks of two markets' pages brought together per pair of teams; a shared column is the first market's."""
    m = V.named(spark, d)

    def market(rows: DataFrame, tag: str, name: str) -> DataFrame:
        block = F.concat(F.lit('<div class="game x"><b class="h">'), "home", F.lit('</b><b class="a"> '), "away", F.lit(" </b><i>"), _text("match_id"), F.lit("</i><u>"), _text(C("match_id") % 100), F.lit("</u></div>"))
        pages = rows.groupBy(F.concat_ws("/", F.to_date("match_date").cast("string"), part_of("match_id")).alias("url")).agg(F.concat(F.lit("<p>head</p>"), F.array_join(F.collect_list(block), "")).alias("html"))
        cut = html.blocks(pages, r'<div class="game[^"]*">', {"home_team": r'class="h">([^<]*)<', "away_team": r'class="a">([^<]*)<', name: r"<i>(\d+)</i>", "kickoff": r"<u>(\d+)</u>"})
        return cut.select("home_team", "away_team", C(name).cast("long").alias(name), C("kickoff").cast("long").alias("kickoff"))

    return html.merged_blocks(market(m.where("match_id % 2 = 0"), "1", "w1"), market(m.where("match_id % 3 = 0"), "2", "w2"))


@query(V.sql("""select source, count(*) n, count(tip) with_tip from (select 'one' source, tip from p where source = 'S0' union all select 'two', null from p where source = 'S1') group by source""", V.P))
def pages_of_all_sources(spark, d):
    """Prediction sources with different columns in one tagged table; one without rows adds nothing."""
    p = V.predictions(spark, d)
    out = html.all_sources(one=p.where("source = 'S0'").drop("source"), two=p.where("source = 'S1'").drop("source", "tip"), three=p.limit(0).drop("source"))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("tip").alias("with_tip"))

