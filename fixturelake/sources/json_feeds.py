"""JSON feeds, from captured payloads: one row per payload with the text in ``body``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.functions import scalars as X

# The parts of the feeds' schemas that are read.
SCOREBOARD = (
    "events array<struct<id:string,date:string,name:string,competitions:array<struct<competitors:array<struct<homeAway:string,score:string,"
    "team:struct<displayName:string,logo:string>>>,status:struct<displayClock:string,type:struct<state:string>>,venue:struct<fullName:string>>>>>"
)
LEAGUE_DAY = (
    "events array<struct<idEvent:string,strLeague:string,strSeason:string,intRound:string,dateEvent:string,strTime:string,strHomeTeam:string,"
    "strAwayTeam:string,intHomeScore:string,intAwayScore:string,strProgress:string,strVenue:string,strReferee:string>>"
)
RESULT_LIST = (
    "array<struct<matchID:long,matchDateTimeUTC:string,matchIsFinished:boolean,group:struct<groupOrderID:int>,team1:struct<teamName:string>,"
    "team2:struct<teamName:string>,matchResults:array<struct<resultTypeID:int,pointsTeam1:int,pointsTeam2:int>>>>"
)
MATCHES = (
    "matches array<struct<id:long,utcDate:string,status:string,matchday:int,competition:struct<code:string,name:string>,season:struct<startDate:string>,"
    "homeTeam:struct<id:long,name:string>,awayTeam:struct<id:long,name:string>,score:struct<fullTime:struct<home:int,away:int>,"
    "halfTime:struct<home:int,away:int>>,odds:struct<homeWin:double,draw:double,awayWin:double>,referees:array<struct<name:string>>>>"
)
FIXTURES = (
    "response array<struct<fixture:struct<id:long,date:string,referee:string,status:struct<short:string,elapsed:int>,venue:struct<name:string>>,"
    "league:struct<id:int,name:string,season:int,round:string>,teams:struct<home:struct<id:long,name:string>,away:struct<id:long,name:string>>,"
    "goals:struct<home:int,away:int>,score:struct<halftime:struct<home:int,away:int>>>>"
)
BOOKMAKERS = "response array<struct<bookmakers:array<struct<name:string,bets:array<struct<name:string,values:array<struct<value:string,odd:string>>>>>>>>"
ADVICE = (
    "response array<struct<predictions:struct<winner:struct<name:string>,win_or_draw:boolean,under_over:string,goals:struct<home:string,away:string>,"
    "advice:string,percent:struct<home:string,draw:string,away:string>>>>"
)
_TABLE_ROW = "position:int,rank:int,team:struct<id:long,name:string>,playedGames:int,points:int,goalDifference:int,goalsDiff:int,all:struct<played:int>"
STANDINGS = f"standings array<struct<type:string,table:array<struct<{_TABLE_ROW}>>>>, response array<struct<league:struct<standings:array<array<struct<{_TABLE_ROW}>>>>>>"
TEAM_STATISTICS = (
    "response struct<team:struct<id:long,name:string>,league:struct<id:int,season:int>,form:string,fixtures:struct<played:struct<home:int,away:int,total:int>,"
    "wins:struct<home:int,away:int,total:int>,draws:struct<home:int,away:int,total:int>,loses:struct<home:int,away:int,total:int>>,"
    "goals:struct<for:struct<total:struct<home:int,away:int,total:int>>,against:struct<total:struct<home:int,away:int,total:int>>>,clean_sheet:struct<home:int,away:int,total:int>>"
)
TEAMS = "teams array<struct<id:long,name:string,shortName:string,crest:string,area:struct<name:string>>>"
OFFERS = (
    "events array<struct<event:struct<id:long,name:string,englishName:string,start:string,state:string,path:array<struct<name:string>>>,"
    "betOffers:array<struct<criterion:struct<label:string>,betOfferType:struct<id:int,name:string>,outcomes:array<struct<label:string,odds:long>>>>>>"
)
# Provider ids of the leagues.
LEAGUE_IDS = {39: "PL", 140: "PD", 78: "BL1", 135: "SA", 61: "FL1", 2: "CL", 3: "EL", 88: "DED", 94: "PPL", 71: "BSA"}


def _parsed(captures: DataFrame, schema: str) -> DataFrame:
    return captures.withColumn("j", F.from_json("body", schema))


def _time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def scoreboard(captures: DataFrame) -> DataFrame:
    """First competition of each event; teams by homeAway, else by position."""
    e = _parsed(captures, SCOREBOARD).select(F.explode("j.events").alias("e")).select("e", F.get("e.competitions", F.lit(0)).alias("c"))

    def side(kind: str, place: int) -> Column:
        named = F.get(F.filter("c.competitors", lambda x: x["homeAway"] == kind), F.lit(0))
        return F.coalesce(named, F.get("c.competitors", F.lit(place)))

    e = e.select("e", "c", side("home", 0).alias("h"), side("away", 1).alias("a"), X.normal_status(F.col("c.status.type.state")).alias("status"))
    score = lambda k: F.when(F.col("status") != "SCHEDULED", X.lenient_int(F.col(f"{k}.score")))
    return e.select(
        F.col("e.id").alias("api_id"), _time(F.col("e.date")).alias("match_date"), F.col("h.team.displayName").alias("home_team"),
        F.col("a.team.displayName").alias("away_team"), score("h").alias("home_score"), score("a").alias("away_score"), "status",
        F.col("c.status.displayClock").alias("minute"), F.col("c.venue.fullName").alias("venue"),
    )


def league_day(captures: DataFrame) -> DataFrame:
    """Events of a league's day or season; a score makes a match finished."""
    e = _parsed(captures, LEAGUE_DAY).select(F.explode("j.events").alias("e"))
    done = (F.trim("e.intHomeScore") != "") & (F.trim("e.intAwayScore") != "")
    return e.select(
        F.col("e.idEvent").alias("api_id"), X.league_code(F.col("e.strLeague")).alias("league_code"), X.season_start(F.col("e.strSeason")).alias("season"),
        X.match_time(F.col("e.dateEvent"), F.substring("e.strTime", 1, 5)).alias("match_date"), F.col("e.strHomeTeam").alias("home_team"),
        F.col("e.strAwayTeam").alias("away_team"), X.lenient_int(F.col("e.intHomeScore")).alias("home_score"), X.lenient_int(F.col("e.intAwayScore")).alias("away_score"),
        F.when(done, "FINISHED").otherwise("SCHEDULED").alias("status"), X.lenient_int(F.col("e.intRound")).alias("matchday"),
    )


def livescore(captures: DataFrame) -> DataFrame:
    """Live events; the progress text tells full time and half time."""
    e = _parsed(captures, LEAGUE_DAY).select(F.explode("j.events").alias("e"))
    progress = F.upper(F.coalesce("e.strProgress", F.lit("")))
    status = F.when(progress.contains("FT"), "FINISHED").when(progress.contains("HT"), "HALFTIME").otherwise("IN_PLAY")
    return e.select(
        F.col("e.idEvent").alias("api_id"), X.league_code(F.col("e.strLeague")).alias("league_code"), F.col("e.strHomeTeam").alias("home_team"),
        F.col("e.strAwayTeam").alias("away_team"), X.lenient_int(F.col("e.intHomeScore")).alias("home_score"),
        X.lenient_int(F.col("e.intAwayScore")).alias("away_score"), status.alias("status"), F.col("e.strProgress").alias("minute"),
    )


def result_list(captures: DataFrame, league_code: str = "BL1") -> DataFrame:
    """Matches with typed results: type 2 is the final score, type 1 half time."""
    e = captures.select(F.explode(F.from_json("body", RESULT_LIST)).alias("e"))
    of = lambda t: F.get(F.filter("e.matchResults", lambda r: r["resultTypeID"] == t), F.lit(0))
    return e.select(
        F.col("e.matchID").alias("api_id"), F.lit(league_code).alias("league_code"), _time(F.col("e.matchDateTimeUTC")).alias("match_date"),
        F.col("e.team1.teamName").alias("home_team"), F.col("e.team2.teamName").alias("away_team"),
        of(2)["pointsTeam1"].alias("home_score"), of(2)["pointsTeam2"].alias("away_score"), of(1)["pointsTeam1"].alias("ht_home_score"),
        F.when(F.col("e.matchIsFinished"), "FINISHED").otherwise("SCHEDULED").alias("status"), F.col("e.group.groupOrderID").alias("matchday"),
    )


def matches_feed(captures: DataFrame) -> DataFrame:
    """Matches with full and half time, odds and first referee; season from its start date."""
    e = _parsed(captures, MATCHES).select(F.explode("j.matches").alias("e"))
    return e.select(
        F.col("e.id").alias("api_id"), F.col("e.competition.code").alias("league_code"), X.season_start(F.col("e.season.startDate")).alias("season"),
        _time(F.col("e.utcDate")).alias("match_date"), X.normal_status(F.col("e.status")).alias("status"), F.col("e.matchday").alias("matchday"),
        F.col("e.homeTeam.name").alias("home_team"), F.col("e.awayTeam.name").alias("away_team"),
        F.col("e.score.fullTime.home").alias("home_score"), F.col("e.score.fullTime.away").alias("away_score"),
        F.col("e.score.halfTime.home").alias("ht_home_score"), F.col("e.score.halfTime.away").alias("ht_away_score"),
        F.col("e.odds.homeWin").alias("home_odds"), F.col("e.odds.draw").alias("draw_odds"), F.col("e.odds.awayWin").alias("away_odds"),
        F.get("e.referees", F.lit(0))["name"].alias("referee"),
    )


def fixtures_feed(captures: DataFrame) -> DataFrame:
    """Fixtures with status codes and provider league ids; also the head-to-head feed."""
    e = _parsed(captures, FIXTURES).select(F.explode("j.response").alias("e"))
    codes = F.create_map(*[F.lit(x) for kv in LEAGUE_IDS.items() for x in kv])
    return e.select(
        F.col("e.fixture.id").alias("api_id"), F.try_element_at(codes, F.col("e.league.id")).alias("league_code"), F.col("e.league.season").alias("season"),
        _time(F.col("e.fixture.date")).alias("match_date"), X.normal_status(F.col("e.fixture.status.short")).alias("status"),
        F.col("e.teams.home.name").alias("home_team"), F.col("e.teams.away.name").alias("away_team"), F.col("e.goals.home").alias("home_score"),
        F.col("e.goals.away").alias("away_score"), F.col("e.score.halftime.home").alias("ht_home_score"), F.col("e.fixture.referee").alias("referee"),
    )


def bookmaker_odds(captures: DataFrame) -> DataFrame:
    """First bookmaker's match-winner odds of each payload, one row with three columns; captures has fixture_id."""
    b = _parsed(captures, BOOKMAKERS).select("fixture_id", F.get(F.get("j.response", F.lit(0))["bookmakers"], F.lit(0)).alias("b"))
    v = b.select("fixture_id", F.explode("b.bets").alias("bet")).where(F.col("bet.name") == "Match Winner").select("fixture_id", F.explode("bet.values").alias("v"))
    pick = lambda k: F.max(F.when(F.col("v.value") == k, F.col("v.odd").try_cast("double")))
    return v.groupBy("fixture_id").agg(pick("Home").alias("home_odds"), pick("Draw").alias("draw_odds"), pick("Away").alias("away_odds"))


def advice(captures: DataFrame) -> DataFrame:
    """The provider's own prediction with percentages as numbers."""
    p = _parsed(captures, ADVICE).select("fixture_id", F.get("j.response", F.lit(0))["predictions"].alias("p"))
    percent = lambda k: F.regexp_replace(f"p.percent.{k}", "%", "").try_cast("double").alias(f"{k}_pct")
    return p.select(
        "fixture_id", F.col("p.winner.name").alias("winner"), "p.win_or_draw", "p.under_over", F.col("p.goals.home").alias("goals_home"), F.col("p.goals.away").alias("goals_away"),
        "p.advice", percent("home"), percent("draw"), percent("away"),
    )


def standings(captures: DataFrame) -> DataFrame:
    """The total table or else the first one, of either provider's form."""
    j = _parsed(captures, STANDINGS)
    total = F.coalesce(F.get(F.filter("j.standings", lambda s: s["type"] == "TOTAL"), F.lit(0)), F.get("j.standings", F.lit(0)))["table"]
    first = F.get(F.get("j.response", F.lit(0))["league"]["standings"], F.lit(0))
    r = j.select(*captures.columns, F.explode(F.coalesce(total, first)).alias("r")).drop("body")
    return r.select(
        *[c for c in r.columns if c != "r"], F.coalesce("r.position", "r.rank").alias("position"), F.col("r.team.name").alias("team"),
        F.coalesce("r.playedGames", "r.all.played").alias("played"), "r.points", F.coalesce("r.goalDifference", "r.goalsDiff").alias("goal_difference"),
    )


def team_statistics(captures: DataFrame) -> DataFrame:
    """A team's season as the provider counts it: matches, results and goals at home, away and in all."""
    r = _parsed(captures, TEAM_STATISTICS).select("j.response.*")
    codes = F.create_map(*[F.lit(x) for kv in LEAGUE_IDS.items() for x in kv])
    counts = {"matches_played": "fixtures.played", "wins": "fixtures.wins", "draws": "fixtures.draws", "losses": "fixtures.loses", "goals_scored": "goals.for.total", "goals_conceded": "goals.against.total", "clean_sheets": "clean_sheet"}
    total = [F.col(f"{path}.total").alias(name) for name, path in counts.items()]
    split = [F.col(f"{path}.{at}").alias(f"{at}_{name}") for name, path in counts.items() if name in ("wins", "draws", "losses", "goals_scored", "goals_conceded") for at in ("home", "away")]
    return r.select(F.col("team.name").alias("team"), F.try_element_at(codes, F.col("league.id")).alias("league_code"), F.col("league.season").alias("season"), *total, *split, "form")


# Code, name, country and provider id of the leagues.
LEAGUES = (
    ("PL", "Premier League", "England", 39),
    ("PD", "La Liga", "Spain", 140),
    ("BL1", "Bundesliga", "Germany", 78),
    ("SA", "Serie A", "Italy", 135),
    ("FL1", "Ligue 1", "France", 61),
    ("CL", "Champions League", "Europe", 2),
    ("EL", "Europa League", "Europe", 3),
    ("DED", "Eredivisie", "Netherlands", 88),
    ("PPL", "Primeira Liga", "Portugal", 94),
    ("BSA", "Série A", "Brazil", 71),
)


def with_league(rows: DataFrame, code: str = "league_code") -> DataFrame:
    """Add name, country and provider id of the league; ten rows are broadcast."""
    known = rows.sparkSession.createDataFrame(LEAGUES, "code string, league_name string, league_country string, league_id int")
    return rows.join(F.broadcast(known.withColumnRenamed("code", code)), code, "left")


def teams(captures: DataFrame) -> DataFrame:
    t = _parsed(captures, TEAMS).select(F.explode("j.teams").alias("t"))
    return t.select(F.col("t.id").alias("api_id"), "t.name", F.col("t.shortName").alias("short_name"), F.col("t.area.name").alias("country"), F.col("t.crest").alias("logo_url"))


def offers(captures: DataFrame, link_base: str = "https://bookmaker.example/event", keep: tuple[str, ...] = ()) -> DataFrame:
    """Betting offers: one row per event with the odds of three markets, thousandths as decimals."""
    e = _parsed(captures, OFFERS).select(*keep, F.explode("j.events").alias("x")).select(*keep, F.col("x.event").alias("e"), "x.betOffers")
    title = F.when(N.split_teams(F.col("e.name"), 0) != "", F.col("e.name")).otherwise(F.col("e.englishName"))
    league = F.element_at(F.filter(F.transform("e.path", lambda p: p["name"]), lambda n: (n != "") & ~n.isin("Fodbold", "Football")), -1)
    e = e.select(*keep, "e", "betOffers", N.split_teams(title, 0).alias("home_team"), N.split_teams(title, 1).alias("away_team"), league.alias("league"))
    # One row per event and offered outcome; events without offers stay.
    long = e.where(F.col("home_team") != "").select(*keep, "e", "home_team", "away_team", "league", F.explode_outer("betOffers").alias("b"))
    long = long.select(*keep, "e", "home_team", "away_team", "league", F.col("b.betOfferType.id").alias("kind"), F.lower("b.criterion.label").alias("offer"), F.explode_outer("b.outcomes").alias("o"))
    # Labels of the three markets.
    result = F.col("offer").isin("resultat", "match", "fuld tid", "fuldtid", "kamp") | (F.coalesce("kind", F.lit(0)) == 2)
    goals = ~result & (F.col("offer").contains("over/under") | F.col("offer").contains("mål"))
    both = ~result & ~goals & (F.col("offer").contains("begge") | F.col("offer").contains("btts"))
    label, odds = F.trim("o.label"), F.nullif(F.col("o.odds"), F.lit(0)) / 1000
    pick = lambda when, name: F.max(F.when(when, odds)).alias(name)
    return long.groupBy(*keep, F.col("e.id").alias("event_id"), "home_team", "away_team", "league", F.col("e.start").alias("match_date"), F.coalesce("e.englishName", "e.name").alias("title")).agg(
        pick(result & (label == "1"), "home_odds"), pick(result & (label == "X"), "draw_odds"), pick(result & (label == "2"), "away_odds"),
        pick(goals & F.lower(label).contains("over"), "over_25_odds"), pick(goals & F.lower(label).contains("under"), "under_25_odds"),
        pick(both & F.lower(label).isin("ja", "yes"), "btts_yes_odds"), pick(both & F.lower(label).isin("nej", "no"), "btts_no_odds"),
    ).withColumn("league_code", F.coalesce(X.league_code(F.col("league")), F.lit(""))).withColumn("deeplink", X.deeplink(link_base, F.col("event_id"), F.col("title")))


def odds_scan(everything: DataFrame, by_league: DataFrame, league: str | None = None) -> DataFrame:
    """Odds events of one league, or of all football: the common capture or, if that holds no event, the leagues' captures.

    by_league has the column league_code of each capture, which counts instead
    of the code that an event's own labels give.
    """
    known = by_league.withColumnRenamed("league_code", "capture_league")
    if league is not None:
        known = known.where(F.col("capture_league") == league)
    # Events of each league's captures on their own, so that the code can be put on them.
    each = offers(known, keep=("capture_league",)).withColumn("league_code", F.col("capture_league")).drop("capture_league")
    if league is not None:
        return each
    common = offers(everything)
    # One row if the common capture holds an event; the leagues' captures are parsed once, for the result.
    found = common.limit(1).select(F.lit(1).alias("place"))
    return common.unionByName(each.withColumn("place", F.lit(1)).join(F.broadcast(found), "place", "left_anti").drop("place"))


def odds_events(events: DataFrame, start: str, days: int = 1) -> DataFrame:
    """Odds events of a number of days from a day on; match_date is ISO text."""
    day = F.to_date(F.substring("match_date", 1, 10))
    return events.where((day >= F.lit(start).cast("date")) & (day < F.date_add(F.lit(start).cast("date"), days)))


def select_matches(matches: DataFrame, day=None, start=None, end=None, league: str | None = None, season: int | None = None, matchday: int | None = None, status=()) -> DataFrame:
    """Source-side selection; dates are range predicates, so that pruning works."""
    out = matches
    if day is not None:
        start, end = day, day
    if start is not None:
        out = out.where(F.col("match_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("match_date") < F.date_add(F.lit(end).cast("date"), 1))
    for column, value in (("league_code", league), ("season", season), ("matchday", matchday)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.where(F.col("status").isin(*status)) if status else out
