"""Team, pair and league statistics from matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEAM_SEASON = ("team", "league_code", "season")


def finished(matches: DataFrame) -> DataFrame:
    """Finished matches with both scores."""
    return matches.where((F.col("status") == "FINISHED") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


def sides(matches: DataFrame) -> DataFrame:
    """Two rows per finished match, one seen from each team, in one pass."""
    home = F.struct(
        F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(True).alias("is_home"),
        F.col("home_score").alias("gf"), F.col("away_score").alias("ga"),
    )
    away = F.struct(
        F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(False).alias("is_home"),
        F.col("away_score").alias("gf"), F.col("home_score").alias("ga"),
    )
    both = finished(matches).select("match_id", "league_code", "season", "match_date", F.explode(F.array(home, away)).alias("side"))
    return both.select("match_id", "league_code", "season", "match_date", "side.*")


def letter() -> Column:
    return F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")


def _counters() -> list:
    win, draw, loss = F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga"), F.col("gf") < F.col("ga")
    home, away = F.col("is_home"), ~F.col("is_home")
    n = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, when, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long").alias(name)
    return [
        F.count(F.lit(1)).alias("matches_played"),
        n(win, "wins"), n(draw, "draws"), n(loss, "losses"),
        n(home & win, "home_wins"), n(home & draw, "home_draws"), n(home & loss, "home_losses"),
        n(away & win, "away_wins"), n(away & draw, "away_draws"), n(away & loss, "away_losses"),
        F.sum("gf").cast("long").alias("goals_scored"), F.sum("ga").cast("long").alias("goals_conceded"),
        total("gf", home, "home_goals_scored"), total("ga", home, "home_goals_conceded"),
        total("gf", away, "away_goals_scored"), total("ga", away, "away_goals_conceded"),
        n(F.col("ga") == 0, "clean_sheets"),
        F.avg("gf").alias("avg_goals_scored"), F.avg("ga").alias("avg_goals_conceded"),
    ]


def team_season_stats(rows: DataFrame) -> DataFrame:
    """Counters and averages of each team in a league and season."""
    return rows.groupBy(*TEAM_SEASON).agg(*_counters())


def last_matches(rows: DataFrame, n: int = 5, by: tuple = ("team",)) -> DataFrame:
    """The newest n rows per key with their rank rn; ties on id."""
    newest = W.partitionBy(*by).orderBy(F.desc("match_date"), F.desc("match_id"))
    return rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)


def form(rows: DataFrame, n: int = 5, by: tuple = ("team",)) -> DataFrame:
    """Letters of the newest n matches, newest first."""
    picked = last_matches(rows, n, by).withColumn("r", letter())
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rn", "r"))), lambda x: x["r"])
    return picked.groupBy(*by).agg(F.array_join(ordered, "").alias("form"))


def latest_season(stats: DataFrame, by: tuple = ("team", "league_code")) -> DataFrame:
    newest = W.partitionBy(*by).orderBy(F.desc("season"))
    return stats.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def league_table(stats: DataFrame) -> DataFrame:
    """Points, goal difference and rank in each league and season."""
    out = stats.select(
        *TEAM_SEASON, "matches_played", (3 * F.col("wins") + F.col("draws")).alias("points"),
        (F.col("goals_scored") - F.col("goals_conceded")).alias("goal_difference"), "goals_scored",
    )
    order = W.partitionBy("league_code", "season").orderBy(F.desc("points"), F.desc("goal_difference"), F.desc("goals_scored"))
    return out.withColumn("points_per_game", F.col("points") / F.col("matches_played")).withColumn("position", F.rank().over(order).cast("long"))


def goal_averages(matches: DataFrame, newest: int = 500, least: int = 50) -> DataFrame:
    """One row: mean home and away goals over the newest matches of each league, defaults below a minimum."""
    order = W.partitionBy("league_code").orderBy(F.desc("match_date"), F.desc("match_id"))
    used = finished(matches).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= newest)
    enough = F.count(F.lit(1)) >= least
    return used.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.avg("home_score")).otherwise(1.5).alias("avg_home_goals"),
        F.when(enough, F.avg("away_score")).otherwise(1.2).alias("avg_away_goals"),
    )


def head_to_head(matches: DataFrame, last: int = 10) -> DataFrame:
    """Shares and goals over the last meetings of each pair, seen from both teams.

    The pair is joined on its ordered form, so that either order of the teams
    is one equality.
    """
    pair = finished(matches).withColumn("low", F.least("home_team", "away_team")).withColumn("high", F.greatest("home_team", "away_team"))
    newest = W.partitionBy("low", "high").orderBy(F.desc("match_date"), F.desc("match_id"))
    met = pair.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    low_goals = F.when(F.col("home_team") == F.col("low"), F.col("home_score")).otherwise(F.col("away_score"))
    high_goals = F.when(F.col("home_team") == F.col("low"), F.col("away_score")).otherwise(F.col("home_score"))
    seen = met.select("low", "high", low_goals.alias("lg"), high_goals.alias("hg")).select(
        F.explode(
            F.array(
                F.struct(F.col("low").alias("team"), F.col("high").alias("opponent"), F.col("lg").alias("gf"), F.col("hg").alias("ga")),
                F.struct(F.col("high").alias("team"), F.col("low").alias("opponent"), F.col("hg").alias("gf"), F.col("lg").alias("ga")),
            )
        ).alias("x")
    )
    share = lambda c, name: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name)
    return seen.select("x.*").groupBy("team", "opponent").agg(
        F.count(F.lit(1)).alias("meetings"), share(F.col("gf") > F.col("ga"), "h2h_home_wins"), share(F.col("gf") == F.col("ga"), "h2h_draws"),
        share(F.col("gf") < F.col("ga"), "h2h_away_wins"), F.avg("gf").alias("h2h_home_goals_avg"), F.avg("ga").alias("h2h_away_goals_avg"),
    )


def stats_before_match(rows: DataFrame) -> DataFrame:
    """Running totals of each team's league season over strictly earlier matches: no match sees its own score."""
    frame = "over (partition by team, league_code, season order by match_date range between unbounded preceding and interval '1' microsecond preceding)"
    return rows.selectExpr(
        "match_id", "team", "league_code", "season", "match_date", "is_home",
        f"count(1) {frame} as played_before",
        f"count_if(gf > ga) {frame} as wins_before",
        f"count_if(gf = ga) {frame} as draws_before",
        f"cast(sum(gf) {frame} as bigint) as goals_before",
        f"cast(sum(ga) {frame} as bigint) as conceded_before",
    )


def temporal_split(rows: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Add is_train: exactly the first share of the rows by date and id.

    Rows per day are counted first; the running sum is over days, so no window
    holds all rows. Days that lie before the cut as a whole are taken as they
    are, and only the day of the cut is ranked.
    """
    day = F.to_date("match_date")
    per_day = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    running = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = per_day.select("day", "n", (F.sum("n").over(running) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    cut = F.floor(F.col("total") * train_share)
    part = F.when(F.col("before") >= F.col("cut"), "after").when(F.col("before") + F.col("n") <= F.col("cut"), "before").otherwise("cut")
    marked = marked.select("day", "before", "n", cut.alias("cut")).select("day", "before", "cut", part.alias("part"))
    joined = rows.withColumn("day", day).join(marked, "day")
    whole = joined.where(F.col("part") != "cut").withColumn("is_train", F.col("part") == "before")
    ranked = joined.where(F.col("part") == "cut").withColumn("rn", F.row_number().over(W.partitionBy("day").orderBy("match_date", "match_id")))
    early = ranked.withColumn("is_train", F.col("before") + F.col("rn") <= F.col("cut")).drop("rn")
    return early.unionByName(whole).drop("day", "before", "cut", "part")


def counters_before_match(rows: DataFrame, last: int = 5) -> DataFrame:
    """All counters of ``team_season_stats`` and the form over strictly earlier matches of the league season, one row per side of a match.

    Matches at the same time don't see each other. A side without an earlier
    match has counters of 0, no averages and an empty form. Rows are counted per
    time first; running sums are over times, and the form needs the newest rows
    of as many earlier times as it has letters, so no window gathers all rows.
    """
    win, draw, loss = "gf > ga", "gf = ga", "gf < ga"
    counts = {"matches_played": "true", "wins": win, "draws": draw, "losses": loss, "clean_sheets": "ga = 0"}
    counts |= {f"{at}_{n}": f"{'' if at == 'home' else 'not '}is_home and {c}" for at in ("home", "away") for n, c in (("wins", win), ("draws", draw), ("losses", loss))}
    sums = {"goals_scored": "gf", "goals_conceded": "ga"}
    sums |= {f"{at}_{n}": f"if({'' if at == 'home' else 'not '}is_home, {c}, 0)" for at in ("home", "away") for n, c in (("goals_scored", "gf"), ("goals_conceded", "ga"))}
    sums |= {"_gf_known": "if(gf is null, 0, 1)", "_ga_known": "if(ga is null, 0, 1)"}
    # Keys that are null meet too, as they do in a window.
    moment = [*TEAM_SEASON, "match_date"]
    per_time = rows.groupBy(*moment).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()], *[F.coalesce(F.sum(F.expr(c)), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    newest = W.partitionBy(*moment).orderBy(F.desc("match_id"))
    top = rows.select(*moment, "match_id", letter().alias("r")).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    letters = F.transform(F.sort_array(F.collect_list(F.struct("rn", "r"))), lambda x: x["r"])
    per_time = per_time.join(top.groupBy(*[F.col(c).alias(f"_{c}") for c in moment]).agg(F.array_join(letters, "").alias("_letters")), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in moment])
    times = W.partitionBy(*TEAM_SEASON).orderBy("match_date")
    earlier, few = times.rowsBetween(W.unboundedPreceding, -1), times.rowsBetween(-last, -1)
    running = {n: F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("long") for n in [*counts, *sums]}
    before = per_time.select(*moment, *[c.alias(n) for n, c in running.items()], F.substr(F.array_join(F.reverse(F.collect_list("_letters").over(few)), ""), F.lit(1), F.lit(last)).alias("form"))
    mean = lambda total, known: F.when(F.col(known) > 0, F.col(total) / F.col(known))
    known = before.select(
        *[F.col(c).alias(f"_{c}") for c in moment], *counts, *[n for n in sums if not n.startswith("_")],
        mean("goals_scored", "_gf_known").alias("avg_goals_scored"), mean("goals_conceded", "_ga_known").alias("avg_goals_conceded"), "form",
    )
    out = rows.select("match_id", *moment).join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in moment])
    return out.drop("match_date", *[f"_{c}" for c in moment])


def head_to_head_before_match(matches: DataFrame, last: int = 10) -> DataFrame:
    """Shares and goals over the last meetings before each match, seen from its home team; same columns as ``head_to_head``."""
    low, high = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    swapped = F.col("home_team") != F.col("low")
    pair = finished(matches).withColumn("low", low).withColumn("high", high).select(
        "match_id", "match_date", "low", "high", swapped.alias("swapped"),
        F.when(swapped, F.col("away_score")).otherwise(F.col("home_score")).alias("lg"), F.when(swapped, F.col("home_score")).otherwise(F.col("away_score")).alias("hg"),
    )
    earlier = W.partitionBy("low", "high").orderBy("match_date", "match_id").rowsBetween(-last, -1)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).over(earlier)
    seen = pair.select(
        "match_id", "swapped", F.count(F.lit(1)).over(earlier).alias("meetings"), share(F.col("lg") > F.col("hg")).alias("low_wins"), share(F.col("lg") == F.col("hg")).alias("h2h_draws"),
        share(F.col("lg") < F.col("hg")).alias("high_wins"), F.avg("lg").over(earlier).alias("low_goals"), F.avg("hg").over(earlier).alias("high_goals"),
    )
    side = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    return seen.select(
        "match_id", "meetings", side("low_wins", "high_wins").alias("h2h_home_wins"), "h2h_draws", side("high_wins", "low_wins").alias("h2h_away_wins"),
        side("low_goals", "high_goals").alias("h2h_home_goals_avg"), side("high_goals", "low_goals").alias("h2h_away_goals_avg"),
    )
