"""Prediction pages: rows, links, tips and blocks cut out of captured HTML (url, html)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X


def _groups(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _found(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# Patterns of the captured markup.
TABLE_ROW, LOGO, PERCENT, TIME, ODDS_PAIR = r"(?s)<tr[^>]*>(.*?)</tr>", r'alt="([^"]+)"', r"(\d{1,3})%", r"\b(\d{1,2}:\d{2})\b", r"(-?\d+\.\d+)\s+vs\s+(-?\d+\.\d+)"
RESULT_LINK, NUMBER, TIP, PRICE, SCORE = r'href="(/result/\d+/\d+/[^"/]+/[^"]+)"', r"\b(\d{1,3})\b", r"\b([1X2])\b", r"(\d\.\d{2})", r"(\d-\d)"


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows with a percentage, two team logos, an optional time and odds pair."""
    rows = pages.select("url", F.posexplode(_groups("html", TABLE_ROW)).alias("pos", "tr"))
    logos = F.filter(_groups("tr", LOGO), lambda a: F.lower(a).contains("logo") & ~F.lower(a).contains("information"))
    names = F.transform(logos, lambda a: F.trim(F.regexp_replace(a, " [lL]ogo", "")))
    rows = rows.select("url", "pos", names.alias("names"), _found("tr", PERCENT).cast("int").alias("pct"), X.strip_html(F.col("tr")).alias("text"))
    return rows.where((F.size("names") >= 2) & F.col("pct").between(1, 100)).select(
        "url", "pos", F.col("names")[0].alias("home_team"), F.col("names")[1].alias("away_team"), _found("text", TIME).alias("kickoff_time"),
        F.col("pct").alias("home_win_pct"), (100 - F.col("pct")).alias("away_win_pct"),
        F.abs(_found("text", ODDS_PAIR, 1).cast("double")).alias("odds_home"), F.abs(_found("text", ODDS_PAIR, 2).cast("double")).alias("odds_away"),
    )


def link_context(pages: DataFrame, after: int = 500) -> DataFrame:
    """Result links with names in the path; the first three numbers 1-99 in the text behind are the percentages."""
    # The text behind a link is cut before rows are made, so that no row carries its page.
    behind = lambda link: F.substring("html", F.position(link, F.col("html")) + F.length(link), F.lit(after))
    cut = F.transform(F.array_distinct(_groups("html", RESULT_LINK)), lambda link: F.struct(link.alias("link"), X.strip_html(behind(link)).alias("text")))
    links = pages.select("url", F.explode(cut).alias("x")).select("url", F.split("x.link", "/").alias("parts"), "x.text")
    numbers = F.filter(F.transform(_groups("text", NUMBER), lambda n: n.cast("int")), lambda n: n.between(1, 99))
    # Made as rows, so that a filter on them doesn't compute them again.
    ctx = links.select("url", "parts", "text", F.explode(F.array(F.slice(numbers, 1, 3))).alias("p"))
    ctx = ctx.select("url", F.url_decode(F.col("parts")[4]).alias("home_team"), F.url_decode(F.col("parts")[5]).alias("away_team"), "text", "p")
    total = F.aggregate("p", F.lit(0), lambda a, b: a + b)
    return ctx.where((F.size("p") == 3) & total.between(80, 120)).select(
        "url", F.trim("home_team").alias("home_team"), F.trim("away_team").alias("away_team"), F.col("p")[0].alias("home_win_pct"), F.col("p")[1].alias("draw_pct"),
        F.col("p")[2].alias("away_win_pct"), _found("text", TIP).alias("predicted_winner"), _found("text", PRICE).cast("double").alias("odds_best"),
        _found("text", SCORE).alias("predicted_score"),
    )


def tip_list(pages: DataFrame, title: str, tip: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Titles and tips paired by position, each pair of teams once (or once per by); title and tip are patterns with one group."""
    pairs = pages.select("url", F.posexplode(F.arrays_zip(_groups("html", title).alias("title"), _groups("html", tip).alias("tip"))).alias("pos", "x"))
    teams = F.split(F.trim(X.strip_html(F.col("x.title"))), r"\s+(?:vs?\.?|-)\s+", 2)
    rows = pairs.select("url", "pos", F.get(teams, F.lit(0)).alias("home_team"), F.get(teams, F.lit(1)).alias("away_team"), F.trim(X.strip_html(F.col("x.tip"))).alias("tip"))
    rows = rows.where(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
    first = rows.groupBy(*[c for c in by if c != "url"], "home_team", "away_team", *[c for c in by if c == "url"])
    return first.agg(F.min(F.struct(F.col("url").alias("page"), "pos", "tip")).alias("f")).select("home_team", "away_team", F.col("f.page").alias("url"), "f.pos", "f.tip")


def merged_blocks(*markets: DataFrame) -> DataFrame:
    """One row per pair of teams from pages of different markets; each gives home_team, away_team and its own columns.

    Of several values of a column the first market's counts, and within it the smallest.
    """
    out = None
    for number, m in enumerate(markets):
        one = m.withColumn("market", F.lit(number))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    others = [c for c in out.columns if c not in ("home_team", "away_team", "market")]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("market", c)))[c].alias(c)
    return out.groupBy("home_team", "away_team").agg(*[first(c) for c in others])


def with_details(tips: DataFrame, pages: DataFrame, most: int = 20) -> DataFrame:
    """Tips (url, pos) with the percentages, both-score and goals of the detail page of the same number on the list's page.

    pages: url of the list, number of the page among its different links, html.
    Only the first ``most`` pages of a list are read, as the source is.
    """
    text = X.strip_html(F.col("html"))
    percent = r"\w[\w\s.'-]*?\s+(\d{1,3})%\s+Draw\s+(\d{1,3})%\s+\w[\w\s.'-]*?\s+(\d{1,3})%"
    cut = pages.where(F.col("number") < most).select("url", F.col("number").alias("pos"), text.alias("t")).select(
        "url", "pos", *[_found("t", percent, k).cast("int").alias(c) for k, c in ((1, "home_win_pct"), (2, "draw_pct"), (3, "away_win_pct"))],
        F.initcap(_found("t", r"(?i)BTTS\s+(yes|no)")).alias("btts"), _found("t", r"Over 2\.5 Goals.*?(\d{1,3})%").cast("int").alias("over_pct"),
    )
    return tips.join(cut, ["url", "pos"], "left")


def blocks(pages: DataFrame, separator: str, fields: dict[str, str]) -> DataFrame:
    """One row per block of a page; fields maps a column to a pattern with one group."""
    cut = pages.select("url", F.posexplode(F.split("html", separator)).alias("pos", "block")).where("pos > 0")
    return cut.select("url", "pos", *[F.trim(_found("block", p)).alias(c) for c, p in fields.items()])


def all_sources(**sources: DataFrame) -> DataFrame:
    """All prediction sources in one table, tagged; one without rows adds nothing."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def unescape(html: Column) -> Column:
    """All named and numeric entities, in Arrow batches; for pages that need more than ``strip_html`` covers."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from html import unescape as plain

        return texts.map(plain, na_action="ignore")

    return run(html)
