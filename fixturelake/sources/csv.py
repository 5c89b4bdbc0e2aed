"""Season-results files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X

# Column names of the files; all are read as text.
COLUMNS = (
    "Date Time HomeTeam AwayTeam FTHG FTAG HTHG HTAG FTR HTR Referee HS AS HST AST HF AF HC AC HY AY HR AR B365H B365D B365A "
    "BWH BWD BWA PSH PSD PSA AvgH AvgD AvgA MaxH MaxD MaxA"
).split()


def read_season_files(spark: SparkSession, path: str) -> DataFrame:
    """All season files under path; league and season come from a name like PL_2425.csv."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path, inferSchema=False)
    file = F.col("_metadata.file_path")
    raw = raw.select("*", F.regexp_extract(file, r"([A-Za-z0-9]+)_\d{4}\.csv$", 1).alias("league_code"), F.regexp_extract(file, r"_(\d{4})\.csv$", 1).alias("season_code"))
    return normalise(raw)


def read_season_folders(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files in folders league_code=.../season_code=...; a filter on these reads the folders asked for only."""
    return spark.read.option("header", True).option("enforceSchema", False).option("recursiveFileLookup", False).schema(_folder_schema(spark, path)).csv(path)


def _folder_schema(spark: SparkSession, path: str) -> str:
    """The files' columns as text, by the header of one file, and the folders' names as text."""
    names = [c for c in spark.read.option("header", True).csv(path, inferSchema=False).columns if c not in ("league_code", "season_code")]
    return ", ".join(f"`{c}` string" for c in [*names, "league_code", "season_code"])


def normalise(raw: DataFrame) -> DataFrame:
    """One schema for all files: missing columns are null, rows without teams are dropped, every row is finished."""
    names = {c.lstrip("﻿ï»¿"): c for c in raw.columns}
    text = lambda c: F.col(f"`{names[c]}`").cast("string") if c in names else F.lit(None).cast("string")
    odds = lambda k: X.first_nonzero(*[X.lenient_float(text(f"{b}{k}")) for b in ("B365", "BW", "PS")])
    return raw.where((F.trim(text("HomeTeam")) != "") & (F.trim(text("AwayTeam")) != "")).select(
        text("league_code").alias("league_code"),
        X.season_start(text("season_code")).alias("season"),
        X.match_time(text("Date"), text("Time")).alias("match_date"),
        F.trim(text("HomeTeam")).alias("home_team"),
        F.trim(text("AwayTeam")).alias("away_team"),
        F.lit("FINISHED").alias("status"),
        *[X.lenient_int(text(c)).alias(n) for c, n in (("FTHG", "home_score"), ("FTAG", "away_score"), ("HTHG", "ht_home_score"), ("HTAG", "ht_away_score"))],
        odds("H").alias("home_odds"), odds("D").alias("draw_odds"), odds("A").alias("away_odds"),
        text("Referee").alias("referee"),
    )


def with_ids(matches: DataFrame) -> DataFrame:
    """Stable ids from league, season, day and teams."""
    return matches.withColumn("match_id", X.surrogate_id("league_code", "season", F.to_date("match_date"), "home_team", "away_team"))
