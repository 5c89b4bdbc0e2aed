"""Match-shaped views over the driver tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with two different teams."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    team = F.floor(F.col("o_custkey") / 20).cast("long") % 20
    out = o.select(
        F.col("o_orderkey").alias("match_id"),
        F.concat(F.lit("L"), (F.col("o_custkey") % 5).cast("string")).alias("league_code"),
        F.year("o_orderdate").cast("long").alias("season"),
        F.col("o_orderdate").alias("match_date"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "P", "IN_PLAY").otherwise("SCHEDULED").alias("status"),
        (F.col("o_custkey") % 20).alias("home_team"),
        team.alias("away_team"),
        (F.floor("o_totalprice").cast("long") % 5).alias("home_score"),
        (F.floor(F.col("o_totalprice") / 7).cast("long") % 4).alias("away_score"),
    )
    return out.where(F.col("home_team") != F.col("away_team"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several predictions per match and source."""
    return predictions_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def predictions_of(li: DataFrame) -> DataFrame:
    """Predictions of lines, stored or streamed."""
    return li.select(
        F.col("l_orderkey").alias("match_id"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 6).cast("string")).alias("source"),
        F.col("l_shipdate").alias("scraped_at"),
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("home_w"),
        (5.0 + F.col("l_linenumber") * 2.0).alias("draw_w"),
        (51.0 - F.col("l_quantity")).alias("away_w"),
        F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "X").otherwise("2").alias("tip"),
        F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("btts"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmaker quotes; zero odds are missing odds."""
    return quotes_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def quotes_of(li: DataFrame) -> DataFrame:
    """Quotes of lines, stored or streamed."""
    return li.select(
        F.col("l_orderkey").alias("match_id"),
        F.concat(F.lit("B"), (F.col("l_suppkey") % 5).cast("string")).alias("bookmaker"),
        F.col("l_shipdate").alias("quoted_at"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(1.2 + F.col("l_quantity") / 20).alias("home_odds"),
        (3.0 + F.col("l_discount") * 10).alias("draw_odds"),
        (1.2 + (51 - F.col("l_quantity")) / 20).alias("away_odds"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team names from part names: id and name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


M = """m as (select * from (select o_orderkey match_id, concat('L', cast(o_custkey % 5 as varchar)) league_code,
  cast(year(o_orderdate) as bigint) season, o_orderdate match_date,
  case o_orderstatus when 'F' then 'FINISHED' when 'P' then 'IN_PLAY' else 'SCHEDULED' end status,
  o_custkey % 20 home_team, cast(floor(o_custkey / 20) as bigint) % 20 away_team,
  cast(floor(o_totalprice) as bigint) % 5 home_score, cast(floor(o_totalprice / 7) as bigint) % 4 away_score from orders) t
  where home_team <> away_team)"""
P = """p as (select l_orderkey match_id, concat('S', cast(l_suppkey % 6 as varchar)) source, l_shipdate scraped_at,
  case when l_partkey % 10 = 0 then null else l_quantity end home_w, 5e0 + l_linenumber * 2e0 draw_w, 51e0 - l_quantity away_w,
  case l_returnflag when 'A' then '1' when 'N' then 'X' else '2' end tip, case l_linestatus when 'O' then 'Yes' else 'No' end btts
  from lineitem)"""
O = """o as (select l_orderkey match_id, concat('B', cast(l_suppkey % 5 as varchar)) bookmaker, l_shipdate quoted_at,
  case when l_tax = 0 then 0e0 else 12e-1 + l_quantity / 20e0 end home_odds, 3e0 + l_discount * 10e0 draw_odds,
  12e-1 + (51e0 - l_quantity) / 20e0 away_odds from lineitem)"""
F_ = "f as (select * from m where status = 'FINISHED' and home_score is not null and away_score is not null)"
SIDES = """s as (select match_id, league_code, season, match_date, home_team team, away_team opponent, true is_home, home_score gf, away_score ga from f
  union all select match_id, league_code, season, match_date, away_team, home_team, false, away_score, home_score from f)"""


def rounded_sql(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(28,12)), {digits}) as double)"


def mean_sql(x: str) -> str:
    """A mean that the order of rows doesn't change, as of ``scalars.exact_mean``."""
    return f"(cast(sum(cast({x} as decimal(28,12))) as double) / nullif(count({x}), 0))"


def sql(body: str, *ctes: str) -> str:
    return f"with {', '.join(ctes)} {body}"


# Twenty clubs as the matches spell them and as other sources do; the resolution of names must join each pair.
CLUBS = (
    ("Paris Saint-Germain", "PSG"),
    ("Tottenham Hotspur", "Spurs"),
    ("Olympique de Marseille", "OM"),
    ("Bayern Munich", "FC Bayern München"),
    ("Manchester United", "Man Utd"),
    ("Arsenal", "Arsenal FC"),
    ("Wolverhampton Wanderers", "Wolves"),
    ("Borussia Monchengladbach", "Gladbach"),
    ("Inter Milan", "Internazionale"),
    ("Nottingham Forest", "Nottingham"),
    ("SSC Napoli", "Napoli"),
    ("Atletico de Madrid", "Atlético Madrid"),
    ("Celta de Vigo", "Celta Vigo"),
    ("Bayer Leverkusen", "Leverkusen"),
    ("SC Freiburg", "Freiburg"),
    ("AFC Ajax", "Ajax"),
    ("PSV Eindhoven", "PSV"),
    ("SL Benfica", "Benfica"),
    ("FC Porto", "Porto"),
    ("AZ Alkmaar", "AZ"),
)


def club(number, spelling: int):
    """Name of a team by its number, in one of the two spellings."""
    return F.element_at(F.array(*[F.lit(c[spelling]) for c in CLUBS]), F.col(number).cast("int") + 1)


def club_sql(number: str, spelling: int) -> str:
    listed = ", ".join("'" + c[spelling].replace("'", "''") + "'" for c in CLUBS)
    return f"([{listed}])[{number} + 1]"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the names of their teams."""
    return matches(spark, sf_dir).withColumn("home", club("home_team", 0)).withColumn("away", club("away_team", 0))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another source: the matches under their own numbers, with the other spelling and moved scores; every eleventh home team is an unknown one."""
    m = matches(spark, sf_dir)
    unknown = F.concat(F.lit("Nowhere "), (F.col("match_id") % 3).cast("string"))
    status = F.when(F.col("match_id") % 4 == 0, "LIVE").otherwise("SCHEDULED")
    return m.select(
        F.col("match_id").alias("id"), F.when(F.col("match_id") % 11 == 0, unknown).otherwise(club("home_team", 1)).alias("home"), club("away_team", 1).alias("away"), "home_team", "away_team", "match_date",
        status.alias("status"), (F.col("match_id") % 90).cast("string").alias("minute"),
        F.when(F.col("match_id") % 5 != 0, F.col("home_score") + 1).alias("home_score"), F.when(F.col("match_id") % 5 != 0, F.col("away_score")).alias("away_score"),
        F.concat(F.lit("f"), F.col("match_id").cast("string")).alias("feed_id"),
    )


FEED = """fd as (select match_id id, home_team, away_team, match_date, case when match_id % 4 = 0 then 'LIVE' else 'SCHEDULED' end status, cast(match_id % 90 as varchar) as minute,
 case when match_id % 5 <> 0 then home_score + 1 end home_score, case when match_id % 5 <> 0 then away_score end away_score, 'f' || cast(match_id as varchar) feed_id, match_id % 11 = 0 as unknown from m)"""
