"""Delimited live and odds feeds: records between ~, fields between ¬, key and value around ÷."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X


def live_feed(payloads: DataFrame) -> DataFrame:
    """Matches of each payload (payload_id, raw); the league record before them applies."""
    records = payloads.select("payload_id", F.posexplode(F.split("raw", "~")).alias("pos", "record"))
    fields = records.withColumn("kv", F.expr("str_to_map(record, '¬', '÷')"))
    value = lambda k: F.nullif(F.try_element_at("kv", F.lit(k)), F.lit(""))
    keyed = fields.select(
        "payload_id", "pos", F.map_contains_key("kv", "ZA").alias("is_league"), value("ZA").alias("za"), value("ZB").alias("zb"), value("AA").alias("aa"), value("AE").alias("ae"),
        value("AF").alias("af"), F.coalesce(value("AB"), F.lit("1")).alias("ab"), value("AG").alias("ag"), value("AH").alias("ah"),
        value("BA").alias("ba"), value("BB").alias("bb"), value("BJ").alias("bj"),
    )
    head = "last(case when is_league then struct(za, zb) end, true) over (partition by payload_id order by pos rows between unbounded preceding and current row)"
    carried = keyed.withColumn("head", F.expr(head)).where(F.col("aa").isNotNull() & F.col("ae").isNotNull() & F.col("af").isNotNull())
    # Status codes of the feed.
    status = F.when(F.col("ab").isin("2", "6"), "LIVE").when(F.col("ab").isin("3", "8", "9"), "FINISHED").when(F.col("ab") == "4", "POSTPONED").when(F.col("ab") == "5", "CANCELLED")
    return carried.select(
        "payload_id", F.col("aa").alias("feed_id"), F.col("ae").alias("home_team"), F.col("af").alias("away_team"), X.lenient_int(F.col("ag")).alias("home_score"),
        X.lenient_int(F.col("ah")).alias("away_score"), X.lenient_int(F.col("ba")).alias("ht_home_score"), X.lenient_int(F.col("bb")).alias("ht_away_score"),
        status.otherwise("SCHEDULED").alias("status"), F.coalesce("head.za", F.lit("")).alias("league"), F.coalesce("head.zb", F.lit("")).alias("country"),
        F.coalesce("bj", F.lit("")).alias("minute"),
    )


def odds_feed(payloads: DataFrame) -> DataFrame:
    """Quotes (payload_id, bookmaker, three odds): a bookmaker field is followed by its odds fields."""
    # A payload is parsed in its own row: nothing is shuffled or sorted.
    pair = F.transform(F.filter(F.split("raw", "¬"), lambda f: F.contains(f, F.lit("÷"))), lambda f: F.struct(F.split(f, "÷", 2)[0].alias("k"), F.split(f, "÷", 2)[1].alias("v")))
    keyed = payloads.select("payload_id", F.explode(F.array(pair)).alias("f"))
    starts = F.filter(F.transform("f", lambda x, i: F.when(x["k"] == "OD", i + 1)), lambda i: i.isNotNull())
    keyed = keyed.select("payload_id", "f", F.explode(F.array(starts)).alias("s"))
    groups = F.transform("s", lambda at, i: F.slice("f", at, F.coalesce(F.get("s", i + 1), F.size("f") + 1) - at))
    each = keyed.select("payload_id", F.explode(groups).alias("g"))
    last = lambda k: F.get(F.reverse(F.filter("g", lambda x: x["k"] == k)), F.lit(0))["v"]
    rows = each.select("payload_id", last("OD").alias("bookmaker"), last("OE").alias("h"), last("OF").alias("d"), last("OG").alias("a"))
    return rows.where((F.col("bookmaker") != "") & F.coalesce("h", "d", "a").isNotNull()).select(
        "payload_id", "bookmaker", *[X.lenient_float(F.col(c)).alias(f"{k}_odds") for c, k in (("h", "home"), ("d", "draw"), ("a", "away"))]
    )
