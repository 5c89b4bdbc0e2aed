"""Queries that run the streaming jobs over the event stream, each to its end.

Users stand for matches and event types for sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.plans import views as V
from fixturelake.plans.catalogue import ORACLES, _event_stream, query
from fixturelake.streaming import live, state

C = F.col


def _of(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    e = _event_stream(spark, d).select(C("user_id").alias("match_id"), "event_time", "event_id", "event_type", "value")
    return e.where(C("event_type").isin(*kinds)) if kinds else e


@query("""select user_id as match_id, date_trunc('hour', ts) as hour, count(*) quotes, min(value) low, max(value) high, max_by(value, (ts, value)) as last from events group by 1, 2""")
def stream_odds_windows(spark, d):
    """Number, range and last odds per match and hour."""
    quotes = _of(spark, d).select("match_id", "event_time", C("value").alias("home_odds"))
    changes = live.run_to_table(live.odds_windows(quotes).withColumn("hour", C("window.start")).drop("window"), live.job_path(spark, "windows"))
    return live.newest_change(changes, ["match_id", "hour"]).select("match_id", C("hour").cast("timestamp_ntz").alias("hour"), "quotes", "low", "high", "last")


@query("select distinct user_id as match_id, cast(floor(value / 10) as bigint) as score, event_type as status from events")
def stream_without_repeats(spark, d):
    """Each update of a match once."""
    updates = _of(spark, d).select("match_id", "event_time", F.floor(C("value") / 10).cast("long").alias("score"), C("event_type").alias("status"))
    keys = ["match_id", "score", "status"]
    return live.run_to_table(live.without_repeats(updates, keys), live.job_path(spark, "repeats"), "append").select(*keys)


@query("""select p.user_id as match_id, p.event_id, q.event_id as quote_id, q.value as home_odds from events p join events q on p.user_id = q.user_id and p.event_type = 'purchase' and q.event_type = 'view'
 and q.ts <= p.ts and q.ts >= p.ts - interval 6 hours""")
def stream_predictions_with_odds(spark, d):
    """Every quote of the match within six hours before each prediction."""
    p = _of(spark, d, "purchase").select("match_id", "event_time", "event_id")
    q = _of(spark, d, "view").select("match_id", "event_time", C("event_id").alias("quote_id"), C("value").alias("home_odds"))
    joined = live.predictions_with_odds(p, q, within="6 hours", late="40 days")
    return live.run_to_table(joined, live.job_path(spark, "quotes"), "append").select("match_id", "event_id", "quote_id", "home_odds")


HEARTBEAT = -1


def _replayed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """A stream over the events in steps, out of order, closed by a heartbeat long after them."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(C("user_id").alias("match_id"), C("ts").cast("timestamp").alias("event_time"), "event_id", "event_type", "value")
    end = spark.range(1).select(F.lit(HEARTBEAT).cast("long").alias("match_id"), F.lit("2100-01-01").cast("timestamp").alias("event_time"))
    last = end.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:]])
    with state.timers_allowed(spark):
        return live.replay(rows, last, build, name, mode)


def _kind(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(C("event_type").isin(*kinds) | (C("match_id") == HEARTBEAT))


def _by_number() -> Column:
    return F.lpad(C("event_id").cast("string"), 20, "0")


@query("""select user_id as match_id, cast(floor(value) as bigint) as score, event_type as status, event_id from events
 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def stream_latest_score(spark, d):
    """Latest score per match, updated with every step; a match without news for ten years is forgotten."""
    def build(rows):
        updates = rows.select("match_id", "event_time", "event_id", F.floor("value").cast("long").alias("score"), C("event_type").alias("status"))
        return state.last_before_deadline(updates, C("event_time") + F.expr("interval 3650 days"), changes=True, tie=_by_number())

    changes = _replayed(spark, d, build, "latest", "update").where(~C("final") & (C("match_id") != HEARTBEAT))
    return live.newest_change(changes.drop("event_time", "final"), ["match_id"]).select("match_id", "score", "status", "event_id")


@query("""select match_id, score, status, event_id from (select user_id as match_id, cast(floor(value) as bigint) as score, event_type as status, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) after from events)
 where after is null or after > ts + case when status = 'purchase' then interval 2 hours else interval 1 day end""")
def stream_final_score(spark, d):
    """State of a match as it was closed: two hours after a finish event, a day after another one, if nothing followed by then."""
    def build(rows):
        updates = rows.select("match_id", "event_time", "event_id", F.floor("value").cast("long").alias("score"), C("event_type").alias("status"))
        grace = F.when(C("status") == "purchase", F.expr("interval 2 hours")).otherwise(F.expr("interval 24 hours"))
        return state.last_before_deadline(updates, C("event_time") + grace, tie=_by_number())

    return _replayed(spark, d, build, "final").where(C("match_id") != HEARTBEAT).select("match_id", "score", "status", "event_id")


@query("""select user_id as match_id, max_by(value, (ts, event_id)) as closing from events where ts < timestamp '2024-01-20' + to_days(cast(user_id % 5 as int)) group by 1""")
def stream_closing_odds(spark, d):
    """Last odds of each match before its kickoff, which a static table holds; a match's state ends with its kickoff."""
    e = spark.read.parquet(f"{d}/events.parquet").select(C("user_id").alias("match_id")).distinct()
    at = F.timestamp_add("DAY", (C("match_id") % 5).cast("int"), F.lit("2024-01-20").cast("timestamp"))
    kickoff = e.select("match_id", at.alias("kickoff"))

    def build(rows):
        quotes = rows.join(kickoff, "match_id", "left").where((C("event_time") < C("kickoff")) | (C("match_id") == HEARTBEAT))
        quotes = quotes.select("match_id", "event_time", "event_id", C("value").alias("home_odds"), F.coalesce("kickoff", "event_time").alias("kickoff"))
        return state.last_before_deadline(quotes, C("kickoff"), tie=_by_number())

    return _replayed(spark, d, build, "closing").where(C("match_id") != HEARTBEAT).select("match_id", C("home_odds").alias("closing"))


@query("""select p.event_id, p.event_type as outcome, f.actual, p.event_type = f.actual as hit from (select * from events where event_type in ('view', 'click')) p left join
 (select user_id, ts, event_id, case when value > 50 then 'view' else 'click' end actual from events where event_type = 'purchase') f
 on f.user_id = p.user_id and f.ts >= p.ts and f.ts <= p.ts + interval 7 days
 qualify row_number() over (partition by p.event_id order by f.ts nulls last, f.event_id) = 1""")
def stream_settlements(spark, d):
    """All predictions, each settled once by the earliest finish event of its match within seven days; pending ones have no result."""
    def build(rows):
        p = _kind(rows, "view", "click").select("match_id", "event_time", "event_id", C("event_type").alias("outcome"))
        f = _kind(rows, "purchase").select("match_id", "event_time", "event_id", F.when(C("value") > 50, "view").otherwise("click").alias("actual"))
        return state.settled_once(p, f, tie=_by_number())

    path = live.job_path(spark, "settled")
    sink = live.insert_new(path, ["event_id"])
    settled = _replayed(spark, d, build, "settlements").where(C("match_id") != HEARTBEAT).select("event_id", "outcome", "actual", "hit")
    for number in (0, 0):  # a batch that runs again adds nothing
        sink(settled, number)
    return spark.read.parquet(path)


@query("""select cast(match_id as varchar) as key, cast(event_id as varchar) as payload, ts + interval 6 hours as expired_at from
 (select user_id as match_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) after from events) where after is null or after > ts + interval 6 hours""")
def stream_freshness(spark, d):
    """Payloads that no newer one of their key renewed within six hours, each once, when they expire."""
    def build(rows):
        keyed = rows.select(C("match_id").cast("string").alias("key"), "event_time", "event_id", C("event_id").cast("string").alias("payload"))
        return state.last_before_deadline(keyed, C("event_time") + F.expr("interval 6 hours"), key="key", tie=_by_number())

    out = _replayed(spark, d, build, "fresh").where(C("key") != str(HEARTBEAT))
    return out.select("key", "payload", (C("event_time") + F.expr("interval 6 hours")).cast("timestamp_ntz").alias("expired_at"))


@query(ORACLES["stream_odds_asof"])
def stream_odds_at_prediction(spark, d):
    """Each prediction with the newest quote of its match at or before it, joined as the two streams arrive."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("event_time", C("l_shipdate").cast("timestamp"))
    end = spark.range(1).select(F.lit(HEARTBEAT).cast("long").alias("l_orderkey"), F.lit("2100-01-01").cast("timestamp").alias("event_time"))
    rows = li.select("event_time", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    last = end.select(*[c if c in end.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])

    def build(lines):
        at = lambda df, c: df.withColumn("event_time", C(c).cast("timestamp"))
        time = F.coalesce("l_shipdate", C("event_time").cast(li.schema["l_shipdate"].dataType))
        dated = lines.withColumn("l_shipdate", time)
        p, q = at(V.predictions_of(dated), "scraped_at").select("match_id", "source", "scraped_at", "event_time", "tip"), at(V.quotes_of(dated), "quoted_at")
        tie = F.format_string("%s %015.6f %015.6f %015.6f", "bookmaker", "home_odds", "draw_odds", "away_odds")
        return state.odds_at_prediction(p, q, "400 days", tie=tie, columns=["home_odds", "draw_odds"])

    with state.timers_allowed(spark):
        out = live.replay(rows, last, build, "asof")
    out = out.where(C("match_id") != HEARTBEAT).select("*", C("quote.home_odds").alias("home_at_scrape"), C("quote.draw_odds").alias("draw_at_scrape"))
    return out.groupBy("match_id", "source", "scraped_at", "tip", "home_at_scrape", "draw_at_scrape").agg(F.count(F.lit(1)).alias("n"))
