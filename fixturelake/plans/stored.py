"""Queries over broken payloads and over the partitioned store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.plans import views as V
from fixturelake.plans.catalogue import query
from fixturelake.sources import quarantine, store
from fixturelake.streaming import live

C = F.col
#: Matches in one payload at most.
PAYLOAD = 200


def payload_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with their part of the day and league: at most PAYLOAD matches each, by number."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("match_id")) - 1
    return rows.withColumn("part", F.floor(rank / PAYLOAD).cast("int"))


_BROKEN = f"""pr as (select *, cast(floor((row_number() over (partition by cast(match_date as date), league_code order by match_id) - 1) / {PAYLOAD}) as int) as part from m),
 ps as (select *, match_id = max(match_id) over (partition by cast(match_date as date), league_code, part) and day(match_date) % 4 = 0 as is_last from pr)"""


@query(V.sql("""select match_id, case when is_last then 'cut' when match_id % 17 = 0 then 'type' when match_id % 19 = 0 then 'missing home' end as reason,
 case when not is_last and match_id % 17 <> 0 and match_id % 19 <> 0 then home_score end as home_score from ps""", V.M, _BROKEN))
def broken_json(spark, d):
    """Feeds with scores of another type, records without a team and feeds that end inside their last record: what is good, and why the rest is not."""
    m = payload_parts(V.named(spark, d).withColumn("day", F.to_date("match_date")), "day", "league_code")
    entry = F.concat(
        F.lit('{"id":'), C("match_id").cast("string"), F.lit(',"score":'), F.when(C("match_id") % 17 == 0, F.lit('{"none":[]}')).otherwise(C("home_score").cast("string")),
        F.when(C("match_id") % 19 == 0, "").otherwise(F.concat(F.lit(',"home":"'), "home", F.lit('"'))), F.lit(',"more":[{"a":1},{"a":2}]}'),
    )
    listed = F.sort_array(F.collect_list(F.struct("match_id", entry.alias("entry"))))
    feeds = m.groupBy("day", "league_code", "part").agg(F.array_join(F.transform(listed, lambda x: x["entry"]), ", ").alias("all"))
    whole = F.concat(F.lit('{"events":['), "all", F.lit("]}"))
    # The text after the last record's number is lost with its end.
    cut = F.regexp_extract(whole, r'(?s)^(.*\{"id":\d+,"sc)', 1)
    bodies = feeds.select("day", "league_code", F.when(F.day("day") % 4 == 0, cut).otherwise(whole).alias("body"))
    records = quarantine.json_records(bodies, "id long, score int, home string, more array<struct<a:int>>", '{"id":', required=("id", "home"))
    path = live.job_path(spark, "quarantine")
    quarantine.write_bad(records, path)
    bad = spark.read.schema("raw string, reason string").parquet(path)
    number = F.regexp_extract("raw", r'^\{"id":(\d+)', 1).cast("long")
    kept = quarantine.good(records).select(C("record.id").alias("match_id"), F.lit(None).cast("string").alias("reason"), C("record.score").cast("long").alias("home_score"))
    return kept.unionByName(bad.select(number.alias("match_id"), "reason", F.lit(None).cast("long").alias("home_score")))


@query(V.sql("""select match_id, case when match_id % 17 = 0 then 'delimiter' when match_id % 19 = 0 then 'missing AE' when match_id % 23 = 0 then 'type' end as reason,
 case when match_id % 17 <> 0 and match_id % 19 <> 0 and match_id % 23 <> 0 then home_score end as home_score from m""", V.M))
def broken_delimited(spark, d):
    """Delimited feeds with unknown delimiters, missing keys and scores that are no numbers."""
    m = payload_parts(V.named(spark, d).withColumn("day", F.to_date("match_date")), "day", "league_code")
    text = lambda c: C(c).cast("string")
    record = F.concat(
        F.lit("AA÷"), text("match_id"), F.when(C("match_id") % 19 == 0, "").otherwise(F.concat(F.lit("¬AE÷"), "home")), F.lit("¬AG÷"), F.when(C("match_id") % 23 == 0, "n/a").otherwise(text("home_score")),
    )
    broken = F.when(C("match_id") % 17 == 0, F.translate(record, "÷¬", "=;")).otherwise(record)
    feeds = m.groupBy("day", "league_code", "part").agg(F.array_join(F.collect_list(broken), "~").alias("raw"))
    records = quarantine.delimited_records(feeds, required=("AA", "AE"), numbers=("AA", "AG"))
    number = F.regexp_extract("raw", r"AA[÷=](\d+)", 1)
    return records.select(
        F.coalesce(C("record")["AA"], number).cast("long").alias("match_id"), "reason", C("record")["AG"].cast("long").alias("home_score"),
    )


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Matches by season and quotes, both bucketed by match, under names of their own."""
    name = f"t{uuid.uuid4().hex}"
    path = live.job_path(spark, "store")
    matches = store.write(V.matches(spark, d), f"{name}_matches", f"{path}/matches", "season")
    return matches, store.write(V.quotes(spark, d), f"{name}_quotes", f"{path}/quotes")


@query(V.sql("""select m.match_id, m.season, count(*) quotes, max(home_odds) best from m join o using (match_id) where season in (select season from m where league_code = 'L2' and status = 'IN_PLAY')
 group by m.match_id, m.season""", V.M, V.O))
def quotes_of_running_seasons(spark, d):
    """Quotes of the seasons in which a match of one league is being played, out of the store."""
    matches, quotes = _stored(spark, d)
    running = store.seasons_where(matches, (C("league_code") == "L2") & (C("status") == "IN_PLAY"))
    joined = store.with_quotes(store.of_seasons(matches, running), quotes)
    return joined.groupBy("match_id", "season").agg(F.count(F.lit(1)).alias("quotes"), F.max("home_odds").alias("best"))
