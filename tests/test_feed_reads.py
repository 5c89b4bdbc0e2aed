"""Feeds are parsed in their own rows, and captures are read no more often than needed."""

from pyspark.sql import functions as F

from fixturelake.sources import delimited, html, json_feeds


def test_odds_feed_is_parsed_without_a_shuffle(spark):
    raw = "OE÷9¬junk¬OD÷b1¬OE÷1.5¬OE÷1.6¬OG÷6¬OD÷¬OE÷2¬OD÷b2¬OX÷1¬OD÷b3¬OF÷3÷4¬OD÷b4¬OF÷3.5"
    out = delimited.odds_feed(spark.createDataFrame([(1, raw), (2, None), (3, "")], "payload_id int, raw string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "b1", 1.6, None, 6.0), (1, "b3", None, None, None), (1, "b4", None, 3.5, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_rows_of_links_do_not_carry_their_page(spark):
    pages = spark.createDataFrame([("u", '<a href="/result/1/2/A%20B/C">x</a> 40 30 30 tip X at 1.55 score 2-1 <a href="/result/1/2/D/E">y</a> 5')], "url string, html string")
    out = html.link_context(pages)
    assert [tuple(r) for r in out.collect()] == [("u", "A B", "C", 40, 30, 30, "X", 1.55, "2-1")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("html" not in line.split("],")[1] for line in plan.splitlines() if "Generate explode(transform" in line)


def test_captures_of_leagues_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(body):
        made.add(1)
        return body

    event = '{"events":[{"event":{"id":1,"name":"A - B","start":"2024-01-01","path":[{"name":"X"}]},"betOffers":[]}]}'
    empty, full = (spark.createDataFrame([("L1", b)], "league_code string, body string") for b in ('{"events":[]}', event))
    counted = full.repartition(1).withColumn("body", seen.asNondeterministic()("body"))
    assert [r["league_code"] for r in json_feeds.odds_scan(empty, counted).collect()] == ["L1"]
    assert made.value == 1
    assert [r["league_code"] for r in json_feeds.odds_scan(full, full).collect()] == [""]
