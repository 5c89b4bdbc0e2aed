"""Name joins read each of their inputs a bounded number of times."""

import pytest
from pyspark.sql import functions as F

from fixturelake.operators import attach, entity

ROWS = 40


@pytest.fixture
def counted(spark):
    """A table of events that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        made.add(1)
        return i

    teams = F.array(*[F.lit(t) for t in ("Arsenal FC", "PSG", "Spurs", "Wolves")])
    rows = spark.range(ROWS).repartition(2).select(seen.asNondeterministic()("id").alias("id"), F.get(teams, F.pmod("id", F.lit(4)).cast("int")).alias("home"), F.get(teams, F.pmod(F.col("id") + 1, F.lit(4)).cast("int")).alias("away"))
    return rows.select("*", *[F.lit(2.0 + k).alias(f"{n}_odds") for k, n in enumerate(attach.KINDS)]), made


@pytest.fixture
def matches(spark):
    return spark.createDataFrame([(1, "Arsenal", "Paris Saint-Germain"), (2, "Tottenham Hotspur", "Wolverhampton Wanderers"), (3, "Arsenal", "Paris Saint-Germain")], "pos long, home string, away string")


def test_rows_are_read_for_their_pairs_and_for_the_result(counted, matches):
    events, made = counted
    got = entity.first_fuzzy_match(events, matches).collect()
    assert {(r["home"], r["pos"]) for r in got} == {("Arsenal FC", 1), ("Spurs", 2)} and len(got) == ROWS // 2
    assert made.value <= 2 * ROWS


def test_new_matches_are_those_of_unknown_pairs(counted, matches):
    events, made = counted
    got = entity.keep_new_matches(matches, events).collect()
    assert {r["home"] for r in got} == {"PSG", "Wolves"} and len(got) == ROWS // 2
    assert made.value <= 2 * ROWS


def test_market_rows_and_predictions_read_events_twice_at_most(spark, counted, matches):
    events, made = counted
    assert attach.market_rows(matches, events, "m").count() == ROWS // 2
    assert made.value <= 2 * ROWS
    asked = spark.createDataFrame([(i, "Arsenal FC", "PSG", "S", 50.0, 30.0, 20.0, "1", "Yes") for i in range(3)], "id long, home string, away string, source string, home_pct double, draw_pct double, away_pct double, tip string, btts string")
    before = made.value
    out = attach.attach_predictions(asked, matches, events).collect()
    assert [(r["match_id"], r["odds_at_scrape"]["draw"]) for r in out] == [(1, 3.0)] * 3
    assert made.value - before <= ROWS
