"""Quarantine of broken payloads, and plans of the partitioned and bucketed store."""

import uuid

from pyspark.sql import functions as F

from fixturelake.plans import views as V
from fixturelake.sources import csv, quarantine, store

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broken_json_costs_single_records(spark, tmp_path):
    bodies = spark.createDataFrame(
        [
            ("whole", '{"events":[{"id":1,"n":2,"t":"a {"},{"id":2,"n":null,"t":null}],"more":[1]}'),
            ("cut", '{"events":[{"id":3,"n":4,"t":"x"}, {"id":4,"n":5,"t":"brok'),
            ("type", '[{"id":5,"n":"five","t":"x"},{"id":6,"n":6,"t":"y"}]'),
            ("missing", '{"e":{"id":null,"n":1,"t":"x"}}'),
            ("none", '{"events":[]}'), ("html", "<html>503</html>"), ("blank", ""), ("null", None),
        ],
        "feed string, body string",
    )
    out = quarantine.json_records(bodies, "id long, n int, t string", '{"id":', required=("id",))
    got = {(r["feed"], r["number"]): (r["reason"], r["record"] and r["record"]["id"], r["raw"] is None) for r in out.collect()}
    assert got == {
        ("whole", 0): (None, 1, True), ("whole", 1): (None, 2, True), ("cut", 0): (None, 3, True), ("cut", 1): ("cut", None, False), ("type", 0): ("type", None, False),
        ("type", 1): (None, 6, True), ("missing", 0): ("missing id", None, False), ("none", None): ("empty", None, False), ("html", None): ("empty", None, False),
        ("blank", None): ("empty", None, False), ("null", None): ("empty", None, False),
    }
    quarantine.write_bad(out, str(tmp_path / "bad"))
    stored = spark.read.parquet(str(tmp_path / "bad"))
    assert stored.count() == 7 and {r["reason"] for r in stored.collect()} == {"cut", "type", "missing id", "empty"}
    assert sorted(r["record"]["id"] for r in quarantine.good(out).collect()) == [1, 2, 3, 6]


def test_broken_delimited_records(spark):
    feeds = spark.createDataFrame([(1, "AA÷7¬AG÷2¬AG÷3~AA=8;AG=1~AA÷9¬AG÷x~AG÷1~~"), (2, ""), (3, None)], "k int, raw string")
    got = {(r["k"], r["number"]): (r["reason"], r["record"] and r["record"]["AG"]) for r in quarantine.delimited_records(feeds, ("AA",), ("AG",)).collect()}
    assert got == {(1, 0): (None, "3"), (1, 1): ("delimiter", None), (1, 2): ("type", None), (1, 3): ("missing AA", None), (2, None): ("empty", None), (3, None): ("empty", None)}


def test_store_prunes_and_joins_without_a_shuffle(spark, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    matches = store.write(V.matches(spark, SF), f"{name}_m", str(tmp_path / "m"), "season")
    quotes = store.write(V.quotes(spark, SF), f"{name}_q", str(tmp_path / "q"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = store.with_quotes(matches.where("season = 1996"), quotes)
        assert "Exchange" not in plan_of(one) and "SortMergeJoin" in plan_of(one)
        assert "PartitionFilters: [isnotnull(season" in plan_of(one) and "(season" in plan_of(one)
        seasons = store.seasons_where(matches, F.col("league_code") == "L1")
        pruned = store.with_quotes(store.of_seasons(matches, seasons), quotes)
        assert "dynamicpruning" in plan_of(pruned)
        # What is shuffled are the seasons only.
        assert not any("Exchange" in line and "match_id" in line for line in plan_of(pruned).splitlines())
        want = V.matches(spark, SF).where("season = 1996").join(V.quotes(spark, SF), "match_id")
        assert one.count() == want.count() > 0
        files = one.inputFiles()
        assert any("season=1996" in f for f in files) and not any("season=1997" in f for f in files)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.drop(spark, f"{name}_m")
        store.drop(spark, f"{name}_q")


def test_season_folders_are_pruned(spark, tmp_path):
    for league, code in (("PL", "2425"), ("PL", "2324"), ("SA", "2425")):
        folder = tmp_path / f"league_code={league}" / f"season_code={code}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text(f"Date,Time,HomeTeam,AwayTeam,FTHG,FTAG\n16/08/2024,20:00,{league} A,{code},1,0\n", encoding="utf-8")
    some = csv.read_season_folders(spark, str(tmp_path)).where("league_code = 'PL' and season_code = '2425'")
    assert "PartitionFilters: [isnotnull(league_code" in plan_of(some)
    (row,) = csv.normalise(some).collect()
    assert (row["home_team"], row["away_team"], row["season"]) == ("PL A", "2425", 2024)
