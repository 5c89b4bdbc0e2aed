"""Blocked name joins against nested loops, with aliases and names inside words."""

import re

from pyspark.sql import functions as F

from fixturelake.functions import names as N
from fixturelake.operators import entity

NAMES = ["Spurs", "Tottenham Hotspur", "PSG", "Paris Saint-Germain", "Gladbach", "Borussia Monchengladbach", "old plate", "cold ring", "ol", "Arsenal FC", "arsenal", "x", "Real Madrid", "Madrid"]


def test_blocks_lose_no_pair(spark):
    t = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id long, name string")
    r = t.select("name", N.canonical_name(F.col("name")).alias("c"), N.legacy_name(F.col("name")).alias("l"))
    a, b = (r.select(*[F.col(c).alias(c + k) for c in r.columns]) for k in "ab")
    want = a.crossJoin(b).where(N.same_team(F.col("ca"), F.col("cb"), F.col("la"), F.col("lb"))).select("namea", "nameb")
    assert sorted(map(tuple, entity.same_teams(t, t).collect())) == sorted(map(tuple, want.collect()))
    asked = t.select("id", F.concat(F.split(F.lower("name"), " ")[0], F.lit(" xx")).alias("name"))
    got = {(r["id"], r["stored"]) for r in entity.exact_then_partial(asked, t).collect()}
    low = [n.lower() for n in NAMES]
    assert got == {(i, s) for i, n in enumerate(low) for s in low if n.split(" ")[0] in s or s in n.split(" ")[0] + " xx"}
    left = t.select("id", F.lower("name").alias("home"), F.lower("name").alias("away"))
    right = t.select(F.col("id").alias("pos"), F.lower("name").alias("home"), F.reverse(F.lower("name")).alias("away"))
    l, r = (d.select(*[F.col(c).alias(f"{k}_{c}") for c in d.columns]) for d, k in ((left, "l"), (right, "r")))
    score = N.side_score(F.col("l_home"), F.col("r_home")) + N.side_score(F.col("l_away"), F.col("r_away"))
    best = {}
    for x in l.crossJoin(r).withColumn("score", score).where("score >= 1").orderBy(F.desc("score"), "r_pos").collect():
        best.setdefault(x["l_id"], (x["r_pos"], x["score"]))
    assert {x["id"]: (x["pos"], x["score"]) for x in entity.best_scored_match(left, right, least=1).collect()} == best


def test_rare_pieces_and_words_keep_candidates_few(spark):
    """Names with one beginning and noise words meet few others, and none that a nested loop accepts is lost."""
    kinds = ["fc", "de", "la", "real club", "united"]
    rows = [f"{kinds[i % 5]} {chr(97 + i % 23)}{chr(97 + i % 19)}{chr(97 + i % 17)}{i} {'city' if i % 3 else 'town'}" for i in range(600)]
    t = spark.createDataFrame([(n,) for n in rows], "name string").repartition(4)
    names = t.select(F.col("name").alias("needle"))
    rarest, _ = entity.rarest_pieces(names, t.select(F.col("name").alias("hay")))
    assert rarest.agg(F.max("n"), F.sum("n")).first()[0] <= 60
    words = t.select("name", N.team_words(F.col("name")).alias("words"))
    met = entity.overlap_candidates(words, words).distinct()
    pairs = met.withColumn("true", N.half_shared(N.team_words(F.col("a")), N.team_words(F.col("b"))))
    # With two words of which one is shared, candidates are the result itself.
    n, good = pairs.agg(F.count(F.lit(1)), F.count_if("true")).first()
    assert n <= 1.1 * good
    long = spark.createDataFrame([(f"a{i} b{i} c{i % 40} d{i % 7} e{i % 3}",) for i in range(600)], "name string").select("name", N.team_words(F.col("name")).alias("words"))
    n = entity.overlap_candidates(long, long).distinct().count()
    # Five words, three of which must be shared: blocks on all words would give over a hundred thousand pairs.
    assert 600 <= n < 12_000
    l = long.select(F.col("name").alias("a"), F.col("words").alias("wa"))  # noqa: E741
    r = long.select(F.col("name").alias("b"), F.col("words").alias("wb"))
    want = l.crossJoin(r).where(N.half_shared(F.col("wa"), F.col("wb"))).select("a", "b")
    one = lambda df: df.select(F.col("name").alias("a"))
    assert sorted(map(tuple, entity.same_words(one(long), one(long).withColumnRenamed("a", "b")).collect())) == sorted(map(tuple, want.collect()))


def test_best_match_leaves_itself_out(spark):
    left = spark.createDataFrame([(1, "leeds", "spurs"), (2, "leeds", "spurs"), (3, "hull", "spurs")], "id long, home string, away string")
    right = left.withColumnRenamed("id", "pos")
    got = {r["id"]: (r["pos"], r["score"]) for r in entity.best_scored_match(left, right, not_itself=True).collect()}
    assert got == {1: (2, 4), 2: (1, 4), 3: (1, 2)}


def test_hot_pair_of_names_meets_its_last_event_only(spark):
    """The last event of each pair is taken before predictions are joined, so a pair isn't multiplied."""
    n = 2_000
    asked = spark.range(n).select("id", F.lit("a b").alias("home"), F.lit("c d").alias("away"))
    events = spark.range(n).select(F.col("id").alias("pos"), F.expr("if(id < 0, '', 'a b')").alias("home"), F.expr("if(id < 0, '', 'c d')").alias("away"), F.lit(2.0).alias("home_odds"))
    out = entity.attach_odds(asked, events)
    assert out.groupBy("pos", "available").count().collect() == [(n - 1, True, n)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[(?![^\]]*\bid#)[^\]]*\], \[[^\]]*max\(pos", plan)  # not by id
