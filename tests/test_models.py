"""Training, comparison and storing of the classifiers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixturelake.operators import features, models, stats
from fixturelake.plans import catalogue, views

SF = "/root/testdata/sf0.001"
SMALL = {"rounds": 2, "trees": 5, "layers": (8,), "steps": 10}


@pytest.fixture(scope="module")
def table(spark):
    m, market, votes = catalogue._sources(spark, SF)
    return m, features.match_features(stats.finished(m), features.stats_with_form(m), stats.head_to_head(m), market, votes).cache()


def test_train_all_compares_and_stores(spark, table, tmp_path):
    m, rows = table
    fitted, compared = models.train_all(rows, m, ["L0", "L1", "L2", "L3", "L4"], **SMALL)
    got = compared.collect()
    assert {r["model"] for r in got} == {"gbt", "mlp", "forest", "ensemble"} and [r["accuracy"] for r in got] == sorted((r["accuracy"] for r in got), reverse=True)
    assert len({r["total"] for r in got}) == 1
    models.save({"forest": fitted["forest"]}, str(tmp_path))
    again = models.load(["forest"], str(tmp_path))["forest"]
    one = lambda f: sorted(map(tuple, models.probabilities(f, rows, "forest").collect()))
    assert one(again) == one(fitted["forest"])
    with pytest.raises(ValueError, match="training rows"):
        models.train_all(rows, m, ["L0"], [1995], **SMALL)


def test_a_model_of_other_features_is_rejected(spark, table, tmp_path, monkeypatch):
    m, rows = table
    split = features.training_set(m, rows)
    models.save({"forest": models.train(split, **SMALL)["forest"]}, str(tmp_path))
    monkeypatch.setattr(models, "FEATURES", models.FEATURES[:-1])
    with pytest.raises(ValueError, match="other features"):
        models.load(["forest"], str(tmp_path))


def test_value_and_suggestion(spark):
    scores = models.decided(spark.createDataFrame([(1, "ensemble", 0.7, 0.2, 0.1)], "match_id long, model string, home_p double, draw_p double, away_p double"))
    priced = spark.createDataFrame([(1, "Arsenal", "Porto", 2.0, 3.0, 4.0)], "match_id long, home string, away string, home_odds double, draw_odds double, away_odds double")
    r = models.with_value(scores, priced).first()
    assert r["value_rating"] == pytest.approx(0.4) and r["value_tier"] == "medium" and r["suggestion"].startswith("🎯 HIGH CONFIDENCE: Arsenal Win (70%) | 💚 VALUE: Arsenal to win @ 2.00 (EV: 1.40)")


def test_no_match_sees_its_own_or_a_later_score(spark):
    m = views.matches(spark, SF)
    one = stats.finished(m).orderBy("match_date", "match_id").limit(200).agg(F.max(F.struct("match_date", "match_id"))).first()[0]
    changed = m.withColumn("home_score", F.when(F.col("match_date") >= F.lit(one["match_date"]), 7).otherwise(F.col("home_score")))
    pick = lambda x: sorted(map(str, stats.counters_before_match(stats.sides(x)).where(F.col("match_id") == one["match_id"]).collect()))
    met = lambda x: sorted(map(str, stats.head_to_head_before_match(x).where(F.col("match_id") == one["match_id"]).collect()))
    assert pick(m) == pick(changed) and met(m) == met(changed)


def test_counters_before_match_gather_no_history(spark):
    """Many matches at few times: each side sees the newest letters and all counts of strictly earlier times, and no list of all rows is built."""
    rows = [(k, "L0", 2000, dt.datetime(2000, 1, 1 + k // 40), 1, 2, k % 3, k % 2, "FINISHED") for k in range(400)]
    m = spark.createDataFrame(rows, "match_id long, league_code string, season long, match_date timestamp, home_team long, away_team long, home_score long, away_score long, status string")
    out = stats.counters_before_match(stats.sides(m))
    for r in out.where("team = 1 and match_id in (0, 39, 40, 85, 399)").collect():
        before = [x for x in rows if x[3] < rows[r["match_id"]][3]]
        newest = sorted(before, key=lambda x: (x[3], x[0]), reverse=True)[:5]
        assert r["form"] == "".join("W" if x[6] > x[7] else "D" if x[6] == x[7] else "L" for x in newest)
        assert r["matches_played"] == len(before) and r["goals_scored"] == sum(x[6] for x in before) and r["home_wins"] == sum(x[6] > x[7] for x in before)
        assert r["avg_goals_scored"] == (sum(x[6] for x in before) / len(before) if before else None)
    assert "match_id" not in str([x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x and "Window" in x])


def test_model_scores_stores_its_training_rows(spark, monkeypatch):
    """Training and scores read a stored table; no window or join of the features is planned again for them."""
    seen = []

    def train(rows, **sizes):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        raise ValueError("stop")

    monkeypatch.setattr(models, "train", train)
    with pytest.raises(ValueError, match="stop"):
        catalogue.model_scores(spark, SF)
    assert "Window" not in seen[0] and "Join" not in seen[0]


def test_model_scores_trains_whole_models(spark, monkeypatch):
    """200 rounds, 300 trees and 100 steps as the operator and the reference have them: the query passes no sizes of its own."""
    seen = []

    def train(rows, **sizes):
        seen.append(sizes)
        raise ValueError("stop")

    monkeypatch.setattr(models, "train", train)
    with pytest.raises(ValueError, match="stop"):
        catalogue.model_scores(spark, SF)
    assert seen == [{}]
    chosen = models.estimators()
    assert chosen["forest"].getNumTrees() == 300 and chosen["mlp"].getMaxIter() == 100 and models.boosting.Settings().rounds == 200
