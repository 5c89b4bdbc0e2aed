"""Classifiers, ensemble and Poisson scores on the feature table."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.functions import scalars as X
from fixturelake.operators import boosting
from fixturelake.operators.boosting import BoostedModel
from fixturelake.operators.features import FEATURES, training_set

# Weights of the ensemble.
ENSEMBLE_WEIGHTS = {"gbt": 0.40, "mlp": 0.35, "forest": 0.25}


def class_weights(rows: DataFrame) -> DataFrame:
    """Add weight n / (classes * n of the class); the class counts are a few rows."""
    return rows.join(F.broadcast(weights_of(class_counts(rows))), "label")


def class_counts(rows: DataFrame) -> DataFrame:
    """Number of rows of each label."""
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def weights_of(counts: DataFrame) -> DataFrame:
    every = W.partitionBy()  # over a row per class
    return counts.select("label", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def preparation() -> list:
    return [
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
    ]


def estimators(trees: int = 300, layers: tuple = (128, 64, 32), steps: int = 100, seed: int = 42) -> dict:
    return {
        "mlp": MultilayerPerceptronClassifier(layers=[len(FEATURES), *layers, 3], maxIter=steps, seed=seed),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=10, minInstancesPerNode=2, weightCol="weight", seed=seed),
    }


def train(rows: DataFrame, least: int = 50, rounds: int = 200, **sizes) -> dict[str, PipelineModel | BoostedModel]:
    """Fit all models on the training part of rows, of which there must be some; the scaler sees training rows only.

    The boosted trees need no scaler, since only the order of a feature's values counts for them. The models are
    trained side by side, so that the small jobs of one use cores that another leaves free.
    """
    if rows.where("is_train").limit(least).count() < least:
        raise ValueError(f"fewer than {least} training rows")
    weighted = class_weights(rows.where("is_train").drop("is_train")).cache()
    jobs = {"gbt": lambda: boosting.fit(weighted, FEATURES, boosting.Settings(rounds=rounds))}
    jobs |= {name: lambda e=e: Pipeline(stages=[*preparation(), e]).fit(weighted) for name, e in estimators(**sizes).items()}
    with ThreadPool(len(jobs)) as pool:
        # Each in a thread of its own that has the session's properties.
        found = [pool.apply_async(inheritable_thread_target(rows.sparkSession)(fit)) for fit in jobs.values()]
        fitted = {name: f.get() for name, f in zip(jobs, found, strict=True)}
    weighted.unpersist()
    return fitted


def train_all(features: DataFrame, matches: DataFrame, leagues: list[str], seasons: list[int] | None = None, **sizes) -> tuple[dict[str, PipelineModel | BoostedModel], DataFrame]:
    """(models, their accuracy on the later matches) over the finished matches of some leagues and seasons together."""
    chosen = matches.where(F.col("league_code").isin(leagues))
    if seasons is not None:
        chosen = chosen.where(F.col("season").isin(seasons))
    rows = training_set(chosen, features).cache()
    fitted = train(rows, **sizes)
    later = rows.where(~F.col("is_train"))
    scores = score_all(fitted, later)
    compared = accuracy_by_model(scores.unionByName(ensemble(scores)), later)
    rows.unpersist()
    return fitted, compared


def with_value(scores: DataFrame, matches: DataFrame) -> DataFrame:
    """Decided scores with value rating, its tier and a suggestion; matches: match_id, home, away and home/draw/away_odds."""
    p, o = [F.col(f"{k}_p") for k in ("home", "draw", "away")], [F.col(f"{k}_odds") for k in ("home", "draw", "away")]
    joined = scores.join(matches.select("match_id", "home", "away", *[f"{k}_odds" for k in ("home", "draw", "away")]), "match_id", "left")
    value = X.value_rating(*p, *o)
    return joined.select(*scores.columns, value.alias("value_rating"), X.value_tier(value).alias("value_tier"), X.suggestion(*p, *o, F.col("home"), F.col("away"), F.col("confidence")).alias("suggestion"))


def probabilities(model: PipelineModel | BoostedModel, rows: DataFrame, name: str) -> DataFrame:
    """match_id, model and the three probabilities."""
    if isinstance(model, BoostedModel):
        return model.probabilities(rows).select("match_id", F.lit(name).alias("model"), "home_p", "draw_p", "away_p")
    p = vector_to_array("probability")
    return model.transform(rows).select("match_id", F.lit(name).alias("model"), *[p[i].alias(k) for i, k in enumerate(("home_p", "draw_p", "away_p"))])


def score_all(fitted: dict[str, PipelineModel | BoostedModel], rows: DataFrame) -> DataFrame:
    """Every match by every model, in long form."""
    out = None
    for name, model in fitted.items():
        one = probabilities(model, rows, name)
        out = one if out is None else out.unionByName(one)
    return out


def ensemble(scores: DataFrame, weights: dict[str, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    """Weighted mean of the models that are there; decimal sums, so that the order of rows doesn't matter."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("model") == name, value).otherwise(w)
    total = lambda x: F.sum(x.cast("decimal(20,15)")).cast("double")
    mean = lambda c: (total(F.col(c) * w) / total(w)).alias(c)
    return scores.groupBy("match_id").agg(mean("home_p"), mean("draw_p"), mean("away_p")).withColumn("model", F.lit("ensemble"))


def decided(scores: DataFrame) -> DataFrame:
    """Add outcome and confidence."""
    h, d, a = F.col("home_p"), F.col("draw_p"), F.col("away_p")
    return scores.withColumn("outcome", X.argmax_outcome(h, d, a)).withColumn("confidence", F.greatest(h, d, a))


def best_per_match(scores: DataFrame, preferred: str = "ensemble") -> DataFrame:
    """The ensemble if there is one, else the most confident model."""
    return scores.groupBy("match_id").agg(
        F.max_by(F.struct("model", "outcome", "confidence"), F.struct((F.col("model") == preferred).alias("e"), "confidence", "model")).alias("b")
    ).select("match_id", "b.*")


def expected_goals(matches: DataFrame, team_stats: DataFrame, averages: DataFrame) -> DataFrame:
    """Expected goals of both teams, limited to 0.1..5, two decimals."""
    side = lambda k: team_stats.select(
        F.col("team").alias(f"{k}_team"), "league_code", "season", F.round("avg_goals_scored", 2).alias(f"{k}_attack"), F.round("avg_goals_conceded", 2).alias(f"{k}_defence")
    )
    joined = matches.join(side("home"), ["home_team", "league_code", "season"]).join(side("away"), ["away_team", "league_code", "season"])
    one = F.lit(1).alias("one")  # averages is one row
    joined = joined.select("*", one).join(F.broadcast(averages.select("*", one)), "one")
    home = F.col("home_attack") * F.col("away_defence") / F.col("avg_away_goals") * F.col("avg_home_goals")
    away = F.col("away_attack") * F.col("home_defence") / F.col("avg_home_goals") * F.col("avg_away_goals")
    limited = lambda c: F.round(F.greatest(F.lit(0.1), F.least(F.lit(5.0), c)), 2)
    return joined.select("match_id", limited(home).alias("home_goals"), limited(away).alias("away_goals"))


def poisson(goals: DataFrame, renormalise: bool = False) -> DataFrame:
    """Outcome probabilities on an 8 x 8 grid of goals; the cut tail is left out or, renormalised, shared."""
    h, a = F.col("home_goals"), F.col("away_goals")
    each = goals.select("*", X.poisson_outcomes(h, a).alias("_p"))
    out = each.select(*goals.columns, *[F.col(f"_p.{k.lower()}").alias(f"{k.lower()}_p") for k in X.OUTCOMES])
    if renormalise:
        total = F.col("home_p") + F.col("draw_p") + F.col("away_p")
        out = out.select(*goals.columns, *[(F.col(f"{k.lower()}_p") / total).alias(f"{k.lower()}_p") for k in X.OUTCOMES])
    return out


def accuracy_by_model(scores: DataFrame, labelled: DataFrame) -> DataFrame:
    """Hits on labelled rows (match_id, label) per model, best first."""
    actual = F.element_at(F.array(*[F.lit(x) for x in X.OUTCOMES]), F.col("label").cast("int") + 1)
    joined = decided(scores).join(labelled.select("match_id", actual.alias("actual")), "match_id")
    hit = F.count_if(F.col("outcome") == F.col("actual"))
    return joined.groupBy("model").agg(F.count(F.lit(1)).alias("total"), hit.alias("correct"), (hit / F.count(F.lit(1))).alias("accuracy")).orderBy(F.desc("accuracy"))


def save(fitted: dict[str, PipelineModel | BoostedModel], path: str) -> None:
    for name, model in fitted.items():
        if isinstance(model, BoostedModel):
            model.save(SparkSession.active(), f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")


def load(names: list[str], path: str) -> dict[str, PipelineModel | BoostedModel]:
    """Stored models; one built for other features is rejected."""
    out = {}
    for name in names:
        model = BoostedModel.load(SparkSession.active(), f"{path}/{name}") if name == "gbt" else PipelineModel.load(f"{path}/{name}")
        known = model.features if isinstance(model, BoostedModel) else model.stages[0].getInputCols()
        if list(known) != list(FEATURES):
            raise ValueError(f"model {name} was trained on other features")
        out[name] = model
    return out
