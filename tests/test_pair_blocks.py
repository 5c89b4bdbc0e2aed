"""All pairs of rows with the same teams: whole, spread over tasks and small when written."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixturelake.operators import entity


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(entity, "SHARES", (7, 5))
    monkeypatch.setattr(entity, "BLOCK", 3)
    monkeypatch.setattr(entity, "TASK_ROWS", 50)


def test_all_pairs_with_nulls_and_repeats(spark, small_cells):
    known = {"Arsenal": "Arsenal FC", "Paris Saint-Germain": "PSG", "Tottenham Hotspur": "Spurs"}
    names = [*known, None, "Nowhere"]
    left = [(None if i % 9 == 0 else i % 31, names[i % 5], names[(i // 5) % 5]) for i in range(200)]
    right = [(None if i % 8 == 0 else i % 17, known.get(names[i % 5], names[i % 5]) if i % 3 else names[i % 5], known.get(names[(i // 5) % 5])) for i in range(150)]
    got = entity.all_fuzzy_matches(spark.createDataFrame(left, "id long, home string, away string"), spark.createDataFrame(right, "pos long, home string, away string")).collect()
    same = lambda a, b: a is not None and b is not None and known.get(a, a) == known.get(b, b)
    assert Counter((r["id"], r["pos"]) for r in got) == Counter((i, p) for i, h, a in left for p, rh, ra in right if same(h, rh) and same(a, ra))
    assert len(got) > 500


def test_no_rows_give_no_pairs(spark, small_cells):
    left = spark.createDataFrame([(1, "Arsenal", "PSG")], "id long, home string, away string")
    assert entity.all_fuzzy_matches(left, left.withColumnRenamed("id", "pos").where("pos > 1")).columns == ["id", "pos"]
    assert entity.all_fuzzy_matches(left, left.withColumnRenamed("id", "pos").where("pos > 1")).count() == 0


def _one_pair(spark, rows):
    one = lambda c: spark.range(0, 7 * rows, 7, 1).select(F.col("id").alias(c), F.lit("Arsenal").alias("home"), F.lit("PSG").alias("away"))
    return entity.all_fuzzy_matches(one("id"), one("pos"))


def test_a_frequent_pair_is_spread_over_tasks(spark, small_cells):
    per_task = _one_pair(spark, 100).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 100 * 100
    assert max(r["count"] for r in per_task) < 100 * 100 / 10


def test_written_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    rows = 2000
    _one_pair(spark, rows).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in Path(tmp_path, "out").glob("*.parquet")) < rows * rows / 6
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows * rows


def test_the_join_and_the_explosion_are_separate_steps(spark, small_cells):
    """Fused, the join buffers the pairs of one block with all blocks of its cell, so memory grows with a pair of names."""
    out = _one_pair(spark, 30)
    assert len(out.collect()) == 900
    plan = out._jdf.queryExecution().executedPlan().toString()
    stages = lambda node: set(re.findall(rf"\*\((\d+)\) {node}", plan))
    joined, exploded = stages("SortMergeJoin"), stages("Generate explode")
    assert joined and exploded and not joined & exploded and "Coalesce" in plan
