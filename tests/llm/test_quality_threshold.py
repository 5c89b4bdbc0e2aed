"""The threshold of the quality rules counts every trusted text."""

import random

from fixturelake.llm import quality


def test_values_at_places_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    found = [rng.gauss(0, 1) for _ in range(3_000)] + [0.25] * 500 + [1e6, -1e6]
    table = spark.createDataFrame([(x,) for x in found], "score double")
    places = [0, 1, 35, 1_700, 2_000, len(found) - 1]
    for ranges in (2, 4_096):
        monkeypatch.setattr(quality, "RANGES", ranges)
        assert quality.values_at(table, places[-2:] if ranges == 2 else places) == [sorted(found)[k] for k in (places[-2:] if ranges == 2 else places)]


def test_all_trusted_texts_set_the_threshold(spark):
    rng = random.Random(5)
    # More than the 4,000 of smallest hash that used to count, which score higher here; copies count once, failed texts not.
    rows = [(h, rng.random() + (h < 5_000)) for h in range(10_000)]
    scored = spark.createDataFrame([*rows, *rows[:3_000], (20_000, None), (30_000, -9.0)], "h long, score double")
    trusted = spark.createDataFrame([(h,) for h in [*range(10_000), 20_000]], "h long")
    assert quality.held_out_threshold(scored, trusted) == quality.threshold_of([s for _, s in rows])
    assert quality.held_out_threshold(scored, trusted.limit(0)) == quality.THRESHOLD


def test_no_trusted_id_is_left_out(spark):
    labels = spark.range(60_000).selectExpr("id doc_id", "1 quality")
    assert quality.trusted_ids(labels).count() == 60_000
