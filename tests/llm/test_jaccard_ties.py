"""Ties between the classes of a large group of near copies."""

import random

from fixturelake.llm import components, jaccard


def test_about_one_tie_per_class_and_the_same_components(spark):
    rng = random.Random(6)
    # Two groups; in each band a class is in one of twelve buckets.
    buckets: dict = {}
    for i in range(600):
        for band in range(51):
            buckets.setdefault((i % 2, band, rng.randrange(12)), []).append(i)
    members = [(i, min(ids)) for ids in buckets.values() for i in ids]
    table = spark.createDataFrame(members, "id long, low long")
    edges = jaccard.ties(table)
    lows = {low for _, low in members}
    assert edges.count() <= 600 + len(lows)
    assert len({(a, b) for a, b in members if a != b}) > 6_000
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: i % 2 for i in range(600)}
