"""Links of vectors whose variance is concentrated, and of vectors of several lengths."""

import numpy as np
import pytest

from fixturelake.llm import neardup


def counts(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ((u @ u.T) >= 0.95).sum(1) - 1


@pytest.mark.parametrize("block", [neardup.BLOCK, 150])
def test_every_link_of_a_decaying_spectrum_and_of_each_length(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    scale = np.arange(1, 33) ** -1.5
    base = rng.normal(size=(1500, 32)) * scale
    x = np.float32(np.concatenate([base, base + rng.normal(size=base.shape) * scale * 0.3])).astype(float)
    other = np.float32(rng.normal(size=(40, 3))).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v.tolist()) for i, v in enumerate(other)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    want = dict(enumerate(counts(x))) | {10_000 + i: n for i, n in enumerate(counts(other))}
    assert sum(counts(other)) > 0
    assert {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()} == want


def test_every_link_within_a_subspace(spark, monkeypatch):
    """Vectors of 64 dimensions that lie in three: centroids differ along the directions in which partners do."""
    monkeypatch.setattr(neardup, "BLOCK", 200)
    rng = np.random.default_rng(4)
    x = np.float32(rng.normal(size=(1200, 3)) @ rng.normal(size=(3, 64))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()} == dict(enumerate(counts(x)))


def test_tiny_and_huge_doubles_link(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.01]), (3, [1e-200, 1e-200]), (4, [1e200, 1.001e200]), (5, [5e-324, 5e-324]), (6, [-1e-200, 1e-200]), (7, [1.7e308, -1.7e308])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (6, 0, 6), (7, 0, 7)]


def test_vectors_without_clusters_are_not_copied_per_cell(spark, monkeypatch):
    """Where every cell is probed by every vector, no stored table has more rows than there are vectors."""
    monkeypatch.setattr(neardup, "BLOCK", 100)
    stored, materialise = {}, neardup.materialise

    def counted(df, name="table"):
        out = materialise(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    x = np.float32(np.random.default_rng(6).normal(size=(1500, 32))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()} == dict(enumerate(counts(x)))
    assert stored["pq-blocks"] >= 15 and max(stored.values()) <= 1500


def test_zeros_of_either_sign_are_one_vector(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, 0.0])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
