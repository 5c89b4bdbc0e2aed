"""Language-model scores against counting loops in plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fixturelake.llm import lm

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


class Plain:
    """N-gram counts of texts; two start tokens stand before each."""

    def __init__(self, texts):
        self.n = [Counter(), Counter(), Counter()]
        for text in texts:
            w = ["start", "start", *tokens(text)]
            self.n[0].update(w[1:])
            self.n[1].update(zip(w, w[1:], strict=False))
            self.n[2].update(zip(w, w[1:], w[2:], strict=False))
        self.types = set(self.n[0]) - {"start"}
        self.size = sum(self.n[0][x] for x in self.types)

    def counts(self, a, b, x):
        """Counts of the token, with one and two before, and of the one and two before."""
        return self.n[0][x], self.n[1][b, x], self.n[2][a, b, x], self.n[0][b], self.n[1][a, b]

    def of_text(self, text):
        w = ["start", "start", *tokens(text)]
        return tuple(np.array(x, float) for x in zip(*(self.counts(*g) for g in zip(w, w[1:], w[2:], strict=False)), strict=True))


@pytest.mark.parametrize("block_bytes", [lm.BLOCK_BYTES, 3_000])
def test_counts_scores_and_weights(spark, monkeypatch, block_bytes):
    """With blocks of many texts, and with texts that are cut over several blocks."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = Plain([t for i, t in text.items() if fold(i) != lm.HELD_OUT])
    most = Plain([t for i, t in text.items() if fold(i) not in (lm.HELD_OUT, lm.TUNING)])
    rows = []
    for i, t in text.items():
        if fold(i) == lm.TUNING:
            rows.append(lm.statistics(most.of_text(t), most.size).to_pandas())
    stats = {}
    for r in (r for x in rows for r in x.to_dict("records")):
        key = (r["c"], r["b1"], r["b2"], r["b3"])
        had = stats.setdefault(key, dict.fromkeys(("n", "l1", "l2", "l3"), 0))
        for k in had:
            had[k] += r[k]
    weights = lm.learn_weights([dict(zip(("c", "b1", "b2", "b3"), k, strict=True)) | v for k, v in stats.items()], len(most.types))
    _, _, _, n, v, learned = lm.lm_model(docs)
    assert (n, v) == (every.size, len(every.types)) and np.allclose(learned, weights, atol=1e-6)
    got = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    assert len(got) == len(text)
    for i, t in text.items():
        r, c = got[i], every.of_text(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i) == 0, len(c[0]), int((c[0] > 0).sum()), n)
        assert r["base_score"] == pytest.approx(np.log10((c[0] + 0.1) / (n + 0.1 * (v + 1))).sum(), rel=1e-9)
        assert r["score"] == pytest.approx(np.log10(lm.probabilities(*c, n, v, learned)).sum(), rel=1e-9)
    held = [i for i in text if fold(i) == 0]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown type, in contexts seen together, apart and never."""
    model = Plain(["a b a c", "a b b", "c a b a", "", "b"] + [f"w{i} a" for i in range(30)])
    rng = np.random.default_rng(1)
    raw = rng.random((2 * lm.CONTEXT_BUCKETS, 4))
    rows = [{"c": c, "b1": 1, "b2": int(c > 0), "b3": int(c >= lm.CONTEXT_BUCKETS), "n": 10, "l1": -10 * raw[c, 1], "l2": -10 * raw[c, 2], "l3": -10 * raw[c, 3]} for c in range(2 * lm.CONTEXT_BUCKETS)]
    for weights in (lm.learn_weights(rows, len(model.types)), lm.learn_weights([], len(model.types))):
        assert np.allclose(weights.sum(1), 1) and (weights >= 0).all()
        for a, b in [("start", "start"), ("start", b"a"), (b"a", b"b"), (b"b", b"b"), (b"c", b"b"), (b"nobody", b"a"), (b"nobody", b"no"), (b"w3", b"a")]:
            c = tuple(np.array(x, float) for x in zip(*(model.counts(a, b, x) for x in [*model.types, "unknown"]), strict=True))
            assert lm.probabilities(*c, model.size, len(model.types), weights).sum() == pytest.approx(1)


def test_em_recovers_weights():
    rows = [
        {"c": 27, "b1": 5, "b2": 0, "b3": 0, "n": 300, "l1": 300 * math.log2(0.1), "l2": 0.0, "l3": 0.0},
        {"c": 27, "b1": 5, "b2": 2, "b3": 0, "n": 700, "l1": 700 * math.log2(0.001), "l2": 700 * math.log2(0.9), "l3": 0.0},
    ]
    w = lm.learn_weights(rows, 10**6)
    assert w[27][2] == pytest.approx(0.7, abs=0.02) and w[27].sum() == pytest.approx(1)


def test_weights_beat_any_mix_nearby():
    """Likelihood of the tuning tokens at the learned weights, against weights moved a little."""
    rng = np.random.default_rng(5)
    rows = [{"c": 30, "b1": int(b), "b2": int(x), "b3": int(y), "n": int(n), "l1": n * -b, "l2": n * -x * 1.0, "l3": n * -y * 0.5} for b, x, y, n in zip(*(rng.integers(1, 12, 40) for _ in range(3)), rng.integers(1, 50, 40), strict=True)]
    v = 1000
    best = lm.learn_weights(rows, v, rounds=3000)[30]
    p = np.array([[1 / (v + 1), *(2.0 ** (r[f"l{k}"] / r["n"]) for k in (1, 2, 3))] for r in rows])
    value = lambda w: float((np.array([r["n"] for r in rows]) * np.log(p @ w)).sum())
    for _ in range(50):
        other = np.abs(best + rng.normal(size=4) * 0.05)
        assert value(other / other.sum()) <= value(best) + 1e-6


def test_awkward_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in lm.lm_scores(odd_docs).collect()}
    assert lm.lm_scores(odd_docs).count() == odd_docs.count() and got[2]["n_tokens"] == 1
    assert lm.lm_scores(no_docs).count() == 0
    alone = next(i for i in range(100) if fold(i) == 0)
    (one,) = lm.lm_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (one["n_known"], one["train_tokens"]) == (0, 0) and one["base_score"] == pytest.approx(0) and one["score"] <= 0


def test_packing_round_trips():
    rng = np.random.default_rng(6)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 2**47, 50, np.uint64), np.array([0, 254, 255, 256, 2**40], np.uint64)):
        assert (lm.unpack_counts(lm.pack_counts(values), len(values)) == values).all()
        assert (lm.unpack_sorted(lm.pack_sorted(np.sort(values))) == np.sort(values)).all()
    text = b"one two  three\tfour " * 50
    parts = list(lm.pieces_of(text, 30))
    assert b" ".join(p for p, _, _ in parts).split() == text.split() and [last for _, last, _ in parts] == [False] * (len(parts) - 1) + [True]
    seen: list = []
    for p, _, before in parts:
        assert before == tuple(int(x) for x in [lm._START, lm._START, *seen][-2:])
        seen += lm.token_hashes(p).tolist()
