"""Quality rules against plain Python, and what a filter on their columns costs."""

import math
import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fixturelake.llm import quality
from fixturelake.llm.common import let, words_of

SF = "/root/testdata/sf0.001"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measures(text):
    text, w = text or "", words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(data, seed=42):
    return signed(xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1))


def plain_hash(text):
    return 42 if text is None else hash_of(text.encode())


def plain_features(text, buckets):
    h = [hash_of(w.encode()) for w in words(text)]
    pair = lambda a, b: hash_of(b.to_bytes(8, "little", signed=True), hash_of(a.to_bytes(8, "little", signed=True)))
    return [x % buckets for x in h] + [pair(a, b) % buckets for a, b in zip(h, h[1:], strict=False)]


def plain_quality(texts, trusted, buckets):
    """Score of each distinct text and threshold, by counting loops; trusted: hashes of trusted texts."""
    fold = {t: hash_of(b"fold", plain_hash(t)) % quality.FOLDS for t in texts}
    target, raw = [Counter() for _ in range(quality.FOLDS)], [Counter() for _ in range(quality.FOLDS)]
    for t in texts:
        raw[fold[t]].update(plain_features(t, buckets))
        if plain_hash(t) in trusted:
            target[fold[t]].update(plain_features(t, buckets))
    scores = {}
    for t in texts:
        own = sum((target[k] for k in range(quality.FOLDS) if k != fold[t]), Counter())
        every = sum((raw[k] for k in range(quality.FOLDS) if k != fold[t]), Counter())
        share = sum(own.values()) / max(sum(every.values()), 1)
        grams = plain_features(t, buckets)
        scores[t] = sum(math.log((own[b] + quality.PRIOR) / (share * every[b] + quality.PRIOR)) for b in grams) / max(len(grams), 1)
    return scores


def failed(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def test_measures_equal_plain_ones(docs, labels, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = quality.quality(df, labels).collect()
        assert sorted((str(r["doc_id"]), *(r[n] for n in NAMES)) for r in got) == sorted((str(r["doc_id"]), *measures(r["text"])) for r in df.collect())
        assert all(r["base_failed"] == failed([r[n] for n in NAMES]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality.quality(no_docs, labels).count() == 0
    assert quality.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_scores_and_verdicts_equal_plain_ones(docs, labels):
    rows = docs.collect()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    trusted = {plain_hash(r["text"]) for r in rows if r["doc_id"] in good}
    scores = plain_quality({r["text"] for r in rows}, trusted, 512)
    limit = quality.threshold_of([s for t, s in scores.items() if plain_hash(t) in trusted and not failed(measures(t))])
    got = {r["doc_id"]: r for r in quality.quality(docs, labels, buckets=512).collect()}
    for r in rows:
        one, s = got[r["doc_id"]], scores[r["text"]]
        assert one["score"] == pytest.approx(s, abs=2e-6)
        if abs(s - limit) > 1e-5:
            assert one["kept"] == (s >= limit and not failed(measures(r["text"])))


@pytest.mark.parametrize("bits", [3, 64])
def test_repeats_are_exact_whatever_the_hash(spark, bits):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["a b c", "a b c a b c", "a a a a", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n = let(words_of(F.col("text")), lambda w: let(quality._hashes(w), lambda h: quality.repeat_words(w, h, bits)))
    assert {r["doc_id"]: r["n"] for r in df.select("doc_id", n.alias("n")).collect()} == {i: measures(t)[4] for i, t in enumerate(texts)}


def test_a_filter_on_a_measure_ends(docs):
    few = quality.measured(docs.select("doc_id", "text")).select("doc_id", "n_repeat_words")
    few.agg(F.sum("n_repeat_words")).collect()
    took = []
    for df in (few, few.where("n_repeat_words > 3")):
        began = time.perf_counter()
        df.agg(F.sum("n_repeat_words")).collect()
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 5
