"""Language identification: held-out accuracy, and the chain against enumeration."""

import itertools
import math
import zlib

import numpy as np
import pytest

from fixturelake.llm import langid

SF = "/root/testdata/sf0.001"


def by_enumeration(scores, trans):
    """(log of the sum over all labellings, label probabilities of each word)."""
    m, total, want = trans.shape[0], 0.0, np.zeros_like(scores)
    for path in itertools.product(range(m), repeat=len(scores)):
        w = math.exp(sum(scores[t, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, k in enumerate(path):
            want[t, k] += w
    return math.log(total), want / total


def by_one_chain(scores, trans):
    """Label probabilities by forward-backward over the whole text in logs."""
    lse = lambda x, axis: np.log(np.exp(x - x.max()).sum(axis)) + x.max()
    a, b = np.zeros_like(scores), np.zeros_like(scores)
    a[0] = scores[0]
    for t in range(1, len(scores)):
        a[t] = lse(a[t - 1][:, None] + trans, 0) + scores[t]
    for t in range(len(scores) - 2, -1, -1):
        b[t] = lse(trans + (scores[t + 1] + b[t + 1])[None, :], 1)
    p = np.exp(a + b - (a + b).max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op7_langid(spark, SF).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_awkward_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.sample_texts(docs))
    odd = {r["doc_id"]: r for r in langid.predict(odd_docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (2, 3, 4, 11)) and odd[5]["lang_pred"] != "und"
    assert langid.predict(no_docs, model).count() == 0
    nobody = langid.train(langid.sample_texts(no_docs))
    assert nobody is None and {r["lang_pred"] for r in langid.predict(odd_docs, nobody).collect()} == {"und"}
    assert langid.keep_known_language(odd_docs).columns == odd_docs.columns
    numbers = ["\u00bd \u2460 \u00b2", "1 2 3", "\u0661", "_ _"]
    assert langid.label_texts(numbers, model)[0] == ["und"] * 4
    assert "und" not in langid.label_texts(["\u00bd a", "\u4e2d", "\u02b0"], model)[0]
    alike = spark.createDataFrame([(None, "same words here", "en")] * 50, "doc_id long, text string, lang string")
    assert len(langid.sample_texts(alike, rows=20)) == 20 and len(langid.sample_texts(alike, rows=20, chars=31)) == 2


@pytest.mark.parametrize("at_once", [langid.AT_ONCE, 3])
def test_stretches_equal_one_chain(monkeypatch, at_once):
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    m, sizes = 3, np.array([1, 4, 33, 2, 32, 31, 200, 65, 64])
    trans, words = rng.normal(size=(m, m)) * 2, rng.normal(size=(60, m)) * 4
    words[0] = 0
    rows = rng.integers(0, 60, sizes.sum())
    rows[0] = 5
    got = langid.label_shares(rows, sizes, langid.factors(words), trans)
    at = 0
    for share, n in zip(got, sizes, strict=True):
        mine = rows[at : at + n]
        p = by_one_chain(words[mine], trans)
        if n < 6:
            assert np.allclose(p, by_enumeration(words[mine], trans)[1])
        assert np.allclose(share, p[mine > 0].mean(0) if (mine > 0).any() else 0)
        at += n


def test_gradient_is_that_of_the_log_probability():
    rng = np.random.default_rng(3)
    scores, trans, gold = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))

    def log_probability(s, t):
        each = [sum(s[i, k, y] for k, y in enumerate(gold[i])) + sum(t[a, b] for a, b in zip(gold[i], gold[i][1:], strict=False)) - by_enumeration(s[i], t)[0] for i in range(2)]
        return sum(each)

    g_scores, g_trans = langid.gradient(scores, trans, gold)
    for x, g in ((scores, g_scores), (trans, g_trans)):
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            pair = [(y, trans) if x is scores else (scores, y) for y in (up, down)]
            assert (log_probability(*pair[0]) - log_probability(*pair[1])) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_features_by_hand():
    """Bucket sums of a batch equal those of each word alone, and grams never cross words."""
    words = ["a", "stra\u00dfe", "the", "na\u00efve", "x" * 40]
    f, at = langid.word_features(words, {"the": 2})
    for i, w in enumerate(words):
        alone, zero = langid.word_features([w], {"the": 2})
        assert sorted(f[at == i]) == sorted(alone) and not zero.any()
        n = len(w)
        want = 1 + max(0, n - 1) + max(0, n - 2) + min(n, 3) + min(n, 4) + sum(c > "\x7f" for c in w) + (w == "the")
        assert len(alone) == want


def test_long_text_of_two_languages():
    model = langid.train([("en", "the house and the garden of the king " * 40), ("fr", "la maison et le jardin du roi avec " * 40)])
    (name,), (score,) = langid.label_texts(["the house of the king and garden " * 20_000 + "la maison du roi " * 10_000], model)
    assert name == "en" and 0.6 < score < 0.9


def test_a_text_over_the_bound_empties_no_sample(spark):
    """A huge text is passed over wherever its hash stands; a rare language is in the sample."""
    rows = [(i, "the quick brown fox jumps", "en") for i in range(300)] + [(1000 + i, "x " * 4000, "en") for i in range(30)]
    rows += [(2000 + i, "der schnelle braune fuchs", "de") for i in range(4)] + [(3000, "y " * 5000, "fr"), (3001, "y " * 5000, "fr"), (3002, "y " * 5000, "fr"), (3003, "y " * 5000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_texts(docs, rows=90, chars=9000)
    count = {lang: sum(x == lang for x, _ in sample) for lang, _ in sample}
    assert count["en"] >= 15 and count["de"] >= 2 and count["fr"] == 1
    assert sum(len(t) for _, t in sample) <= 9000
    repeated = spark.createDataFrame([(None, "one two three", "en")] * 500 + [(None, "uno dos tres", "es")], "doc_id long, text string, lang string")
    assert sorted(langid.sample_texts(repeated)) == [("en", "one two three")] * 500 + [("es", "uno dos tres")]
