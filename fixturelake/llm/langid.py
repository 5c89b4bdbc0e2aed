"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's features are its
affixes, its character bigrams and trigrams, its letters outside ASCII, the word
itself and whether the lexicon of a language holds it; transitions between the
labels of neighbouring words are learned too, so a text that switches language
is labelled piece by piece. Forward-backward gives each word's label
probabilities; a text's language has the largest mean probability over its words
with a letter (Unicode category L), and that mean is the score.

Training: a bounded sample of labelled rows (at most ``SAMPLE_ROWS`` rows and
``SAMPLE_CHARS`` characters, in equal shares per language and by hash), each with
its whole text; a text that doesn't fit is passed over. Training sequences join stretches of different texts,
so that switches occur. The weights are fitted on the driver by AdaGrad; the
model has ``FEATURES`` x languages weights, whatever the corpus.

Scale: prediction is a narrow map over whole texts, without shuffle. Texts are
cut into stretches of ``STRETCH`` words that are worked on together: the product
of a stretch's transition and emission matrices carries the chain over it, so
the result is that of one chain over the whole text, and memory is bounded by
``AT_ONCE`` stretches besides the text itself and one small matrix per stretch.

Defined results: a null text and a text without a letter give ``und`` with
score 0, and so does every text if no labelled row exists; a null id counts as
the empty text in the fold; ties go to the alphabetically first language;
repeated rows give repeated results; columns of other names are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixturelake.llm.common import crc_bucket

FOLDS, HELD_OUT = 4, 2
#: Bounds of the training sample.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 6_000_000
FEATURES = 1 << 15
SEQUENCE, SWITCH_EACH, EPOCHS, BATCH, RATE = 96, 48, 3, 64, 0.3
LEXICON_WORDS = 300
#: Words of a stretch, and stretches worked on together.
STRETCH, AT_ONCE = 32, 8_192
#: Characters of texts split at a time, and different words remembered per worker.
CHARS_AT_ONCE, MOST_WORDS = 1_000_000, 150_000
#: Words between two rescalings of a product.
SCALE_EACH = 8
#: A text whose best language has a smaller share of its words is rejected as mixed.
LEAST_SHARE = 0.4
UNKNOWN = "und"
PUNCTUATION = ".,;:!?\"'()[]{}|"
_P = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def plain(word: str) -> str:
    return word.lower().strip(PUNCTUATION)


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    x = (code + np.uint64(kind)) * _P
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(FEATURES)).astype(np.int64)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(features, places): hashed features of plain words with a letter, and which word each belongs to."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max(initial=1)), _P))
    whole = np.add.reduceat(letters * power[np.arange(len(letters)) - start[owner]], start) if len(words) else letters
    found, places = [_bucket(whole, 1)], [np.arange(len(words))]

    def add(code: np.ndarray, at: np.ndarray, kind: int) -> None:
        found.append(_bucket(code, kind))
        places.append(at)

    grams = [letters]
    for n in (2, 3, 4):
        grams.append(grams[-1][: max(0, len(letters) - n + 1)] * _P + letters[n - 1 :])
    for n in (2, 3):
        at = np.arange(len(grams[n - 1]))
        at = at[owner[at] == owner[at + n - 1]]
        add(grams[n - 1][at], owner[at], 10 + n)
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(size >= n)
        if n < 4:
            add(grams[n - 1][start[long]], long, 20 + n)
        add(grams[n - 1][start[long] + size[long] - n], long, 30 + n)
    foreign = np.flatnonzero(letters > 127)
    add(letters[foreign], owner[foreign], 40)
    held = np.fromiter((lexicon.get(w, 0) for w in words), np.uint64, len(words))
    for i in range(int(held.max(initial=0)).bit_length()):
        inside = np.flatnonzero(held >> np.uint64(i) & np.uint64(1))
        add(np.full(len(inside), i, np.uint64), inside, 50)
    return np.concatenate(found), np.concatenate(places)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transition: np.ndarray  # from x to
    lexicon: dict[str, int]

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum of the weights of each plain word's features, per label."""
        f, at = word_features(words, self.lexicon)
        return np.stack([np.bincount(at, self.weights[f, j], len(words)) for j in range(len(self.labels))], 1)


class Emissions(dict):
    """Word to row of ``table``, which holds each word's factor per label; row 0 is for words without a letter."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.waiting, self.filled = model, [], 1
        self.table = np.ones((1 << 12, len(model.labels)))

    def __missing__(self, word: str) -> int:
        row, bare = 0, plain(word)
        if bare.isalpha() or has_letter(bare):
            row = self.filled + len(self.waiting)
            self.waiting.append(bare)
        self[word] = row
        return row

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the words; they hold until the next call."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.filled = 1
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        end = self.filled + len(self.waiting)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.ones((end, len(self.model.labels)))])
        for low in range(0, len(self.waiting), 20_000):
            part = self.waiting[low : low + 20_000]
            self.table[self.filled : self.filled + len(part)] = factors(self.model.scores(part))
            self.filled += len(part)
        self.waiting = []
        return out


def factors(scores: np.ndarray) -> np.ndarray:
    """Positive factors of log scores; the largest of a word is 1."""
    return np.exp(np.maximum(scores - scores.max(-1, keepdims=True), -60.0))


def _stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the stretches of texts that lie one behind the other."""
    n = -(-sizes // STRETCH)
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.repeat(np.cumsum(sizes) - sizes, n) + number * STRETCH, np.minimum(STRETCH, sizes[text] - number * STRETCH)


def label_shares(rows: np.ndarray, sizes: np.ndarray, table: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Mean label probabilities of each text over its words with a letter (row over 0); sizes: words per text, over 0."""
    m = table.shape[1]
    step = np.exp(transition - transition.max())
    back = np.ascontiguousarray(step.T)
    text, start, length = _stretches(sizes)
    first = np.concatenate([[True], text[1:] != text[:-1]])
    # The longest stretches of a part come first, so that those with a word at t are a prefix.
    parts = [low + np.argsort(-length[low : low + AT_ONCE], kind="stable") for low in range(0, len(text), AT_ONCE)]

    def words_of(part: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        live = np.searchsorted(-length[part], -np.arange(STRETCH), side="left")
        for t in range(int(length[part[0]])):
            yield t, int(live[t]), rows[start[part[: live[t]]] + t]

    product = np.empty((len(text), m, m))
    for part in parts:
        now = np.where(first[part][:, None, None], np.eye(m), step)
        for t, k, row in words_of(part):
            now[:k] = (now[:k] if t == 0 else now[:k] @ step) * table[row][:, None, :]
            if t % SCALE_EACH == SCALE_EACH - 1:
                now[:k] /= now[:k].max((1, 2), keepdims=True)
        product[part] = now / now.max((1, 2), keepdims=True)

    # Forward and backward over the stretches of each text, all texts together.
    n = np.bincount(text, minlength=len(sizes))
    begin = np.cumsum(n) - n
    most_first = np.argsort(-n, kind="stable")
    live = np.searchsorted(-n[most_first], -np.arange(int(n.max())), side="left")
    before, after = np.ones((len(text), m)), np.ones((len(text), m))
    for t in range(1, len(live)):
        at = begin[most_first[: live[t]]] + t
        a = (before[at - 1, None, :] @ product[at - 1])[:, 0]
        before[at] = a / a.sum(1, keepdims=True)
    for t in range(len(live) - 2, -1, -1):
        at = begin[most_first[: live[t + 1]]] + t
        b = (product[at + 1] @ after[at + 1, :, None])[:, :, 0]
        after[at] = b / b.sum(1, keepdims=True)

    total, counted = np.zeros((len(text), m)), np.zeros(len(text))
    for part in parts:
        seen = []
        a = before[part]
        for t, k, row in words_of(part):
            enter = a[:k] @ step
            if t == 0:
                enter = np.where(first[part][:, None], 1.0, enter)
            a = enter * table[row]
            if t % SCALE_EACH == SCALE_EACH - 1:
                a /= a.sum(1, keepdims=True)
            seen.append((k, row, a))
        b, mine, words = after[part], np.zeros((len(part), m)), np.zeros(len(part))
        for t in range(len(seen) - 1, -1, -1):
            k, row, a = seen[t]
            p = a * b[:k]
            lettered = row > 0
            mine[:k] += p * (lettered / p.sum(1))[:, None]
            words[:k] += lettered
            b[:k] = (b[:k] * table[row]) @ back
            if t % SCALE_EACH == 0:
                b[:k] /= b[:k].sum(1, keepdims=True)
        total[part], counted[part] = mine, words
    shares = np.stack([np.bincount(text, total[:, j], len(sizes)) for j in range(m)], 1)
    return shares / np.maximum(np.bincount(text, counted, len(sizes)), 1)[:, None]


def fitting(listed: list[tuple[int, int, int]], rows: int, chars: int) -> dict[int, int]:
    """How often each text of (hash, size, copies) is taken, in hash order, while rows and room last; one that doesn't fit is passed over."""
    out = {}
    for h, n, copies in sorted(listed):
        times = min(copies, rows, chars // n if n else copies)
        if times:
            out[h] = times
            rows, chars = rows - times, chars - n * times
    return out


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, text) of a bounded number of labelled rows outside the held-out fold, in hash order.

    Every language has an equal share of the rows and of the characters, so a rare one is learned too. Texts that don't
    fit what is left of a share are passed over; if none of a language's listed texts fits, a stretch of the shortest
    one is taken. Repeated rows are read once and count as often as they occur.
    """
    fold = crc_bucket(F.col("doc_id"), FOLDS)
    usable = docs.where((fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = F.length("text")
    # The text itself only tells rows without an id apart.
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("lang"), size, F.when(F.col("doc_id").isNull(), F.col("text")))
    keyed = usable.select("lang", h.alias("h"), size.alias("n"))
    # One row per language, the labels of the model.
    languages = [r["lang"] for r in keyed.select("lang").distinct().collect()]
    if not languages:
        return []
    each, room = max(1, rows // len(languages)), max(1, chars // len(languages))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    # At most ``rows`` rows, or one per language.
    listed: dict[str, list[tuple[int, int, int]]] = {}
    for r in keyed.groupBy("lang", "h").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).withColumn("rn", first).where(F.col("rn") <= each).collect():
        listed.setdefault(r["lang"], []).append((r["h"], r["n"], r["c"]))
    times = {(lang, h): n for lang, found in listed.items() for h, n in (fitting(found, each, room) or {min(found, key=lambda x: (x[1], x[0]))[0]: 1}).items()}
    asked = docs.sparkSession.createDataFrame([(lang, x, room) for lang, x in times], "lang string, h long, room long")
    texts = usable.select("lang", h.alias("h"), "text").join(F.broadcast(asked), ["lang", "h"])
    start = F.pmod("h", F.greatest(F.length("text") - F.col("room"), F.lit(0)) + 1).cast("int") + 1
    stretch = F.when(F.length("text") > F.col("room"), F.substr("text", start, F.col("room").cast("int"))).otherwise(F.col("text"))
    got = texts.select("lang", "h", stretch.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["h"], r["lang"])) for _ in range(times[r["lang"], r["h"]])]


def build_lexicon(sample: list[tuple[str, list[str]]], labels: list[str]) -> dict[str, int]:
    """Frequent words of each language, as bits."""
    counts = {x: Counter() for x in labels}
    for lang, words in sample:
        counts[lang].update(set(words))
    out: dict[str, int] = {}
    for i, lang in enumerate(labels):
        for w, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            if n > 2 and w:
                out[w] = out.get(w, 0) | 1 << i
    return out


def train(sample: list[tuple[str, str]], seed: int = 7) -> Crf | None:
    """Fit on sequences that join stretches of different texts."""
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return None
    split = [(lang, [plain(w) for w in text.split()]) for lang, text in sample]
    lexicon = build_lexicon(split, labels)
    number: dict[str, int] = {}
    pieces = [
        (labels.index(lang), [number.setdefault(w, len(number)) for w in words[low : low + SWITCH_EACH]])
        for lang, words in split
        for low in range(0, len(words), SWITCH_EACH)
    ]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pieces))
    tokens = np.array([w for i in order for w in pieces[i][1]], np.int64)
    gold = np.array([pieces[i][0] for i in order for _ in pieces[i][1]], np.int64)
    m = len(labels)
    weights, trans = np.zeros((FEATURES, m)), np.zeros((m, m))
    if not len(tokens):
        return Crf(labels, weights, trans, lexicon)
    if len(tokens) < SEQUENCE:
        times = -(-SEQUENCE // len(tokens))
        tokens, gold = np.tile(tokens, times), np.tile(gold, times)
    n = len(tokens) // SEQUENCE
    tokens, gold = tokens[: n * SEQUENCE].reshape(n, SEQUENCE), gold[: n * SEQUENCE].reshape(n, SEQUENCE)
    usable = [w for w in number if has_letter(w)]
    f, at = word_features(usable, lexicon)
    at = np.fromiter((number[w] for w in usable), np.int64, len(usable))[at]
    by_word = np.argsort(at, kind="stable")
    f, at = f[by_word], at[by_word]
    place = np.searchsorted(at, np.arange(len(number) + 1))
    w2, t2 = np.full((FEATURES, m), 1e-2), np.full((m, m), 1e-2)
    for _ in range(EPOCHS):
        for low in range(0, n, BATCH):
            x, y = tokens[low : low + BATCH], gold[low : low + BATCH]
            words, where = np.unique(x, return_inverse=True)
            size = place[words + 1] - place[words]
            owner = np.repeat(np.arange(len(words)), size)
            flat = f[np.repeat(place[words] - np.cumsum(size) + size, size) + np.arange(len(owner))]
            scores = np.stack([np.bincount(owner, weights[flat, j], len(words)) for j in range(m)], 1)
            g_words, g_trans = gradient(scores[where.reshape(x.shape)], trans, y)
            g_words = np.stack([np.bincount(where.ravel(), g_words[:, :, j].ravel(), len(words)) for j in range(m)], 1)
            step = np.stack([np.bincount(flat, g_words[owner, j], FEATURES) for j in range(m)], 1) / len(y)
            w2 += step**2
            weights += RATE * step / np.sqrt(w2)
            step = g_trans / len(y)
            t2 += step**2
            trans += RATE * step / np.sqrt(t2)
    return Crf(labels, weights, trans, lexicon)


def gradient(scores: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log probability of the gold labels (n, time) by the words' scores and by the transitions."""
    n, length, m = scores.shape
    emit, step = factors(scores), np.exp(trans)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * emit[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (emit[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * step * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    seen = np.zeros((m, m))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return np.eye(m)[gold] - p, seen - pair.sum((0, 1))


def label_texts(texts: list, model: Crf | None, known: Emissions | None = None) -> tuple[list[str], list[float]]:
    """Language and score of whole texts."""
    names, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, shares
    known = known if known is not None else Emissions(model)
    places, words, sizes = [], [], []

    def flush() -> None:
        rows = known.rows(words)
        for i, share in zip(places, label_shares(rows, np.array(sizes, np.int64), known.table, model.transition), strict=True):
            best = int(share.argmax())
            names[i], shares[i] = model.labels[best], float(min(1.0, share[best]))
        for held in (places, words, sizes):
            held.clear()

    room = CHARS_AT_ONCE
    for i, text in enumerate(texts):
        if text and has_letter(text):
            each = text.split()
            places.append(i)
            words.extend(each)
            sizes.append(len(each))
            room -= len(text)
            if room < 0:
                flush()
                room = CHARS_AT_ONCE
    if places:
        flush()
    return names, shares


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """All columns of docs, and lang_pred and score; columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    place = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = None if model is None else Emissions(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                names, scores = label_texts(part.column(place).to_pylist(), model, known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def keep_known_language(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The documents with one language of at least the given share, with the columns of docs."""
    model = train(sample_texts(docs))
    found = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(sample_texts(docs))
    fold = crc_bucket(F.col("doc_id"), FOLDS)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", "score")
