"""Quality rules: hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Word unigrams and bigrams of every distinct text are hashed to a fixed number
of buckets and counted: the target from texts with a trusted label, the raw
corpus from all. With t of T target and r of R raw n-grams in a bucket its
ratio is (t + PRIOR) / (T r / R + PRIOR), so a bucket without evidence gives
about 1. A document's score is the mean over its n-grams of ln(ratio). It is
kept if the score reaches the threshold and no base rule fails.

Every text is scored held out: texts fall into ``FOLDS`` by hash, equal ones
into the same, and a text's ratios come from the counts of the other folds. The
threshold is set by the scores of all trusted texts that pass the base rules: as
far below their first percentile as that lies below their median.

Scale: texts that occur more than once are found by hash and each copy counts
with one over their number, so a group of copies weighs as much as one text;
the sums are rounded to the whole numbers that they stand for. Counting
explodes n-grams inside the scan's stage and shuffles one row per bucket, fold
and task; texts move once, to meet their marks (copies, trusted). Scoring looks
ratios up in one array of ``FOLDS`` x ``buckets`` doubles, with no shuffle. All
trusted ids and texts count. Documents are scored once and stored; the threshold's two
scores are found by counts over ever narrower ranges (``values_at``).

Defined results: a null or blank text has no words, score 0 and fails the base
rule on word count; repeated rows get equal results; without trusted documents
every score is 0 and the threshold ``THRESHOLD``; columns of other names are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import let, materialise, words_of

BUCKETS = 16_384
FOLDS = 4
#: Target n-grams that a bucket is given at ratio 1.
PRIOR = 5.0
#: Ranges of scores that are counted at once.
RANGES = 4_096
#: Used if no trusted text sets one.
THRESHOLD = -0.045
#: Bits of a window's hash that are compared before its words are.
WINDOW_BITS = 64


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _features(hashes: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams."""
    single = F.transform(hashes, lambda h: _bucket(h, buckets))
    double = F.transform(hashes, lambda h, i: F.when(i > 0, _bucket(F.xxhash64(F.get(hashes, i - 1), h), buckets)))
    return F.concat(single, F.slice(double, 2, F.greatest(F.size(hashes) - 1, F.lit(0))))


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(FOLDS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled as good quality."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Hashes (h) of the texts of all trusted documents, stored."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h")).join(materialise(trusted_ids(labels), "trusted-ids"), "doc_id")
    return materialise(rows.select("h").distinct(), "trusted-texts")


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> tuple[list[list[int]], list[list[int]]]:
    """(target, raw) counts of each fold's buckets over distinct texts; at most FOLDS x ``buckets`` rows reach the driver."""
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    copies = texts.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # One table and one merge join at any size: texts move once, and nothing that grows with the labels is broadcast.
    marks = materialise(copies.join(trusted.withColumn("trusted", F.lit(1)), "h", "full_outer"), "text-marks")
    marked = texts.join(marks.hint("merge"), "h", "left").select(
        (1 / F.coalesce("copies", F.lit(1))).alias("part"), "trusted", fold_of(F.col("text")).alias("fold"),
        let(_hashes(words_of(F.col("text"))), lambda h: _features(h, buckets)).alias("grams"),
    )
    counted = (
        marked.select("fold", "part", (F.col("part") * F.coalesce("trusted", F.lit(0))).alias("own"), F.explode("grams").alias("b"))
        .groupBy("fold", "b")
        .agg(F.sum("part").alias("raw"), F.sum("own").alias("target"))
    )
    raw, target = [[0] * buckets for _ in range(FOLDS)], [[0] * buckets for _ in range(FOLDS)]
    for row in counted.collect():
        raw[row["fold"]][row["b"]], target[row["fold"]][row["b"]] = round(row["raw"]), round(row["target"])
    return target, raw


def log_ratios(target: list[list[int]], raw: list[list[int]], prior: float = PRIOR) -> list[list[float]]:
    """ln(ratio) of each bucket for the texts of each fold, by the counts of the other folds."""
    out = []
    for k in range(len(raw)):
        t, r = ([sum(x) for x in zip(*(c for i, c in enumerate(counts) if i != k), strict=True)] for counts in (target, raw))
        share = sum(t) / max(sum(r), 1)
        out.append([round(math.log((a + prior) / (share * b + prior)), 6) for a, b in zip(t, r, strict=True)])
    return out


def ratio_table(spark: SparkSession, ratios: list[list[float]]) -> DataFrame:
    """One stored row with the ratios of all folds, one fold's behind the other's."""
    return materialise(spark.createDataFrame([([x for fold in ratios for x in fold],)], "ratios array<double>"), "ratios")


def repeat_words(words: Column, hashes: Column, bits: int = WINDOW_BITS) -> Column:
    """Words in three-word windows that occur twice or more in the text.

    A window's hash and position share one long, so that one sort brings windows
    of equal hash together; of those the words themselves are compared, so the
    count is exact whatever the hash.
    """
    keys = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.shiftright(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)), 64 - bits) if bits < 64 else F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )
    place = F.length(F.bin(F.size(hashes))).cast("int")

    def neighbours(sorted_keys: Column, own: Column, i: Column, by) -> Column:
        same = lambda at: F.coalesce(by(F.get(sorted_keys, at)) == by(own), F.lit(False))
        return same(i - 1) | same(i + 1)

    def alike(keys: Column, place: Column) -> Column:
        """Positions of the windows whose hash has an equal one."""
        high = lambda k: F.call_function("shiftright", k, place)
        packed = F.sort_array(F.transform(keys, lambda k, i: F.call_function("shiftleft", high(k), place).bitwiseOR(i.cast("long"))))
        low = lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place) - 1)
        return let(packed, lambda s: F.transform(F.filter(F.transform(s, lambda k, i: F.when(neighbours(s, k, i, high), low(k))), lambda p: p.isNotNull()), lambda p: p.cast("int")))

    def equal(found: Column) -> Column:
        """Of these positions those whose words are equal to another's, in order."""
        window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
        named = F.sort_array(F.transform(found, lambda p: F.struct(window(p).alias("g"), p.alias("p"))))
        kept = lambda s: F.filter(F.transform(s, lambda x, i: F.when(neighbours(s, x, i, lambda y: y["g"]), x["p"])), lambda p: p.isNotNull())
        return F.sort_array(let(named, kept))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    whole = lambda k: let(place, lambda b: let(equal(alike(k, b)), covered))
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(whole(k)))


def _with_ratios(docs: DataFrame, ratios: list[list[float]] | None) -> DataFrame:
    """docs with the table of ratios as a column: one row read as a scalar subquery, so no plan holds a long literal."""
    return docs if ratios is None else docs.withColumn("_ratios", ratio_table(docs.sparkSession, ratios).scalar())


def _of_words(buckets: int | None) -> Column:
    """n_words, word_chars, n_repeat_words and, with buckets, score of the column text as one struct, in which each array is computed once."""
    long = lambda c, name: c.cast("long").alias(name)
    fields = [
        lambda w, h: long(F.size(w), "n_words"),
        lambda w, h: long(F.length(F.array_join(w, "")), "word_chars"),
        lambda w, h: repeat_words(w, h).alias("n_repeat_words"),
    ]
    if buckets is not None:

        def score(h: Column, table: Column) -> Column:
            one = lambda x, i, at: F.get(table, at + _bucket(x, buckets)) + F.when(
                i > 0, F.get(table, at + _bucket(F.xxhash64(F.get(h, i - 1), x), buckets))
            ).otherwise(0.0)
            total = let(fold_of(F.col("text")) * buckets, lambda at: F.aggregate(F.transform(h, lambda x, i: one(x, i, at)), F.lit(0.0), lambda a, x: a + x))
            return F.coalesce(total / F.nullif(2 * F.size(h) - 1, F.lit(-1)), F.lit(0.0))

        fields.append(lambda w, h: let(F.col("_ratios"), lambda t: score(h, t)).alias("score"))
    return let(words_of(F.col("text")), lambda w: let(_hashes(w), lambda h: F.struct(*[f(w, h) for f in fields])))


def _failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def measured(docs: DataFrame, ratios: list[list[float]] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs, and score if ratios are given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    more = F.struct(
        (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines")
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "_ratios")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    out = _with_ratios(docs.select(*kept), ratios).select(*kept, _of_words(None if ratios is None else len(ratios[0])).alias("_m"), more.alias("_n"))
    return out.select("*", "_m.*", "_n.*", _failed(F.col("_m")).alias("base_failed")).drop("_m", "_n")


def values_at(scores: DataFrame, places: list[int]) -> list[float]:
    """The values at these places (from 0) of the sorted column ``score``, exactly; at most RANGES rows reach the driver at a time."""
    first = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    out = []
    for place in places:
        low, high, rows = first["low"], first["high"], scores
        # The least and the greatest value are in different ranges, so each step leaves fewer values.
        while low < high:
            at = F.least(F.floor((F.col("score") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
            counted = rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
            for r in sorted(counted, key=lambda r: r["at"]):
                if place < r["n"]:
                    low, high = r["low"], r["high"]
                    break
                place -= r["n"]
            rows = scores.where(F.col("score").between(low, high))
        out.append(low)
    return out


def held_out_threshold(scored: DataFrame, trusted: DataFrame) -> float:
    """The threshold that the held-out scores of all trusted texts give; scored: h and score of stored rows, no score where a base rule fails."""
    scores = scored.where(F.col("score").isNotNull()).select("h", "score").join(trusted, "h").distinct()
    scores = materialise(scores.select("score"), "trusted-scores")
    n = scores.count()
    return between(*values_at(scores, [n // 100, n // 2])) if n else THRESHOLD


def between(low: float, middle: float) -> float:
    return low - (middle - low)


def threshold_of(scores: list[float]) -> float:
    """The same of a list."""
    found = sorted(scores)
    return between(found[len(found) // 100], found[len(found) // 2]) if found else THRESHOLD


def rule(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[list[list[float]], DataFrame]:
    """(ratios, trusted texts) learned from documents and labels."""
    trusted = trusted_texts(docs, labels)
    return log_ratios(*bucket_counts(docs, trusted, buckets)), trusted


def quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None, **options) -> DataFrame:
    """One row per document: doc_id, the base measures, score, base_failed and kept; options as of ``rule``."""
    ratios, trusted = rule(docs, labels, **options)
    out = materialise(measured(docs.select("doc_id", "text"), ratios).withColumn("h", F.xxhash64("text")).drop("text"), "scored")
    if threshold is None:
        threshold = held_out_threshold(out.select("h", F.when(~F.col("base_failed"), F.col("score")).alias("score")), trusted)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("h")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = None, **options) -> DataFrame:
    """The documents that pass, with the columns of docs, row for row; they are stored with their scores, so each is scored once."""
    ratios, trusted = rule(docs, labels, **options)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    score = let(_of_words(len(ratios[0])), lambda m: F.when(~_failed(m), m["score"]))
    out = materialise(_with_ratios(source, ratios).select("row", F.xxhash64("text").alias("h"), score.alias("score")), "scored")
    if threshold is None:
        threshold = held_out_threshold(out, trusted)
    return out.where(F.col("score") >= threshold).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
