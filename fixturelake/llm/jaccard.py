"""N-gram Jaccard join by MinHash banding.

Documents are sets of hashed five-word shingles; two documents are linked if
their sets have a Jaccard similarity of 0.8 or more. The numbers of bands and
rows are chosen so that a pair at the threshold meets in some band with the
target recall. Band hashes are shuffled; pairs that share a bucket are verified
on their full shingle sets, block against block, as counts and spanning edges:
pairs are never emitted.

Documents with the same set (128 bits of its hash) are one class, represented
once and counted with their number, so groups of copies cost nothing beyond one
row each.

Candidates. The members of a bucket are tied to its smallest member, and these to
the least one of the class's buckets, which gives components of classes that may
be linked. A component is compared as a whole if
that takes no more work than its buckets one by one: near copies share most of
their buckets, while documents that are merely tied by chains share few. Where
buckets are compared, a pair counts in the first band that it shares only.

Scale: what is compared is dealt at random to blocks of at most about
``BLOCK_SHINGLES`` shingles and ``BLOCK_ROWS`` classes; a task compares two
blocks, so no task grows with its group. The work inside a group of near copies
is quadratic in its distinct sets, which is inherent in exact link counts. Small
sides of joins are stored first, so that the engine can split hot keys.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words
is one shingle of all its words; a text without a word (or null) links with
nothing and stays; a null id is ignored in the smallest id of a group unless
all are null; repeated rows are copies of each other; columns of other names
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixturelake.llm.common import materialise, parts_by_size
from fixturelake.llm.components import connected_components

NGRAM, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 8
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 256
#: Fetching a set counts as much as so many comparisons.
FETCH_COST = 64
#: Texts worked on together, and their bytes.
TEXTS, TEXT_BYTES = 1_000, 8_000_000
_TILE, _COLUMNS = 256, 8_192
_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows at which a pair of just the threshold is found with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    import xxhash

    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _P + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out))


def class_of(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """128-bit identity of a set as two numbers; None for the empty set."""
    import xxhash

    if not len(shingles):
        return None, None
    high, low = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes(), seed=1), np.int64)
    return int(high), int(low)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """(len(sets), bands) hashes of the MinHash bands; all sets non-empty."""
    rng = np.random.default_rng(20_240_607)
    a = rng.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1)
    c = rng.integers(0, 2**32, bands * rows, np.uint32)
    out = np.zeros((len(sets), bands), np.uint64)
    low = 0
    while low < len(sets):
        high, size = low, 0
        while high < len(sets) and (size == 0 or size + len(sets[high]) <= 60_000):
            size += len(sets[high])
            high += 1
        x = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[low : high - 1]])]).astype(np.int64)
        for k in range(bands):
            h = np.full(high - low, k + 1, np.uint64)
            for j in range(k * rows, (k + 1) * rows):
                h = h * _P + np.minimum.reduceat((x ^ c[j]) * a[j], starts)
            out[low:high, k] = _mix(h)
        low = high
    return out


def features(docs: DataFrame, bands: int) -> DataFrame:
    """docs (doc_id, text and any others) with row (a number), cls, alt (the class), shingles (number) and bands of every row."""
    place, names = docs.columns.index("text"), [*docs.columns, "cls", "alt", "shingles", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_size(batch, place, TEXTS, TEXT_BYTES):
                sets = [shingle_set(t) for t in part.column(place).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                found: list = [None] * len(sets)
                for i, row in zip(full, band_hashes([sets[i] for i in full], bands), strict=True):
                    found[i] = row.view(np.int64)
                both = [class_of(s) for s in sets]
                made = [pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)] + [pa.array([len(s) for s in sets], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    kinds = (T.LongType(), T.LongType(), T.IntegerType(), T.ArrayType(T.LongType()))
    added = [T.StructField(n, k) for n, k in zip(("cls", "alt", "shingles", "bands"), kinds, strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added])).withColumn("row", F.monotonically_increasing_id())


def ties(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what members (id, low) connects: a class and its buckets' smallest members, all tied to the least of them.

    A class has at most one bucket per band. The buckets of a group of near copies share few smallest members, so what
    is left is about one edge per class instead of one per class and band.
    """
    lows = members.groupBy("id").agg(F.collect_set("low").alias("lows"))
    tied = lows.select(F.array_min("lows").alias("b"), F.explode(F.array_union("lows", F.array("id"))).alias("a"))
    return tied.where(F.col("a") != F.col("b")).select("a", "b").distinct()


def candidate_groups(banded: DataFrame) -> DataFrame:
    """(id, band, grp): the groups in which classes are compared; band is -1 for a whole component. banded: id and bands of each class."""
    hashed = banded.select("id", F.posexplode("bands").alias("band", "h"))
    shared = hashed.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
    shared = materialise(shared, "buckets")
    members = materialise(hashed.join(shared, ["band", "h"]).select("id", "band", "h", "low"), "members")
    labels = connected_components(ties(members))
    work = lambda n: n * n + FETCH_COST * n
    as_whole = labels.groupBy("component").agg(work(F.count(F.lit(1))).alias("whole"))
    by_bucket = shared.join(labels.withColumnRenamed("id", "low"), "low").groupBy("component").agg(F.sum(work(F.col("n"))).alias("single"))
    split = materialise(as_whole.join(by_bucket, "component").where("single < whole").select("component"), "split-components")
    whole = labels.join(split, "component", "left_anti").select("id", F.lit(-1).alias("band"), F.col("component").alias("grp"))
    single = members.join(labels.join(split, "component", "left_semi"), "id").select("id", "band", F.col("h").alias("grp"))
    return whole.unionByName(single)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a's with b's sets."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    words = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(words):
        return out
    places = []
    for sets, flat in ((a, flat_a), (b, flat_b)):
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        held = words[at] == flat
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        places.append((owner[held], at[held]))
    for low in range(0, len(words), _COLUMNS):
        dense = []
        for (owner, at), sets in zip(places, (a, b), strict=True):
            here = (at >= low) & (at < low + _COLUMNS)
            m = np.zeros((len(sets), min(_COLUMNS, len(words) - low)), np.float32)
            m[owner[here], at[here] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs with Jaccard similarity of at least 0.8; same: a and b are one list, each pair once."""
    order_a, order_b = np.argsort([len(s) for s in a], kind="stable"), np.argsort([len(s) for s in b], kind="stable")
    size_a, size_b = np.array([len(a[i]) for i in order_a]), np.array([len(b[i]) for i in order_b])
    left, right = [], []
    for i in range(0, len(a), _TILE):
        for j in range(i if same else 0, len(b), _TILE):
            sa, sb = size_a[i : i + _TILE], size_b[j : j + _TILE]
            if 5 * sa[-1] < 4 * sb[0] or 5 * sb[-1] < 4 * sa[0]:
                continue
            common = _overlaps([a[k] for k in order_a[i : i + _TILE]], [b[k] for k in order_b[j : j + _TILE]])
            x, y = np.nonzero(9 * common >= 4 * (sa[:, None] + sb[None, :]))
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            left.append(order_a[x])
            right.append(order_b[y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges x-y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(rows: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, other, n): n documents linked with a class of a group, and edges id-other that span the links.

    rows: row, text and bands of every row; classes: id (the row of one member), size, shingles; groups: id, band, grp.
    """
    members = materialise(groups.join(classes.select("id", "size", "shingles"), "id"), "compared")
    room = members.groupBy("band", "grp").agg(
        F.ceil(F.greatest(F.sum("shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks")
    )
    members = members.join(materialise(room, "rooms"), ["band", "grp"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Stored, so that Spark knows whether these are few, before it moves the texts.
    asked = materialise(members.select(F.col("id").alias("row")).distinct(), "asked-texts")
    texts = rows.join(asked, "row", "left_semi").select("row", "text", "bands")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_size(batch, 1, TEXTS, TEXT_BYTES):
                words = pa.array([shingle_set(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                bands = pa.array([np.array(b, np.int64).tobytes() for b in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), words, bands], names=["id", "words", "bands"])

    found = texts.mapInArrow(sets, "id long, words binary, bands binary")
    dealt = members.join(found, "id").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    bands = F.when(F.col("band") > 0, F.col("bands")).otherwise(F.lit(b"")).alias("bands")
    dealt = dealt.select("band", "grp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "size", "words", bands)

    def compare(table: pa.Table) -> pa.Table:
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        ids, block, size = (table.column(c).to_numpy() for c in ("id", "block", "size"))
        words = [np.frombuffer(w.as_py(), np.uint64) for w in table.column("words")]
        in_a, in_b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x, y = linked_pairs([words[k] for k in in_a], [words[k] for k in in_b], i == j)
        x, y = in_a[x], in_b[y]
        if band > 0:
            held = np.frombuffer(b"".join(b.as_py() for b in table.column("bands")), np.int64).reshape(len(ids), -1)[:, :band]
            first = ~(held[x] == held[y]).any(1)
            x, y = x[first], y[first]
        n = np.bincount(x, weights=size[y], minlength=len(ids)) + np.bincount(y, weights=size[x], minlength=len(ids))
        root = spanning(len(ids), x, y)
        keep = n > 0
        return pa.table({"id": ids[keep], "other": ids[root][keep], "n": n[keep].astype(np.int64)})

    return dealt.groupBy("band", "grp", "i", "j").applyInArrow(compare, "id long, other long, n long")


def jaccard_classes(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ``features`` of docs, and per class cls, alt, first, n_links, component (a number) and lowest.

    first and lowest are (without an id, doc_id, row) of the row of smallest id in the class and in its component.
    """
    rows = materialise(features(docs, bands_for(recall=recall)), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("first")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls", "alt").agg(first, F.count(F.lit(1)).alias("size"), F.max("shingles").alias("shingles"))
    classes = materialise(classes.withColumn("id", F.col("first.row")), "classes")
    banded = rows.select(F.col("row").alias("id"), "bands").join(classes.select("id"), "id", "left_semi")
    links = materialise(verified(rows.select("row", "text", "bands"), classes, candidate_groups(banded)), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    joined = connected_components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = classes.join(counts, "id", "left").join(joined, "id", "left")
    out = materialise(out.select("cls", "alt", "first", F.coalesce("component", "id").alias("component"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "linked")
    low = materialise(out.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    return rows, materialise(out.join(low, "component"), "grouped")


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of equal sets), n_links, component_id and kept."""
    rows, classes = jaccard_classes(docs.select("doc_id", "text"), recall)
    out = rows.select("doc_id", "cls", "alt").join(classes, ["cls", "alt"], "left")
    own = lambda c: F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col(c))
    return out.select(
        "doc_id",
        own("first.doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own("lowest.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(own("lowest.doc_id")).alias("kept"),
    )


def keep_one_of_each_group(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """docs without near copies: of each component one row stays, one of the smallest id; rows without words stay."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    source = docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("others"))
    rows, classes = jaccard_classes(source, recall)
    keepers = classes.select(F.col("lowest.row").alias("row")).distinct()
    # What goes is less than what stays; stored, so that Spark knows whether it is little before it moves whole rows.
    gone = materialise(rows.where(F.col("cls").isNotNull()).select("row").join(keepers, "row", "left_anti"), "gone")
    kept = rows.join(gone, "row", "left_anti")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"others.`{c}`") for c in docs.columns])


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all documents."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
