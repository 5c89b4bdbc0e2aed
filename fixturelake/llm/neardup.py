"""Embedding near-duplicates by product quantisation.

Distinct vectors are scaled to length one and assigned to the nearest of a few
coarse centroids; what remains after subtracting it is cut into subspaces, each
coded by its nearest codeword. A vector searches the inverted lists that can
hold a partner. Its distances to a list's codes come from lookup tables of the
exact vector's products with all codewords (asymmetric distances), and pairs
that pass are reranked by exact cosine in double precision.

Sufficient probes: partners of cosine s or more lie within t = sqrt(2 - 2s).
A list is probed unless the plane between its centroid and the vector's own is
more than t away, or the list's radius excludes it, so no pair is missed. A
code's distance may be wrong by the stored length of its coding error, so a pair
passes the tables if its distance is at most t plus that error: no pair of a
probed list is lost, whatever the quality of the codes.

Scale: equal vectors are one class, counted once. Centroids and codewords are
trained on a bounded sample (``SAMPLE`` vectors of smallest hash); every vector
is indexed, those of each length by themselves. Neighbouring lists form cells of
about ``BLOCK`` vectors. A cell's vectors are dealt to blocks of ``BLOCK``, one
row each, with the cells in which any of them probes a list. Blocks meet in a
product of partitions of ``TOGETHER`` blocks, of which only pairs that probe are
compared; so a vector is never copied per cell, what is shuffled and stored stays
in proportion to the vectors even if nothing can be pruned, and a list with a
third of all vectors spreads over many tasks. Each pair of lists is compared in
one direction. Tasks return link counts and spanning edges, never pairs. There
are ``MOST_LISTS`` lists at most, so beyond some ten million vectors the work
inside a list grows with the square of its vectors. Where vectors have no cluster
structure, the comparisons, but not the disk, grow with the square of all.

Vectors are equal if their 128-bit hashes are; so only the tables of the index
hold vectors, and they are deleted when the links are found.

Defined results: a vector that is null, all zero, or holds null, NaN or
infinite components links with nothing else, nor do vectors of different
lengths; repeated rows count as separate vectors; a null vec_id is never
the smallest unless all are; columns of other names are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import discard, materialise
from fixturelake.llm.components import connected_components
from fixturelake.llm.jaccard import spanning

COSINE = 0.95
SAMPLE, MOST_LISTS, SUBSPACES, CODEWORDS, TRAIN_ROUNDS = 20_000, 2_048, 8, 256, 8
BLOCK = 2_048
#: Blocks of a partition, and partitions at least, as far as there are blocks.
TOGETHER, SPREAD = 16, 8
#: Vectors compared with all centroids at a time.
PART = 1_024
_SLACK = 1e-6


@dataclass
class Index:
    """Coarse centroids, codewords of each subspace and the subspaces' cuts."""

    centroids: np.ndarray
    codewords: list[np.ndarray]
    cuts: np.ndarray

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of all centroids; worked out once per worker."""
        return distances(self.centroids, self.centroids)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error, distances to all centroids) of unit vectors."""
        far = distances(x, self.centroids)
        home = far.argmin(1)
        rest = x - self.centroids[home]
        codes = np.empty((len(x), len(self.codewords)), np.uint8)
        back = np.empty_like(rest)
        for m, words in enumerate(self.codewords):
            low, high = self.cuts[m], self.cuts[m + 1]
            codes[:, m] = distances(rest[:, low:high], words).argmin(1)
            back[:, low:high] = words[codes[:, m]]
        return home, codes, np.linalg.norm(rest - back, axis=1), far


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(squared, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each vector, a part of the vectors at a time."""
    return np.concatenate([distances(x[low : low + PART], centres).argmin(1) for low in range(0, len(x), PART)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = TRAIN_ROUNDS) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = nearest(x, centres)
        n = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def train(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    centroids = k_means(sample, lists, rng)
    rest = sample - centroids[nearest(sample, centroids)]
    cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    words = [k_means(rest[:, low:high], CODEWORDS, rng) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    return Index(centroids, words, cuts)


def probes(index: Index, home: np.ndarray, own: np.ndarray, far: np.ndarray, lists: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Boolean (vectors, lists): which of some lists may hold a partner, of number at least the own one's.

    own and far are the vectors' distances to their own centroid and to those of
    the lists.
    """
    plane = far**2 - own[:, None] ** 2 <= 2 * (reach + _SLACK) * index.between[np.ix_(home, lists)] + _SLACK
    inside = far - reach - _SLACK <= radius[lists][None, :]
    return plane & inside & (lists[None, :] >= home[:, None])


def cells_of(centroids: np.ndarray, total: int) -> np.ndarray:
    """Cell of each list: neighbouring lists together, as many cells as there are blocks of vectors."""
    k = min(len(centroids), max(1, round(total / BLOCK)))
    return nearest(centroids, k_means(centroids, k, np.random.default_rng(12)))


def table_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, PART):
            yield batch.slice(low, PART)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component near 1, so that no square under- or overflows; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0, keepdims=True))
    # In two steps, since 2^1074 is no double.
    half = -exponent // 2
    return np.ldexp(np.ldexp(x, half), -exponent - half)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable():
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists("embedding", lambda v: v != 0)


def near_pairs(index: Index, m: dict, q: dict, radius: np.ndarray, cosine: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(member places, query places) of the linked pairs of a block of members and one of queries.

    The distance of a query to a member's code is looked up in tables of inner
    products of its subspaces with all codewords, which hold for every list;
    the distance to the list's centroid and a number per member complete it.
    """
    asked = unit(q["vec"])
    lists, which = np.unique(m["home"], return_inverse=True)
    far = distances(asked, index.centroids[lists])
    own = np.linalg.norm(asked - index.centroids[q["home"]], axis=1)
    wanted = probes(index, q["home"], own, far, lists, radius, reach)
    parts = [slice(low, high) for low, high in zip(index.cuts[:-1], index.cuts[1:], strict=True)]
    tables = [(words @ asked[:, part].T).astype(np.float32) for part, words in zip(parts, index.codewords, strict=True)]
    decoded = np.concatenate([words[m["code"][:, k]] for k, words in enumerate(index.codewords)], axis=1)
    rest = 2 * (index.centroids[m["home"]] * decoded).sum(1) + (decoded**2).sum(1)
    limit = (reach + m["err"] + 1e-3) ** 2
    found_m, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number in range(len(lists)):
        pick = np.flatnonzero(wanted[:, number])
        if not len(pick):
            continue
        mine = np.flatnonzero(which == number)
        inner = np.zeros((len(mine), len(pick)), np.float32)
        for k, table in enumerate(tables):
            inner += table[m["code"][mine, k][:, None], pick[None, :]]
        # |q - c - d|^2 = |q - c|^2 - 2 q d + 2 c d + |d|^2, with the code's vector d.
        near = (far[pick, number] ** 2)[None, :] - 2 * inner <= (limit - rest)[mine][:, None]
        near &= (q["home"][pick] != lists[number])[None, :] | (q["cls"][pick][None, :] > m["cls"][mine][:, None])
        b, a = np.nonzero(near)
        found_m.append(mine[b])
        found_q.append(pick[a])
    x, y = np.concatenate(found_m), np.concatenate(found_q)
    len_q, len_x = np.linalg.norm(q["vec"], axis=1), np.linalg.norm(m["vec"], axis=1)
    good = np.zeros(len(x), bool)
    for low in range(0, len(x), 200_000):
        i, j = x[low : low + 200_000], y[low : low + 200_000]
        good[low : low + 200_000] = (m["vec"][i] * q["vec"][j]).sum(1) / (len_x[i] * len_q[j]) >= cosine
    return x[good], y[good]


def linked(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(cls, other, n): n vectors linked with a class outside it, and edges cls-other that span the links; classes: cls, embedding, size."""
    out = classes.sparkSession.createDataFrame([], "cls long, other long, n long")
    # One row per length.
    for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        if r["n"] > 1:
            out = out.unionByName(_linked_of(classes.where(F.size("embedding") == r["dim"]), r["dim"], r["n"], cosine))
    return out


def sample_of(classes: DataFrame, total: int) -> np.ndarray:
    """At most SAMPLE vectors, those of smallest hash; rows that can't be among them are left out before the sort."""
    h = F.xxhash64("cls")
    some = classes.select("embedding", h.alias("h"))
    if total > 2 * SAMPLE:
        some = some.where(h < int(-(2**63) + 2**64 * (1.5 * SAMPLE / total)))
    return np.array([r[0] for r in some.orderBy("h").limit(SAMPLE).select("embedding").collect()], np.float64)


def _linked_of(classes: DataFrame, dim: int, total: int, cosine: float) -> DataFrame:
    """linked for vectors of one length."""
    spark = classes.sparkSession
    index = train(unit(sample_of(classes, total)), max(1, min(MOST_LISTS, round(4 * math.sqrt(total)))))
    lists, cell = len(index.centroids), cells_of(index.centroids, total)
    cells = int(cell.max()) + 1
    shared = spark.sparkContext.broadcast(index)
    reach = math.sqrt(2 - 2 * cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in parts_of(batches):
            if batch.num_rows:
                home, codes, error, far = index.assign(unit(table_of(batch.column(1), dim)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home, pa.int32()), pa.array(cell[home], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far.min(1))],
                    names=["cls", "vec", "size", "home", "cell", "code", "err", "far"],
                )

    source = classes.select("cls", F.col("embedding").alias("vec"), "size")
    width = source.schema["vec"].dataType.simpleString()
    placed = materialise(source.mapInArrow(place, f"cls long, vec {width}, size long, home int, cell int, code binary, err double, far double"), "pq-index")
    # One row per list, at most MOST_LISTS.
    radius, members = np.full(lists, -1.0), np.zeros(cells, np.int64)
    for r in placed.groupBy("home").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["home"]] = r["far"]
        members[cell[r["home"]]] += r["n"]
    shares = np.maximum(1, -(-members // BLOCK))
    first = np.cumsum(shares) - shares

    def gather(table: pa.Table) -> pa.Table:
        """The vectors of a block as one row."""
        index = shared.value
        block = {k: table.column(k).to_numpy() for k in ("cls", "size", "home", "err")}
        x = np.concatenate([unit(table_of(part, dim)) for part in table.column("vec").chunks])
        far = distances(x, index.centroids)
        wanted = probes(index, block["home"], far[np.arange(len(x)), block["home"]], far, np.arange(lists), radius, reach).any(0)
        block["code"] = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, len(index.codewords))
        block["vec"] = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        asked = [np.unique(cell[wanted]).tolist()]
        return pa.table(
            {"block": table.column("block")[:1], "cell": table.column("cell")[:1], "asks": pa.array(asked, pa.list_(pa.int32())), "data": pa.array([pickle.dumps(block, protocol=5)], pa.binary())}
        )

    sizes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, shares, strict=True))], "cell int, first int, shares int")
    number = (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("shares"))).cast("int")
    dealt = placed.join(F.broadcast(sizes), "cell").select(number.alias("block"), "cell", "cls", "vec", "size", "home", "code", "err")
    blocks = materialise(dealt.groupBy("block").applyInArrow(gather, "block int, cell int, asks array<int>, data binary"), "pq-blocks")
    discard(placed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                m, q = (pickle.loads(batch.column(side)[k].as_py()) for side in (0, 1))  # our own blocks
                for side in (m, q):
                    side["vec"] = scaled(side["vec"].astype(np.float64))
                x, y = near_pairs(index, m, q, radius, cosine, reach)
                cls, at = np.unique(np.concatenate([m["cls"], q["cls"]]), return_inverse=True)
                u, v = at[x], at[len(m["cls"]) + y]
                n = np.bincount(u, weights=q["size"][y], minlength=len(cls)) + np.bincount(v, weights=m["size"][x], minlength=len(cls))
                root, keep = spanning(len(cls), u, v), n > 0
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(cls[root][keep]), pa.array(n[keep].astype(np.int64))], names=["cls", "other", "n"])

    total_blocks = int(shares.sum())
    parts = max(min(total_blocks, SPREAD), -(-total_blocks // TOGETHER))
    spread = blocks.repartition(parts)
    one = spread.select(F.col("cell").alias("m_cell"), F.col("data").alias("m"))
    other = spread.select("asks", F.col("data").alias("q"))
    # Each task reads a partition of either side; no row is copied for another task.
    met = one.hint("shuffle_replicate_nl").join(other, F.array_contains("asks", F.col("m_cell"))).select("m", "q")
    found = materialise(met.mapInArrow(compare, "cls long, other long, n long"), "vector-links")
    discard(blocks)
    return found


def _key(embedding: str) -> list[Column]:
    """128 bits of hash of a vector; zeros of either sign are one value."""
    plain = F.transform(embedding, lambda v: v + F.lit(0).cast("float"))
    return [F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit("second"), plain).alias("k2")]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    rows = vectors.select("vec_id", F.when(_usable(), F.col("embedding")).alias("embedding"))
    keyed = rows.where(F.col("embedding").isNotNull()).select("vec_id", "embedding", *_key("embedding"))
    # The number of a class is fixed by writing the table.
    classes = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("size"), F.any_value("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    links = linked(classes.select("cls", "embedding", "size"), cosine)
    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    groups = connected_components(links.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    out = classes.join(counts, "cls", "left").join(groups, "cls", "left").select(
        "k1", "k2", "vec_id", F.coalesce("component", "cls").alias("component"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n")
    )
    out = materialise(out, "vector-groups")
    discard(classes)
    low = materialise(out.groupBy("component").agg(F.min("vec_id").alias("component_id")), "vector-lowest")
    # Stored, so that a hot vector's rows can be split in the join.
    found = materialise(out.join(low, "component").select("k1", "k2", "n", "component_id"), "vector-found")
    asked = rows.select("vec_id", F.col("embedding").isNotNull().alias("usable"), *_key("embedding"))
    joined = asked.where("usable").join(found, ["k1", "k2"], "left")
    linked_rows = joined.select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id")
    alone = asked.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
