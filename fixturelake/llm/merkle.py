"""Merkle manifest of a data set with proofs by pointer jumping.

Every row is a leaf, the SHA-256 of its typed values. Leaves of a group (a
language) ascend by id; while several nodes remain, each two consecutive ones, or
the last one alone, become their digest. The roots of the groups, ordered by
group with null first, likewise give the root of the data set. The siblings of
all nodes on the way from a leaf to the root prove that the leaf is in it.

Shape of the job. Texts are read once, by the scan that digests them; only ids and
digests move. Leaves are dealt by ranges of (group, id) and sorted in them; places
follow from the counts per range. Trees are built from aligned blocks of
2^``BLOCK_LEVELS`` nodes, a row per block, so a round climbs that many levels and a
group of any size is many blocks. Every node then holds the segment of its
sibling towards its parent. A round joins the nodes with themselves, appends to
each segment that of the node where it ends and so doubles the distance to the
ancestor, until every leaf reaches the root. Only nodes whose level is a multiple
of the distance can be met again, so the tables of inner nodes shrink from round
to round and leaves are joined once in each. An ancestor at distance d has at most
2^d descendants, and it meets many only where there are few such ancestors.

Defined results: nulls are part of a leaf; rows of equal id are ordered by their
leaf and may be exchanged if these are equal too; a null id comes first and isn't
tampered with; an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.llm.common import materialise

#: Levels that one round of building climbs; a block has at most 2^12 nodes.
BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: First byte of each part of a segment: the sibling follows and stands left or right, or there is none.
LEFT, RIGHT, ALONE = b"<", b">", b"="


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 as binary of values, each its UTF-8 bytes' number, a colon and itself, or - for null."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*each).cast("binary"), 256))


def group_key(value: Column) -> Column:
    """A key without nulls, in the order of the values' bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, a stored table with the column tree, with idx (place within the tree, from 0) and n (rows of the tree)."""
    keys = [F.asc_nulls_first(c) for c in ["tree", *order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(dealt.withColumn("place", F.monotonically_increasing_id()), "merkle-order").withColumn("range", F.shiftright("place", 33))
    sizes = placed.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("low"))
    # A tree has a row per range that it meets.
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("tree", "range", "low", before.alias("before"), F.sum("size").over(tree).alias("n"))
    return placed.join(sizes, ["tree", "range"]).withColumn("idx", F.col("place") - F.col("low") + F.col("before")).drop("place", "range", "low", "before")


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    return (n - 1).bit_length()


NODES = "tree string, n long, level int, idx long, hash binary, segment binary"


def block_levels(nodes: list[bytes], low: int, levels: int) -> list[list[tuple[int, bytes, bytes | None]]]:
    """(place, digest, segment) of the nodes of each level of an aligned block; the one node that remains has no segment."""
    out = []
    for _ in range(levels):
        segments = []
        for k, digest in enumerate(nodes):
            sibling = nodes[k ^ 1] if k ^ 1 < len(nodes) else None
            segments.append((low + k, digest, ALONE if sibling is None else (LEFT if k & 1 else RIGHT) + sibling))
        out.append(segments)
        text = [x.hex() for x in nodes]
        nodes = [hashlib.sha256("".join(text[k : k + 2]).encode()).digest() for k in range(0, len(text), 2)]
        low >>= 1
    return [*out, [(low, nodes[0], None)]]


def climb(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, n, level, idx, hash) of one level with all levels up to BLOCK_LEVELS above; the last ones have no segment."""
    grouped = nodes.groupBy("tree", "n", "level", F.shiftright("idx", BLOCK_LEVELS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = min(BLOCK_LEVELS, depth(row["n"]) - row["level"])
                found = block_levels([x["hash"] for x in row["nodes"]], row["nodes"][0]["idx"], levels)
                flat = [(row["level"] + k, *x) for k, each in enumerate(found) for x in each]
                columns = [[row["tree"]] * len(flat), [row["n"]] * len(flat), *map(list, zip(*flat, strict=True))]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])

    return grouped.mapInArrow(run, NODES)


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with segments, roots (tree, root), greatest depth) of leaves (tree, n, idx, hash)."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 1
    rounds = max(1, -(-depth(most) // BLOCK_LEVELS))
    below, tables = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "hash"), []
    levels = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    for k in range(rounds):
        tables.append(materialise(climb(below), "merkle-nodes"))
        last = tables[-1].where(F.col("segment").isNull())
        below = last.where(F.col("level") < levels).drop("segment")
    every = tables[0] if tables else spark.createDataFrame([], NODES)
    for t in tables[1:]:
        every = every.unionByName(t)
    roots = every.where(F.col("segment").isNull() & (F.col("level") >= levels)).select("tree", F.col("hash").alias("root"))
    return every.where(F.col("segment").isNotNull()).select("tree", "level", "idx", "segment"), roots, depth(most)


def segments_to_root(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, idx, segment) of every leaf of a tree of two or more, by pointer jumping."""
    leaves, inner, distance = nodes.where("level = 0").select("tree", "idx", "segment"), nodes.where("level > 0"), 1
    longer = F.concat("segment", F.coalesce("more", F.lit(b""))).alias("segment")
    while distance < levels:
        up = inner.select("tree", F.col("level").alias("meets"), F.col("idx").alias("at"), F.col("segment").alias("more"))
        first = up.where(F.col("meets") == distance).drop("meets")
        at = F.shiftright("idx", distance).alias("at")
        leaves = leaves.select("*", at).join(first, ["tree", "at"], "left").select("tree", "idx", longer)
        if 2 * distance < levels:
            base = inner.where(F.col("level") % (2 * distance) == 0).select("*", at, (F.col("level") + distance).alias("meets"))
            inner = materialise(base.join(up, ["tree", "meets", "at"], "left").select("tree", "level", "idx", longer), "merkle-segments")
        distance *= 2
    return leaves


def fold(leaf: bytes, segment: bytes) -> bytes:
    """The root that a leaf and the siblings of a segment give."""
    at = leaf.hex()
    k = 0
    while k < len(segment):
        side = segment[k : k + 1]
        k += 1
        if side == ALONE:
            pair = at
        else:
            sibling = segment[k : k + 32].hex()
            k += 32
            pair = sibling + at if side == LEFT else at + sibling
        at = hashlib.sha256(pair.encode()).hexdigest()
    return bytes.fromhex(at)


def siblings(segment: bytes) -> list[str]:
    out, k = [], 0
    while k < len(segment):
        if segment[k : k + 1] != ALONE:
            out.append(segment[k + 1 : k + 33].hex())
            k += 32
        k += 1
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (tree, hash and others) with subroot, root and segment, the path of siblings from the leaf to the root.

    leaves must be a stored table with the column tie, which tells rows of equal (tree, doc_id, hash) apart.
    """
    placed = numbered(leaves, ["doc_id", "hash", "tie"])
    nodes, roots, levels = build(placed)
    tops = numbered(materialise(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("hash")), "merkle-roots"), ["group"])
    top_nodes, top_root, top_levels = build(tops)
    top = tops.select(F.col("group").alias("tree"), "idx", F.col("hash").alias("subroot"))
    paths = segments_to_root(top_nodes, top_levels).select("idx", F.col("segment").alias("top"))
    # One row, the root of the data set, beside one per group.
    top = top.join(paths, "idx", "left").withColumn("one", F.lit("")).join(top_root.withColumnRenamed("tree", "one"), "one").select("tree", "subroot", "root", "top")
    out = placed.join(segments_to_root(nodes, levels), ["tree", "idx"], "left").join(materialise(top, "merkle-top"), "tree")
    path = F.concat(F.coalesce("segment", F.lit(b"")), F.coalesce("top", F.lit(b"")))
    return out.withColumn("segment", path).drop("top", "n", "idx", "tie")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Stored leaves of documents: tree, doc_id, hash, tie and changed, the leaf after tampering where there is some."""
    value = [F.col(c) for c in FIELDS]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = docs.select(
        group_key(F.col("lang")).alias("tree"), "doc_id", leaf_digest(value).alias("hash"), F.when(hit, leaf_digest(more)).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    return materialise(rows, "merkle-leaves")


def verified(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; rows is a manifest with the column changed."""
    source = rows.select("doc_id", "hash", "changed", "subroot", "root", "segment")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, changed, sub, root, path = (c.to_pylist() for c in batch.columns[1:])
            proof = [hashlib.sha256("".join(siblings(p)).encode()).hexdigest() for p in path]
            folded = [fold(a if b is None else b, p) for a, b, p in zip(leaf, changed, path, strict=True)]
            text = [pa.array([x.hex() for x in v], pa.string()) for v in (leaf, sub, root)]
            right = pa.array(np.array([a == b for a, b in zip(folded, root, strict=True)], bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), *text, pa.array(proof, pa.string()), pa.array([x.hex() for x in folded], pa.string()), right], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its verification after tampering for every document."""
    return verified(manifest(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
