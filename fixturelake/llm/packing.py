"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. One sequence after
another takes the longest piece left and then the fullest combination of the
other lengths that are left, found by subset-sum dynamic programming over a
bitset of reachable totals; the combination is removed and the next sequence
is filled.

Only lengths matter for that, so it runs on the histogram of lengths, which
has ``capacity`` entries at most however large the corpus is. A combination
stays the fullest while its lengths last, so it is taken as often as they
allow; each step uses up a length, so there are at most ``capacity`` steps.
The plan (length, range of ranks -> sequence and offset) is broadcast with a
bound of 45 ``capacity`` rows, since a sequence holds at most 44 different
lengths of a total of 1024.

Scale: tokenising is one narrow pass, written once as one small row per piece.
Pieces of a length are ranked within salted buckets with offsets from bucket
counts, so a frequent length never meets in one task.

Defined results: a null or empty text is one piece of length 1, the end id;
repeated rows are packed as often as they occur; a null id is kept; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixturelake.llm.common import materialise

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that a task ranks.
SALT_PIECES = 250_000
#: Bytes of remembered chunks per worker (each costs ENTRY besides its characters and ids), and characters of the longest kept.
MOST_KEPT, ENTRY, LONGEST_KEPT = 40_000_000, 200, 48
#: A blank before a visible character always starts a new pre-token.
_CHUNK = re.compile(r" (?=\S)")


class ByteCoder:
    """Ids of the byte-level vocabulary; encoded chunks are remembered per worker, up to a fixed number of bytes.

    With ``added_tokens`` those of the tokenizer's json beside the rank file get their ids wherever they stand in a
    text, as the tokenizer does when it is loaded; without, they are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = []
        if added_tokens:
            with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as f:
                added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must match as they stand")
        if max([*ranks.values(), *(t["id"] for t in added)]) >= 0xD800:
            raise ValueError("ids must fit one UTF-16 unit")
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: chr(t["id"]) for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.known: dict[str, str] = {}
        self.kept = 0

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        ids = [self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(parts)]
        return np.frombuffer("".join(ids).encode("utf-16-le"), "<u2")

    def _plain(self, text: str) -> str:
        """Ids, one character each, of a text without added tokens."""
        first, *rest = _CHUNK.split(text)
        known, out = self.known, [self._chunk(first)]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = self._chunk(" " + chunk)
                if len(chunk) <= LONGEST_KEPT:
                    if self.kept > MOST_KEPT:
                        known.clear()
                        self.kept = 0
                    known[chunk] = ids
                    self.kept += ENTRY + 2 * (len(chunk) + len(ids))
            out.append(ids)
        return "".join(out)

    def _chunk(self, chunk: str) -> str:
        return "".join(map(chr, self.coder.encode_ordinary(chunk)))


@lru_cache(maxsize=2)
def load(path: str) -> ByteCoder:
    return ByteCoder(path, added_tokens=True)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    source = docs.select("doc_id", "text")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                ids = np.append(coder.encode(text.as_py() or ""), end_id).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths with the greatest total of at most room, each at most counts times; longer ones preferred."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found += [length] * take
            at -= length * take
    return found


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, first_sequence, per_sequence, offset).

    The pieces of a length with rank in [low, high) go, per_sequence at a time,
    to the sequences from first_sequence on, one behind the other from offset.
    """
    left = {k: v for k, v in histogram.items() if v}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        combination = [seed, *fullest(left, capacity - seed)]
        left[seed] += 1
        each: dict[int, int] = {}
        for x in combination:
            each[x] = each.get(x, 0) + 1
        times = min(left[x] // m for x, m in each.items())
        offset = 0
        for x, m in each.items():
            rows.append((x, used[x], used[x] + m * times, sequence, m, offset))
            offset += x * m
            used[x] += m * times
            left[x] -= m * times
            if not left[x]:
                del left[x]
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset; pieces has doc_id, piece, start, length and ids_crc32 and must be a stored table."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), max(histogram.values(), default=0) // SALT_PIECES)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    plan = spark.createDataFrame(
        plan_bins(histogram, capacity), "length long, low long, high long, first long, per long, base long"
    )
    ranked = salted.withColumn(
        "rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    within = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & within)
    turn = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
        (F.col("first") + F.expr("(rank - low) div per")).alias("sequence_id"),
        (F.col("base") + F.pmod(turn, F.col("per")) * F.col("r.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset."""
    return pack(materialise(pieces_of(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
