"""Alignment of two tokenizers by merge-path partitioning.

Two tokenizers, A and B, cut the same bytes. Merging the sorted byte offsets at
which their tokens end gives all overlaps: between two neighbouring ends lies one
pair of tokens, so the pairs of one text are as many as its different ends. Ends
that both have cut the tokens into groups.

The merge is divided into pieces of ``WORK`` ends each. A binary search along each
diagonal finds how many ends of A and of B are in the pieces before, whatever
texts these belong to, so a piece is equal work and needs no other: it emits its
overlaps, and whether an end is common. A tie that a diagonal divides is the
one thing that two pieces share; stitching them carries the number of groups on.

Shape of the job. A narrow pass tokenises each text once, packs texts into blocks
of about ``BLOCK_BYTES`` and stores per block its distinct pairs of ids with their
counts and, per text, which of them it holds. Counts of pairs are added up by an
aggregation with map-side combine. Totals are dealt to buckets by B's id, so a
bucket also knows the highest count of its ids; each block asks the buckets for
its pairs' totals, which a stream over sorted partitions answers (totals first,
then the blocks that ask), with hot buckets divided by salts. What moves is
proportional to the distinct pairs per block and text; no table of counts is
broadcast or collected. A bucket is bounded by the two vocabularies.

Defined results: a null or empty text, and one whose tokens don't spell a blank
and the text (as one with U+2581, which B reads as a blank), has no tokens: all
counts 0 and no groups; a null id is kept; repeated rows give repeated results
and count repeatedly; an empty table gives no rows; columns of other names are
not read. A text is held by one task, together with its tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import materialise
from fixturelake.llm.lm import pack, pack_counts, pack_sorted, unpack, unpack_counts, unpack_sorted
from fixturelake.llm.packing import ByteCoder
from fixturelake.llm.pieces import BLANK

#: Ends in a piece of the merge.
WORK = 1 << 16
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 20_000
#: Distinct pairs in a bucket, blocks that ask one copy of it, and tokens of which the text of groups is built at once.
BUCKET_PAIRS, BLOCKS_ASKING, TEXT_TOKENS = 50_000, 512, 1 << 20


class Tokenizers:
    """Both encoders with the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece

        self.a, self.b = ByteCoder(vocabulary).coder, sentencepiece.SentencePieceProcessor(model_file=model)
        with open(vocabulary, "rb") as f:
            ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
        self.bytes_a = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        of_byte = {self.b.piece_to_id(f"<0x{v:02X}>"): bytes([v]) for v in range(256)}
        self.bytes_b = [of_byte.get(i, self.b.id_to_piece(i).replace(BLANK, " ").encode()) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in each], np.int64) for each in (self.bytes_a, self.bytes_b))
        if len(self.bytes_b) > 1 << 15 or len(self.bytes_a) > 1 << 16:
            raise ValueError("a pair of ids must fit 31 bits")
        self.text, self.size = _id_table(len(self.bytes_a), len(self.bytes_b))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, or None if they don't spell a blank and the text."""
        if not text:
            return None
        whole = " " + text
        a, b = self.a.encode_ordinary(whole), self.b.encode(text)
        spelled = lambda ids, table: b"".join(map(table.__getitem__, ids))
        spells = whole.encode()
        return (np.array(a, "<u2"), np.array(b, "<u2")) if spelled(b, self.bytes_b) == spells and spelled(a, self.bytes_a) == spells else None


def _id_table(n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with what follows them (A: comma, bar; B: comma, semicolon), padded, and their sizes."""
    words = [f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
    size = np.array([len(w) for w in words])
    wide = int(size.max())
    return np.frombuffer(b"".join(w.ljust(wide) for w in words), "u1").reshape(-1, wide), size


@lru_cache(maxsize=2)
def load(vocabulary: str, model: str) -> Tokenizers:
    return Tokenizers(vocabulary, model)


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ends of a and of b before each piece of the merge, and after the last; a goes first on ties."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while True:
        searching = np.flatnonzero(low < high)
        if not len(searching):
            return low, d - low
        mid = (low[searching] + high[searching]) >> 1
        before = a[mid] <= b[d[searching] - mid - 1]
        low[searching[before]] = mid[before] + 1
        high[searching[~before]] = mid[~before]


def merge_piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (places in a, places in b) of a piece, and the places of its common ends in a and in b.

    Each end of the piece closes one overlap, of the first tokens of a and b that end there or later. The place of a
    common end in b belongs to the piece in which a has it.
    """
    x, y = a[i[0] : i[1]], b[j[0] : j[1]]
    at_b = j[0] + np.searchsorted(y, x)
    common = b[at_b] == x
    at_a = i[0] + np.searchsorted(x, y)
    # Ends of b that a has too are closed by a, at this piece's front perhaps in the piece before.
    own = a[np.minimum(at_a, len(a) - 1)] != y
    if i[0] and len(y):
        own[0] &= a[i[0] - 1] != y[0]
    places = np.arange(j[0], j[1])
    return np.concatenate([np.arange(i[0], i[1]), at_a[own]]), np.concatenate([at_b, places[own]]), i[0] + np.flatnonzero(common), at_b[common]


def merge_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps and common ends of two sorted arrays with the same last end, piece by piece."""
    cut_a, cut_b = (c.tolist() for c in diagonals(a, b, work))
    pieces = [merge_piece(a, b, (cut_a[k], cut_a[k + 1]), (cut_b[k], cut_b[k + 1])) for k in range(len(cut_a) - 1)]
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


def group_digests(t: Tokenizers, a: np.ndarray, b: np.ndarray, common_a: np.ndarray, common_b: np.ndarray, last: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups; ``last`` is the number of its last group, the texts being one behind the other."""
    out, sha, n_a = [], hashlib.sha256(), len(t.bytes_a)
    stop_a, stop_b = np.append(0, common_a + 1), np.append(0, common_b + 1)
    texts, low = iter(last.tolist()), 0
    text = next(texts, None)
    while low < len(common_a):
        high = max(low + 1, int(np.searchsorted(stop_a + stop_b, stop_a[low] + stop_b[low] + TEXT_TOKENS, "right")) - 1)
        a0, a1, b0, b1 = stop_a[low], stop_a[high], stop_b[low], stop_b[high]
        size_a, size_b = np.diff(stop_a[low : high + 1]), np.diff(stop_b[low : high + 1])
        # Each group's tokens of A, then those of B.
        place_a = np.arange(a1 - a0) + np.repeat(stop_b[low:high] - b0, size_a)
        place_b = np.arange(b1 - b0) + np.repeat(stop_a[low + 1 : high + 1] - a0, size_b)
        word = np.empty(len(place_a) + len(place_b), np.int64)
        word[place_a] = a[a0:a1]
        word[place_b] = b[b0:b1].astype(np.int64) + 2 * n_a
        word[place_a[np.cumsum(size_a) - 1]] += n_a
        word[place_b[np.cumsum(size_b) - 1]] += len(t.bytes_b)
        size = t.size[word]
        written = t.text[word][np.arange(t.text.shape[1]) < size[:, None]].tobytes()
        ends = np.cumsum(size)[np.cumsum(size_a + size_b) - 1]  # of each group
        at = 0
        while text is not None and text < high:
            end = int(ends[text - low])
            sha.update(written[at : end - 1])
            out.append(sha.hexdigest())
            sha, at, text = hashlib.sha256(), end, next(texts, None)
        sha.update(written[at:])
        low = high
    return out


BLOCKS = "doc_id array<{}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<long>, groups_sha256 array<string>, codes binary, n binary, sizes array<int>, held binary, times binary"


def align_block(t: Tokenizers, encoded: list[tuple[np.ndarray, np.ndarray] | None]) -> list:
    """Values of a block's row, without the ids: of texts given as ids of A and B."""
    some = [k for k, e in enumerate(encoded) if e is not None]
    n_a, n_b, n_groups, n_links, sizes = (np.zeros(len(encoded), np.int64) for _ in range(5))
    sha = [""] * len(encoded)
    if not some:
        return [n_a, n_b, n_groups, n_links, sha, pack_sorted(np.zeros(0, "<u8")), b"", sizes, pack_sorted(np.zeros(0, "<u8")), b""]
    a, b = (np.concatenate([encoded[k][side] for k in some]) for side in (0, 1))
    n_a[some], n_b[some] = ([len(encoded[k][side]) for k in some] for side in (0, 1))
    end_a, end_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
    at_a, at_b, common_a, common_b = merge_ends(end_a, end_b)
    last = np.searchsorted(common_a, np.cumsum(n_a[some]) - 1)
    n_groups[some] = np.diff(last, prepend=-1)
    for k, digest in zip(some, group_digests(t, a, b, common_a, common_b, last), strict=True):
        sha[k] = digest
    text = np.repeat(np.arange(len(encoded)), n_a)[at_a]
    n_links += np.bincount(text, minlength=len(encoded))
    pair = b[at_b].astype("<u8") << np.uint64(16) | a[at_a]
    codes, place = np.unique(pair, return_inverse=True)
    # Distinct pairs of each text, as text * number of codes + place.
    held, times = np.unique(text * len(codes) + place, return_counts=True)
    sizes += np.bincount(held // len(codes), minlength=len(encoded))
    n = np.bincount(place, minlength=len(codes))
    return [n_a, n_b, n_groups, n_links, sha, pack_sorted(codes), pack_counts(n), sizes, pack_sorted(held.astype("<u8")), pack_counts(times)]


def aligned_blocks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Stored blocks of tokenised and aligned texts."""
    source = docs.select("doc_id", "text")
    schema = BLOCKS.format(source.schema[0].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(vocabulary, model)
        ids, encoded, size = [], [], 0
        kinds = None

        def block() -> pa.RecordBatch:
            values = [ids, *align_block(t, encoded)]
            return pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, bytes) else list(v)], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            whole, text = pa.list_(pa.int32()), pa.list_(pa.string())
            kinds = [pa.list_(batch.schema.field(0).type), whole, whole, whole, pa.list_(pa.int64()), text, pa.binary(), pa.binary(), whole, pa.binary(), pa.binary()]
            for doc, value in zip(*batch.columns, strict=True):
                value = value.as_py() or ""
                ids.append(doc.as_py())
                encoded.append(t.encode(value))
                size += len(value)
                if size >= BLOCK_BYTES or len(ids) == BLOCK_TEXTS:
                    yield block()
                    ids, encoded, size = [], [], 0
        if ids:
            yield block()

    return materialise(source.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, n): how many links of all texts hold a pair of ids; code is B's id * 65536 + A's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, n in zip(*batch.columns, strict=True):
                codes = unpack_sorted(codes.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype("i4")), pa.array(unpack_counts(n.as_py(), len(codes)).astype("i8"))], names=["code", "n"])

    return blocks.select("codes", "n").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each code, by B's id; ``_bucket_of`` is the same for a column."""
    return (codes >> np.uint64(16)).astype(np.int64) % buckets


ROWS = "bucket int, salt int, block long, codes binary, n binary"


def _packed_totals(counts: DataFrame, buckets: int, salts: int) -> DataFrame:
    """A row per bucket and salt with the sorted codes and their totals; a bucket holds whole ids of B."""
    each = counts.groupBy((F.shiftright("code", 16) % buckets).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, found in zip(*batch.columns, strict=True):
                codes, n = (found.values.field(k).to_numpy() for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), pa.array([pack_sorted(codes.astype("<u8"))]), pa.array([pack(n)])], names=["bucket", "codes", "n"])

    packed = each.mapInArrow(run, "bucket int, codes binary, n binary")
    return packed.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("block"), "codes", "n")


def _asked(blocks: DataFrame, buckets: int, salts: int) -> DataFrame:
    """A row per block and bucket with the codes whose totals the block needs."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(*batch.columns, strict=True):
                codes = unpack_sorted(packed.as_py())
                bucket = _bucket(codes, buckets)
                found, first = np.unique(bucket[np.argsort(bucket, kind="stable")], return_index=True)
                parts = np.split(codes[np.argsort(bucket, kind="stable")], first[1:]) if len(codes) else []
                n = len(parts)
                salt = block.as_py() * 40_503 % salts
                columns = [pa.array(found[:n], pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int64()), pa.array(map(pack_sorted, parts), pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.select("block", "codes").mapInArrow(run, ROWS)


def highest(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id; codes are sorted."""
    if not len(codes):
        return np.zeros(0, bool)
    own = codes >> np.uint64(16)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(codes))))


ANSWERS = "block long, bucket int, n binary, best binary"


def answers(blocks: DataFrame, counts: DataFrame, buckets: int, salts: int) -> DataFrame:
    """Totals of each block's pairs per bucket, in the order asked, and whether they are the highest of their B id."""
    rows = _packed_totals(counts, buckets, salts).unionByName(_asked(blocks, buckets, salts))
    names = [c.split()[0] for c in ANSWERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = n = best = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] < 0:
                    codes, n = unpack_sorted(row["codes"]), unpack(row["n"])
                    best = highest(codes, n)
                else:
                    at = np.searchsorted(codes, unpack_sorted(row["codes"]))
                    out.append((row["block"], row["bucket"], pack(n[at]), np.packbits(best[at]).tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "block").mapInArrow(run, ANSWERS)


DOCUMENTS = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def per_document(blocks: DataFrame, answered: DataFrame, buckets: int) -> DataFrame:
    """One row per text from its block and the block's answers."""
    schema = DOCUMENTS.format(blocks.schema["doc_id"].dataType.elementType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy())
        replies = [(unpack(right.column("n")[int(i)].as_py()), right.column("best")[int(i)].as_py()) for i in order]
        out = []
        for i in range(left.num_rows):
            codes = unpack_sorted(left.column("codes")[i].as_py())
            place = np.argsort(_bucket(codes, buckets), kind="stable")
            n, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            if len(codes):
                n[place] = np.concatenate([x for x, _ in replies])
                best[place] = np.concatenate([np.unpackbits(np.frombuffer(y, "u1"), count=len(x)) for x, y in replies])
            held = unpack_sorted(left.column("held")[i].as_py())
            times = unpack_counts(left.column("times")[i].as_py(), len(held)).astype(np.int64)
            at = (held % np.uint64(max(len(codes), 1))).astype(np.int64)
            sizes = left.column("sizes")[i].values.to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            add = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])  # noqa: B023, E731
            columns = [left.column("doc_id")[i].values]
            columns += [left.column(c)[i].values.cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(add(times * best[at]), pa.int64()), pa.array(add(times * n[at]), pa.int64()), left.column("groups_sha256")[i].values]
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out)

    return blocks.drop("n").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def align_tokenizers(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Tokens, groups and links of every text, with the corpus-wide counts of its linked pairs of ids."""
    spark = docs.sparkSession
    blocks = aligned_blocks(docs, vocabulary, model)
    counts = materialise(pair_counts(blocks), "pair-counts")
    number, asking = counts.count(), blocks.count()
    buckets = max(1, min(1 << 15, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number // BUCKET_PAIRS))))
    answered = answers(blocks, counts, buckets, max(1, -(-asking // BLOCKS_ASKING)))
    return per_document(blocks, answered, buckets)


def token_groups(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """(doc_id, start, end, a, b): byte span in a blank and the text, and the ids of A and B, of every group of every text."""
    source = docs.select("doc_id", "text")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(vocabulary, model)
        for batch in batches:
            for r, text in enumerate(batch.column(1)):
                ids = t.encode(text.as_py() or "")
                if ids is None:
                    continue
                a, b = ids
                _, _, common_a, common_b = merge_ends(end := np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b]))
                stop = end[common_a]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, c + 1), pa.int32()), pa.array(x.astype("i4"))) for c, x in ((common_a, a), (common_b, b))]
                columns = [batch.column(0).take(pa.array([r] * len(stop), pa.int64())), pa.array(np.append(0, stop[:-1]), pa.int64()), pa.array(stop, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "a", "b"])

    return source.mapInArrow(run, f"doc_id {kind}, start long, end long, a array<int>, b array<int>")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers on every document."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))
