"""Language-model scoring by deleted interpolation.

The model mixes four estimates of the next token: uniform over the training
vocabulary and one unknown type, and unigram, bigram and trigram maximum
likelihood. The mixture weights depend on how often the context was seen (one
bucket per power of two, of the two tokens before or, if these were never seen
together, of the one token before) and are learned by expectation-maximisation
on held-out counts: a tenth of the training documents is scored with counts from
the others. The final counts come from all training documents.

Shape of the job. Texts are packed into blocks of about ``BLOCK_BYTES``, written
once; a longer text is cut at blanks into pieces that know the two tokens before
them, so memory doesn't grow with a text. Each block sends its distinct n-grams,
hashed, sorted and packed into one binary per hash bucket, to the bucket's task.
That task adds the counts up and answers every block with the totals in the same
order. So what moves is proportional to the distinct n-grams per block; a
frequent n-gram is one entry per block, and no count table is broadcast or
collected. Only the binned statistics for the weights (at most buckets x bins
rows, whatever the input) reach the driver.

Scale: there is a bucket per ``BUCKET_BYTES`` of text, many to a task, up to
``MOST_BUCKETS`` (beyond about 50 GB of text buckets grow instead of becoming
more, and blocks and executors should grow with them). Within a bucket 48 bits
tell unigrams apart and 40 bits longer n-grams, so a lookup meets a collision
with a chance of about one in a million or less.

Defined results: a null or empty text is the end token alone; a null id counts
as the empty text in the fold; repeated rows count repeatedly; an empty
training set scores everything as one unknown type; columns of other names are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import crc_bucket, materialise

FOLDS, HELD_OUT, TUNING = 10, 0, 1
UNIGRAM_BITS, LONGER_BITS = 48, 40
#: Context-count buckets (powers of two, the last one open): those of one token, then those of two.
CONTEXT_BUCKETS = 24
#: Bins of each estimate in the tuning statistics, of so many octaves each.
BINS, BIN_OCTAVES = 20, 1.5
ROUNDS = 60
#: Weights (uniform, unigram, bigram, trigram) of a bucket without tuning tokens, and the least weight of the uniform part.
DEFAULT_WEIGHTS, LEAST = (0.1, 0.3, 0.3, 0.3), 1e-6
BLOCK_BYTES, BLOCK_TEXTS = 6_000_000, 50_000
BUCKET_BYTES, MOST_BUCKETS = 2_000_000, 25_000
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, after a byte with that width."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view("u1").reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, "u1", offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), "u1")
    out[:, :width] = raw
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """One byte per count; those of 255 or more follow in full."""
    values = np.ascontiguousarray(values, "<u8")
    return np.minimum(values, 255).astype("u1").tobytes() + values[values >= 255].tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, "u1", n).astype("<u8")
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased."""
    import xxhash

    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _codes(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """bucket << 48 | low bits."""
    bucket = ((keys >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
    return bucket << np.uint64(48) | keys & np.uint64((1 << bits) - 1)


def pieces_of(text: bytes, size: int) -> Iterator[tuple[bytes, bool, tuple[int, int]]]:
    """(bytes, last, two tokens before) of a text cut at blanks into pieces of about ``size``."""
    low, before = 0, (int(_START), int(_START))
    while len(text) - low > size:
        blank = _BLANK.search(text, low + size)
        if blank is None:
            break
        piece = text[low : blank.start()]
        yield piece, False, before
        # The two last tokens of the piece, or of those before it.
        words = piece.rsplit(None, 2)[-2:] if len(piece.split(None, 2)) > 2 else piece.split()
        before = tuple([*before, *(int(x) for x in token_hashes(b" ".join(words)))][-2:])
        low = blank.end()
    yield text[low:], True, before


BLOCKS = "tuning boolean, bytes long, doc_id array<{}>, number array<long>, held_out array<boolean>, last array<boolean>, before array<long>, sizes array<int>, texts binary"


def pack_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of texts of one kind (of the tuning fold or not); docs: doc_id, text, fold and number (unique)."""
    schema = BLOCKS.format(docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        waiting: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        packer = zstandard.ZstdCompressor(level=6)

        def packed(tuning: bool) -> pa.RecordBatch:
            rows = waiting[tuning]
            doc, number, held, text, last, before = (list(x) for x in zip(*rows, strict=True))
            joined = b"".join(text)
            values = [
                tuning, len(joined), doc, number, held, last, [x - (1 << 64) if x >> 63 else x for pair in before for x in pair],
                [len(x) for x in text], packer.compress(joined),
            ]
            waiting[tuning], size[tuning] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            own = batch.schema.field(0).type
            kinds = [pa.bool_(), pa.int64(), pa.list_(own), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            for doc, text, fold, number in zip(*batch.columns, strict=True):
                tuning = fold.as_py() == TUNING
                for piece, last, before in pieces_of((text.as_py() or "").encode(), BLOCK_BYTES):
                    waiting[tuning].append((doc.as_py(), number.as_py(), fold.as_py() == HELD_OUT, piece, last, before))
                    size[tuning] += len(piece)
                    if size[tuning] >= BLOCK_BYTES or len(waiting[tuning]) == BLOCK_TEXTS:
                        yield packed(tuning)
        for tuning in waiting:
            if waiting[tuning]:
                yield packed(tuning)

    out = docs.select("doc_id", "text", "fold", "number").mapInArrow(run, schema)
    return materialise(out.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


class Block:
    """Tokens of a block's texts as codes of n-grams.

    uni and bi have an entry for the token before each text as well, since that
    is a context; ``word`` are the places of the texts' own tokens in them.
    """

    def __init__(self, texts: list[bytes], last: list[bool], before: list[int], buckets: int):
        parts, sizes = [], []
        for i, (text, ends) in enumerate(zip(texts, last, strict=True)):
            words = token_hashes(text)
            parts += [np.array([x & (1 << 64) - 1 for x in before[2 * i : 2 * i + 2]], np.uint64), words]
            if ends:
                parts.append(np.array([_END]))
            sizes.append(len(words) + bool(ends))
        self.sizes = np.array(sizes, np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *parts])
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(self.sizes + 2) - self.sizes - 2, self.sizes + 2)
        one, two = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
        self.text = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.word = np.flatnonzero(place[one] > 1)
        mixed = _mix(tokens)
        pair = _mix(_mix(mixed[one - 1] + np.uint64(1)) + tokens[one])
        self.uni = _codes(mixed[one], buckets, UNIGRAM_BITS)
        self.bi = _codes(pair, buckets, LONGER_BITS)
        # The pair of the two tokens before a word is the entry before its own.
        self.tri = _codes(_mix(_mix(pair[self.word - 1] + np.uint64(3)) + tokens[two]), buckets, LONGER_BITS)

    @classmethod
    def of(cls, row: dict, buckets: int) -> Block:
        import zstandard

        data, cuts = zstandard.ZstdDecompressor().decompress(row["texts"]), np.concatenate([[0], np.cumsum(row["sizes"])]).tolist()
        return cls([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], row["last"], row["before"], buckets)

    def of_words(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, self.sizes)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """All codes of unigrams, and of longer n-grams (bi, then tri)."""
        return self.uni, np.concatenate([self.bi, self.tri])

    def weights(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """1 for each n-gram that counts: not those of held-out texts, and the tokens before a text only if it starts there."""
        counts = ~np.array(row["held_out"], bool)
        starts = np.array(row["before"], np.int64).reshape(-1, 2)[:, 1] == _START.astype(np.int64)
        each = counts[self.text].astype(float)
        head = np.setdiff1d(np.arange(len(self.text)), self.word)
        each[head] *= starts[self.text[head]]
        return each, np.concatenate([each, self.of_words(counts).astype(float)])


def block_rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


GRAMS = "block long, tuning boolean, bucket int, u binary, un binary, g binary, gn binary"


def block_grams(blocks: DataFrame, buckets: int) -> DataFrame:
    """Packed distinct n-grams per block and bucket with counts."""
    names = [c.split()[0] for c in GRAMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in block_rows(batch):
                yield from packed(row)

    def packed(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block.of(row, buckets)
        parts = []
        for codes, weights in zip(block.grams(), block.weights(row), strict=True):
            found, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at, weights, len(found)).astype("<u8")
            parts.append((found & np.uint64((1 << 48) - 1), n, np.searchsorted(found, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(48))))
        del block
        step = max(1, buckets // 16)
        for low in range(0, buckets, step):
            span = range(low, min(buckets, low + step))
            columns = [pa.array([row["block"]] * len(span), pa.int64()), pa.array([row["tuning"]] * len(span), pa.bool_()), pa.array(list(span), pa.int32())]
            for low48, n, cut in parts:
                columns.append(pa.array([pack_sorted(low48[cut[i] : cut[i + 1]]) for i in span], pa.binary()))
                columns.append(pa.array([pack_counts(n[cut[i] : cut[i + 1]]) for i in span], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.drop("doc_id", "number", "bytes").mapInArrow(run, GRAMS)


#: u and g: all training counts in the block's order; uo and go: those outside the tuning fold, for blocks of that fold.
TOTALS = "block long, tuning boolean, bucket int, u binary, g binary, uo binary, go binary, n_train long, v_train long, n_most long, v_most long"


def total_counts(grams: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts of each block's n-grams, in the block's order; n_ and v_ are the bucket's token and type numbers, on one of its rows."""
    names = [c.split()[0] for c in TOTALS.split(", ")]
    start = int(_codes(_mix(np.array([_START])), buckets, UNIGRAM_BITS)[0])

    def run(table: pa.Table) -> pa.Table:
        bucket, tuning = table.column("bucket")[0].as_py(), table.column("tuning").to_numpy()
        columns: dict[str, list] = {"u": [], "g": [], "uo": [], "go": []}
        sums = [0] * 4
        for c in ("u", "g"):
            codes = [unpack_sorted(x.as_py()) for x in table.column(c)]
            counts = [unpack_counts(x.as_py(), len(k)) for x, k in zip(table.column(c + "n"), codes, strict=True)]
            sizes = [len(k) for k in codes]
            found, at = np.unique(np.concatenate(codes), return_inverse=True)
            of_tuning = np.repeat(tuning, sizes)
            n = np.concatenate(counts)
            outside = np.bincount(at, n * ~of_tuning, len(found)).astype("<u8")
            every = outside + np.bincount(at, n * of_tuning, len(found)).astype("<u8")
            if c == "u":
                real = np.ones(len(found), bool)
                if start >> 48 == bucket:
                    real &= found != start & (1 << 48) - 1
                sums = [int(every[real].sum()), int((every[real] > 0).sum()), int(outside[real].sum()), int((outside[real] > 0).sum())]
            for place, is_tuning in zip(np.split(at, np.cumsum(sizes)[:-1]), tuning, strict=True):
                columns[c].append(pack_counts(every[place]))
                columns[c + "o"].append(pack_counts(outside[place]) if is_tuning else None)
        made = [table.column(c) for c in ("block", "tuning", "bucket")] + [pa.array(v, pa.binary()) for v in columns.values()]
        return pa.table(made + [pa.array([x] + [0] * (table.num_rows - 1), pa.int64()) for x in sums], names=names)

    return grams.groupBy("bucket").applyInArrow(run, TOTALS)


def bucket_number(spark: SparkSession, size: int) -> int:
    """Buckets for so many bytes of text."""
    return max(8, min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))))


def looked_up(block: Block, answers: pa.Table, uni: str, longer: str) -> tuple[np.ndarray, ...]:
    """Counts of the words' unigram, bigram and trigram, and of the one and two tokens before them."""
    order = np.argsort(answers.column("bucket").to_numpy())
    out = []
    for codes, column in zip(block.grams(), (uni, longer), strict=True):
        found, at = np.unique(codes, return_inverse=True)
        sizes = np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=len(order))
        total = np.concatenate([unpack_counts(answers.column(column)[int(i)].as_py(), n) for i, n in zip(order, sizes, strict=True)])
        out.append(total[at].astype(float))
    c1, c2, c3 = out[0], out[1][: len(block.bi)], out[1][len(block.bi) :]
    w = block.word
    return c1[w], c2[w], c3, c1[w - 1], c2[w - 1]


def context_bucket(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    level = lambda c: np.minimum(np.floor(np.log2(np.maximum(c, 1))) + 1, CONTEXT_BUCKETS - 1)
    return np.where(two > 0, CONTEXT_BUCKETS + level(two), np.where(one > 0, level(one), 0)).astype(np.int64)


def estimates(c1, c2, c3, one, two, n: int) -> list[np.ndarray]:
    return [c1 / max(n, 1), c2 / np.maximum(one, 1), c3 / np.maximum(two, 1)]


def probabilities(c1, c2, c3, one, two, n: int, v: int, weights: np.ndarray) -> np.ndarray:
    """The model's probability of tokens, by their counts and their contexts'."""
    w = weights[context_bucket(one, two)]
    return w[:, 0] / (v + 1) + sum(w[:, k + 1] * p for k, p in enumerate(estimates(c1, c2, c3, one, two, n)))


STATISTICS = "c int, b1 int, b2 int, b3 int, n long, l1 double, l2 double, l3 double"


def statistics(counts: tuple[np.ndarray, ...], n: int) -> pa.Table:
    """Binned statistics of tokens: context bucket, bin of each estimate, tokens, sums of the estimates' logs."""
    flat, logs = context_bucket(counts[3], counts[4]), []
    for p in estimates(*counts, n):
        low = np.log2(np.maximum(p, 2.0**-200))
        logs.append(np.where(p > 0, low, 0))
        flat = flat * BINS + np.where(p > 0, np.minimum(1 + np.floor(-low / BIN_OCTAVES), BINS - 1), 0).astype(np.int64)
    found, at = np.unique(flat, return_inverse=True)
    keys = [found // BINS**3, found // BINS**2 % BINS, found // BINS % BINS, found % BINS]
    values = [pa.array(k, pa.int32()) for k in keys] + [pa.array(np.bincount(at, minlength=len(found)), pa.int64())]
    return pa.table(values + [pa.array(np.bincount(at, x, len(found))) for x in logs], names=[c.split()[0] for c in STATISTICS.split(", ")])


def tuning_statistics(blocks: DataFrame, totals: DataFrame, buckets: int, n: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [statistics(looked_up(Block.of(row, buckets), right, "uo", "go"), n) for row in block_rows(left)]
        return pa.concat_tables(out)

    asked = blocks.where("tuning").drop("doc_id", "number", "bytes")
    each = asked.groupBy("block").cogroup(totals.where("tuning").select("block", "bucket", "uo", "go").groupBy("block")).applyInArrow(run, STATISTICS)
    return each.groupBy("c", "b1", "b2", "b3").agg(*[F.sum(c).alias(c) for c in ("n", "l1", "l2", "l3")])


def learn_weights(rows: list, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (uniform, unigram, bigram, trigram) of each context bucket by expectation-maximisation."""
    out = np.tile(np.array(DEFAULT_WEIGHTS), (2 * CONTEXT_BUCKETS, 1))
    by_context: dict[int, list] = {}
    for r in rows:
        by_context.setdefault(r["c"], []).append(r)
    for c, mine in by_context.items():
        n = np.array([r["n"] for r in mine], float)
        p = np.array([[1.0 / (v + 1), *(2.0 ** (r[f"l{k}"] / r["n"]) if r[f"b{k}"] else 0.0 for k in (1, 2, 3))] for r in mine])
        w = np.full(4, 1 / 4)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[:, None]).sum(0) / n.sum()
        out[c] = w
    # Contexts that were never seen have no estimate.
    out[:CONTEXT_BUCKETS, 3] = 0
    out[0, 2] = 0
    out[:, 0] = np.maximum(out[:, 0], LEAST)
    return out / out.sum(1, keepdims=True)


SCORES = "doc_id {}, number long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def block_scores(blocks: DataFrame, totals: DataFrame, buckets: int, n: int, v: int, weights: np.ndarray) -> DataFrame:
    """Sums of each piece of a text."""
    schema = SCORES.format(blocks.schema["doc_id"].dataType.elementType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, row in enumerate(block_rows(left)):
            block = Block.of(row, buckets)
            counts = looked_up(block, right, "u", "g")
            text = block.of_words(np.arange(len(block.sizes)))
            add = lambda x: np.bincount(text, x, len(block.sizes))  # noqa: B023, E731
            base = np.log10((counts[0] + 0.1) / (n + 0.1 * (v + 1)))
            out.append(
                pa.table(
                    [
                        left.column("doc_id")[i].values, pa.array(row["number"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(block.sizes),
                        pa.array(add(counts[0] > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(probabilities(*counts, n, v, weights)))),
                    ],
                    names=names,
                )
            )
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(totals.select("block", "bucket", "u", "g").groupBy("block")).applyInArrow(run, schema)


def lm_model(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int, int, np.ndarray]:
    """(blocks, totals, buckets, training tokens, training types, weights)."""
    fold = crc_bucket(F.col("doc_id"), FOLDS).cast("int").alias("fold")
    blocks = pack_blocks(docs.select("doc_id", "text", fold, F.monotonically_increasing_id().alias("number")))
    buckets = bucket_number(docs.sparkSession, blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    totals = materialise(total_counts(block_grams(blocks, buckets), buckets), "lm-counts")
    n, v, n_most, v_most = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "v_train", "n_most", "v_most")]).first()
    rows = tuning_statistics(blocks, totals, buckets, n_most).collect()
    return blocks, totals, buckets, n, v, learn_weights(rows, v_most)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Score every document."""
    blocks, totals, buckets, n, v, weights = lm_model(docs)
    pieces = block_scores(blocks, totals, buckets, n, v, weights)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = pieces.groupBy("number").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
