"""Line dedup by range-partitioned hashes and a stream of first occurrences.

Texts are split at newlines. A line's key is the line without blanks
``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased. Keys of ``least`` code
points or more that ``fewest`` documents hold lose all their lines, except those
of the largest document that holds them.

Shape of the job. A narrow pass sends one row per document and distinct long
key: a 128-bit hash, the document and the key's positions, never the line. These
rows are dealt by ranges of (hash, document, position) and sorted within each
range, largest document first, so a line that a third of all documents hold is
spread over many tasks. A stream over each range ranks the documents of a hash:
the first keeps its lines, and from the ``fewest``-th on all others lose theirs.
Only the ranks before that wait, at most ``MOST_HELD`` rows; where a range begins
or ends inside a hash, or more rows wait, those few rows are sent on as open and
settled against the documents that each range saw of that hash. Decisions come
back as one compressed bitmap per document that loses a line. Texts move once,
when bitmaps are applied to them.

Two lines count as equal when their 128-bit BLAKE2 hashes are.

Defined results: a null or empty text is one empty line; a null id is one
document, below all others; rows of one id are one document, and where it is the
largest all its lines stay; repeated rows get the same bitmap; an empty table
gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelake.llm.common import materialise

LEAST, FEWEST = 40, 5
#: Rows of one hash that a task holds back before its decision.
MOST_HELD = 50_000
#: Rows (document, text) that a task remembers, so that repeated rows are sent once.
MOST_SEEN = 100_000
BLANKS = b" \t\n\x0b\x0c\r"
DROP, OPEN, SEEN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_keys(text: bytes, least: int = LEAST) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the positions of each hash of a key of at least ``least`` code points."""
    lines, found = text.split(b"\n"), {}
    for at, line in enumerate(lines):
        if len(line) >= least:
            key = line_key(line)
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
    return len(lines), found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def occurrences(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document and long key: line (hash), doc_id, text_key, n_lines, positions."""
    source = _keyed(docs)
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            row, line, total, places = [], [], [], []
            texts = batch.column(2).cast(pa.binary())
            for r, (doc, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (doc, key) in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add((doc, key))
                n, found = long_keys(texts[r].as_py() or b"", least)
                row += [r] * len(found)
                total += [n] * len(found)
                line += found.keys()
                places += found.values()
            at = pa.array(row, pa.int64())
            columns = [pa.array(line, pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(total, pa.int32()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "doc_id", "text_key", "n_lines", "positions"])

    return source.mapInArrow(run, f"line binary, doc_id {kind}, text_key long, n_lines int, positions array<int>")


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one before it; ``before`` precedes the first, None if nothing does."""
    if not len(column):
        return np.zeros(0, bool)
    ahead = pa.concat_arrays([pa.array([None if before is None else before.as_py()], column.type), column.slice(0, len(column) - 1)])
    equal = pc.fill_null(pc.equal(column, ahead), False)
    both_null = pc.and_(pc.is_null(column), pc.is_null(ahead))
    out = ~pc.or_(equal, both_null).to_numpy(zero_copy_only=False)
    if before is None:
        out[0] = True
    return out


class FirstOccurrences:
    """Decisions over one sorted range of rows (line, doc_id, text_key, n_lines, positions), batch by batch."""

    def __init__(self, fewest: int, most_held: int = MOST_HELD):
        self.fewest, self.most_held = max(2, fewest), most_held
        self.last: list | None = None  # line, doc_id and text_key of the row before

    def batch(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        before = [None] * 3 if self.last is None else [pa.scalar(v, rows.column(i).type) for i, v in enumerate(self.last)]
        new_line = _changes(rows.column(0), before[0])
        new_doc = new_line | _changes(rows.column(1), before[1])
        new_row = new_doc | _changes(rows.column(2), before[2])
        cuts = np.flatnonzero(new_line)
        if self.last is None:  # the range's first line may have begun in the range before
            self._start(is_open=True)
            cuts = cuts[1:]
        self.last = [rows.column(i)[rows.num_rows - 1].as_py() for i in range(3)]
        ends = [*cuts.tolist(), rows.num_rows]
        yield from self._more(rows, new_doc, new_row, 0, ends[0])
        if len(cuts):
            yield from self._close(rows.schema)
            yield from self._whole(rows, new_doc, new_row, cuts)
            self._start(is_open=False)
            yield from self._more(rows, new_doc, new_row, ends[-2], ends[-1])

    def _start(self, is_open: bool) -> None:
        self.open, self.rank, self.line = is_open, 0, None
        self.documents: list = []  # the first ones of the line
        self.held: list[pa.RecordBatch] = []

    def _more(self, rows: pa.RecordBatch, new_doc: np.ndarray, new_row: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Rows of the current line."""
        if low == high:
            return
        self.line = rows.column(0)[low].as_py()
        rank = self.rank + np.cumsum(new_doc[low:high])
        self.rank = int(rank[-1])
        for at in np.flatnonzero(new_doc[low:high])[: self.fewest - len(self.documents)]:
            self.documents.append(rows.column(1)[low + int(at)].as_py())
        part = rows.slice(low, high - low)
        yield from _kind(DROP, part, new_row[low:high] & (rank >= self.fewest))
        wait = new_row[low:high] & (rank < self.fewest) & (self.open | (rank >= 2))
        if wait.any():
            self.held.append(part.filter(pa.array(wait)))
        if not self.open and self.rank >= self.fewest:
            yield from (x for held in self.held for x in _kind(DROP, held))
            self.held = []
        elif self.open or sum(x.num_rows for x in self.held) > self.most_held:
            yield from (x for held in self.held for x in _kind(OPEN, held))
            self.held, self.open = [], True

    def _whole(self, rows: pa.RecordBatch, new_doc: np.ndarray, new_row: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lines that begin and end in this batch."""
        low, high = int(cuts[0]), int(cuts[-1])
        if low == high:
            return
        size, count = np.diff(cuts), np.cumsum(new_doc[low:high])
        rank = count - np.repeat(count[cuts[:-1] - low] - 1, size)
        documents = np.repeat(rank[cuts[1:] - low - 1], size)
        yield from _kind(DROP, rows.slice(low, high - low), new_row[low:high] & (rank >= 2) & (documents >= self.fewest))

    def _close(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The current line ends inside the range: few documents keep what waits, but open rows need the documents seen."""
        if self.open:
            yield from self._seen(schema)

    def _seen(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = len(self.documents)
        first = [pa.array([self.line] * n, schema.field(0).type), pa.array(self.documents, schema.field(1).type)]
        yield from _kind(SEEN, pa.RecordBatch.from_arrays(first + [pa.nulls(n, f.type) for f in list(schema)[2:]], schema=schema))

    def end(self, schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
        """The range ends; its last line may go on in the next."""
        if schema is not None:
            yield from (x for held in self.held for x in _kind(OPEN, held))
            yield from self._seen(schema)


def _kind(kind: int, rows: pa.RecordBatch, where: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    if where is not None:
        if not where.any():
            return
        rows = rows.filter(pa.array(where))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind), pa.int32()), *rows.columns], names=["kind", *rows.schema.names])


def decisions(found: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """Rows (doc_id, text_key, n_lines, positions) whose lines are dropped; found is a stored table of occurrences."""
    order = [F.asc("line"), F.desc_nulls_last("doc_id"), F.asc("text_key"), F.asc(F.get("positions", F.lit(0)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, schema = FirstOccurrences(fewest), None
        for batch in batches:
            if batch.num_rows:
                schema = batch.schema
                yield from stream.batch(batch)
        yield from stream.end(schema)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    marked = materialise(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "kind int, " + kinds), "line-marks")
    # At most ``fewest`` rows for each end of a range, and for each MOST_HELD rows that waited.
    number = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    seen = marked.where(F.col("kind") == SEEN).groupBy("line").agg(number.alias("documents"), F.max("doc_id").alias("largest"))
    settled = marked.where(F.col("kind") == OPEN).join(seen.where(F.col("documents") >= fewest), "line").where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    columns = ["doc_id", "text_key", "n_lines", "positions"]
    return marked.where(F.col("kind") == DROP).select(*columns).unionByName(settled.select(*columns))


def pack_keep(n: int, dropped: np.ndarray) -> bytes:
    """Compressed bitmap of n lines, 1 for those that stay."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_keep(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, least: int = LEAST, fewest: int = FEWEST) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) of every text that loses a line; text_key is xxhash64 of the text."""
    found = materialise(occurrences(docs, least), "lines")
    each = decisions(found, fewest).groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("dropped"))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped = [x.values.to_numpy() for x in batch.column(3)]
            keep = [pack_keep(n, x) for n, x in zip(batch.column(2).to_pylist(), dropped, strict=True)]
            columns = [*batch.columns[:2], batch.column(2).cast(pa.int64()), pa.array([len(x) for x in dropped], pa.int64()), pa.array(keep, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    return each.mapInArrow(run, f"doc_id {kind}, text_key long, n_lines long, n_dropped long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text and keep of every document; keep is null where all lines stay."""
    at = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "keep")
    d = _keyed(docs)
    # Always merged: a broadcast of few bitmaps would end at some size and texts would move from there on only.
    return d.join(at.hint("merge"), d["doc_id"].eqNullSafe(F.col("_doc")) & (d["text_key"] == F.col("_key")), "left").select("doc_id", "text", "keep")


def _kept(text: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text of the others)."""
    if keep is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    stay = unpack_keep(keep, len(lines))
    return len(lines), int(len(lines) - stay.sum()), b"\n".join([x for x, s in zip(lines, stay.tolist(), strict=True) if s])


def _map_kept(rows: DataFrame, schema: str, digest: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t.as_py() or b"", k.as_py()) for t, k in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True)]
            counts = [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)]
            last = [hashlib.sha256(x[2]).hexdigest() for x in out] if digest else [x[2].decode() for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(last, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = LEAST, fewest: int = FEWEST) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without its dropped lines, of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map_kept(with_bitmaps(docs, line_bitmaps(docs, least, fewest)), f"doc_id {kind}, n_lines long, n_dropped long, text string", False)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and a digest of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map_kept(with_bitmaps(docs, line_bitmaps(docs)), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string", True)
