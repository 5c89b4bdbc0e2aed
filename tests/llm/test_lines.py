"""Line dedup against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fixturelake.llm import lines as L

LONG = "A line that is well over forty characters long, number {}"


def plain(rows, least=L.LEAST, fewest=L.FEWEST):
    """Rows (doc_id, n_lines, n_dropped, text) of rows (doc_id, text)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add((doc is not None, doc))
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        gone = lambda x: len(held.get(key(x), ())) >= fewest and max(held[key(x)]) != (doc is not None, doc)  # noqa: B023, E731
        kept = [x for x in all_lines if not gone(x)]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def ours(spark, rows, parts=8, **more):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, line string, keep string, n_lines int")
        return sorted((tuple(r) for r in L.dedup_lines(docs, **more).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_awkward_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in L.dedup_lines(odd_docs).collect()), key=str) == plain(rows)
    assert L.dedup_lines(no_docs).count() == 0


def test_hot_line_ties_and_null_ids(spark):
    shared, edge, below = LONG.format("shared"), "x" * 40, "x" * 39
    rows = [(i, f"{shared}\nown text of document {i} that is longer than forty characters\n\t{shared.upper()} ") for i in range(300)]
    rows += [(None, f"{shared}\n{edge}")] * 3 + [(i, f"{edge}\n{below}\n{edge}") for i in (7, 8, 9, 9)] + [(400, "é" * 39 + "\n" + "é" * 40)] * 2
    rows += [(500 + i, "é" * 40 + "\n\n" + "É" * 40) for i in range(4)] + [(600, None), (601, ""), (602, "\n")]
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, rows, parts=64) == plain(rows)
    assert ours(spark, rows, fewest=2) == plain(rows, fewest=2)


def test_very_long_text_of_lines(spark):
    rows = [(1, "\n".join(LONG.format(i % 5000) for i in range(60_000)))] + [(i, LONG.format(17) + "\n" + LONG.format(i)) for i in range(2, 9)]
    assert ours(spark, rows) == plain(rows)


@pytest.mark.parametrize("most_held", [0, 2, 1000])
def test_stream_over_cut_ranges(most_held):
    """Any cut of the sorted rows into ranges and batches gives the same decisions."""
    rng = random.Random(5)
    rows = sorted(
        {(bytes([rng.choice([1, 1, 1, 2, 3, 4, 5])]), rng.choice([None, *range(8)]), rng.randrange(3)) for _ in range(150)},
        key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]),
    )
    docs = defaultdict(list)
    for line, doc, _ in rows:
        docs[line].append(-1 if doc is None else doc)
    want = {r for r in rows if len(set(docs[r[0]])) >= 5 and (-1 if r[1] is None else r[1]) != max(docs[r[0]])}
    schema = pa.schema([("line", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32()))])
    for _ in range(60):
        cuts = sorted(rng.sample(range(len(rows)), rng.randrange(6)))
        found, opened, seen = set(), [], defaultdict(set)
        for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            stream, at = L.FirstOccurrences(5, most_held), low
            made = []
            while at < high:
                to = min(high, at + rng.randrange(1, 40))
                part = rows[at:to]
                made += stream.batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*part), [1] * len(part), [[r[2]] for r in part]], schema)], schema=schema))
                at = to
            made += stream.end(schema if high > low else None)
            place = low
            for b in made:
                for r in b.to_pylist():
                    if r["kind"] == L.SEEN:
                        seen[r["line"]].add(-1 if r["doc_id"] is None else r["doc_id"])
                    elif r["kind"] == L.OPEN:
                        opened.append((r["line"], r["doc_id"], r["text_key"]))
                    else:
                        found.add((r["doc_id"], r["text_key"]))
            assert place == low
        found |= {r[1:] for r in opened if len(seen[r[0]]) >= 5 and (-1 if r[1] is None else r[1]) != max(seen[r[0]])}
        assert found == {r[1:] for r in want}


def test_bitmap_round_trip():
    for n in (1, 7, 8, 9, 1000):
        gone = np.arange(0, n, 3)
        keep = L.unpack_keep(L.pack_keep(n, gone), n)
        assert len(keep) == n and not keep[gone].any() and keep.sum() == n - len(gone)
