"""SentencePiece encoding and decoding with a prefix table of last tokens.

Encoding follows the piece-merge rule of BPE models: of all adjacent pairs
whose concatenation is a piece, the best scored one merges first, the leftmost
on ties. Instead of merging, a table holds for every prefix of a segment the
one token that its encoding ends with. An automaton lists the pieces that end
at a position; a piece is the last token if it is compatible with the last
token of the prefix before it, that is, if the two encode to just themselves
when joined. The ids are then recovered from the table backwards. Pair tests
are remembered, so the work is linear in the text.

No piece continues from a visible character into a blank, so a text splits
exactly into segments (blanks, then visible characters). Encoded segments are
remembered up to a fixed number of entries per Python worker.

Scale: a narrow map over Arrow batches; no shuffle; per-worker memory is
bounded by ``MOST_SEGMENTS`` and ``MOST_PAIRS``.

Defined results: a null or empty text has the end id only; characters without
a piece become byte pieces; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_SEGMENTS = 1_500_000
MOST_PAIRS = 2_000_000
#: Segments of more characters are encoded, but not remembered.
LONGEST_KEPT = 48
BLANK = "▁"
_SEGMENT = re.compile(" +[^ ]*|[^ ]+")


class PieceModel:
    """Prefix-table encoder over the pieces and scores of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        if n > 0xD800:
            raise ValueError("ids must fit one UTF-16 unit")
        lib = self.library
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.id = {lib.id_to_piece(i): i for i in plain}
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece has a blank after a visible character")
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = lib.eos_id()
        self.length = [len(p) for p in self.piece]
        # Pieces that merging can reach; the others are never a result.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self._merged(p) == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.segments: dict[str, str] = {}

    def _merged(self, text: str) -> list[str]:
        """The merge rule itself; used on joined pairs and single pieces only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, first: int, second: int) -> bool:
        key = first << 16 | second
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            a, b = self.piece[first], self.piece[second]
            found = self.pairs[key] = self._merged(a + b) == [a, b]
        return found

    def _segment(self, text: str) -> str:
        """Ids of one segment as characters."""
        last = [-1] * (len(text) + 1)  # -1: no piece ends here, the character stands alone
        length, pairs, test = self.length, self.pairs, self._compatible
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            before = last[start]
            if before < 0:
                last[end] = token
            else:
                ok = pairs.get(before << 16 | token)
                if ok or ok is None and test(before, token):
                    last[end] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= length[token]
            else:
                at -= 1
                out.extend(self.byte[b] for b in reversed(text[at].encode("utf-8", "replace")))
        return "".join(map(chr, reversed(out)))

    def encode_to_text(self, text: str) -> str:
        """Ids of a whole text, each as the character of that number, without the end id."""
        if not text:
            return ""
        known, out = self.segments, []
        for segment in _SEGMENT.findall(" " + text.replace(BLANK, " ")):
            ids = known.get(segment)
            if ids is None:
                ids = self._segment(segment.replace(" ", BLANK))
                if len(segment) <= LONGEST_KEPT:
                    if len(known) >= MOST_SEGMENTS:
                        known.clear()
                    known[segment] = ids
            out.append(ids)
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_to_text(text).encode("utf-16-le"), "<u2").tolist()


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """One model per worker and path."""
    return PieceModel(path)


def encode_digests(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text, ids ending with the end id."""
    source = docs.select(key, "text")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        name = list(map(str, range(len(m.piece))))
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = m.encode(text.as_py() or "")
                ids.append(m.end)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(name.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(m.library.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """key and ids (array of int, ending with the end id) of every row."""
    source = docs.select(key, "text")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            ids = [m.encode(t.as_py() or "") + [m.end] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """key and text of every row of ids; null ids give an empty text."""
    source = encoded.select(key, "ids")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            texts = [m.library.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"`{key}` {kind}, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
