"""Alignment against a plain version with both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fixturelake.llm import align as A


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of_character():
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def plain(libraries, rows):
    a, b = libraries
    alphabet = byte_of_character()
    each, counts = [], Counter()
    for doc, text in rows:
        found = None
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
            piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
            bytes_b = [piece(b.id_to_piece(i)) for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                links, groups, i, j, at_a, at_b, mine = [], [], 0, 0, len(bytes_a[0]), len(bytes_b[0]), ([ids_a[0]], [ids_b[0]])
                while True:
                    links.append((ids_a[i], ids_b[j]))
                    end_a, end_b = at_a <= at_b, at_b <= at_a
                    if end_a and end_b:
                        groups.append(mine)
                        mine = ([], [])
                    i, j = i + end_a, j + end_b
                    if i == len(ids_a) and j == len(ids_b):
                        break
                    if end_a:
                        at_a += len(bytes_a[i])
                        mine[0].append(ids_a[i])
                    if end_b:
                        at_b += len(bytes_b[j])
                        mine[1].append(ids_b[j])
                counts.update(links)
                found = ids_a, ids_b, groups, links
        each.append((doc, found))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc, found in each:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            ids_a, ids_b, groups, links = found
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            sums = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
            out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), *sums, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(docs):
    import public_tokenizers as P

    return sorted((tuple(r) for r in A.align_tokenizers(docs, P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")).collect()), key=str)


def test_awkward_rows(spark, odd_docs, no_docs, libraries):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert ours(odd_docs) == plain(libraries, rows)
    assert ours(no_docs) == []


def random_text(rng):
    words = ["the", "Übung", "<|endoftext|>", "</s>", "<0x41>", "  ", "\n", "\t\t", "12345", "é", "中文", "😀", "▁", "don't", "...", "a\x00b", " ", "ﬁ", "x" * 40, "\r\n", "é"]
    return "".join(rng.choice([" ", "", "  "]) + rng.choice(words) for _ in range(rng.randrange(1, 30)))


@pytest.mark.parametrize("asking", [512, 1])
def test_random_texts(spark, libraries, monkeypatch, asking):
    for name, value in {"BLOCK_BYTES": 400, "WORK": 7, "BUCKET_PAIRS": 20, "TEXT_TOKENS": 9, "BLOCKS_ASKING": asking}.items():
        monkeypatch.setattr(A, name, value)
    rng = random.Random(11)
    rows = [(i, random_text(rng)) for i in range(300)]
    rows += rows[:20] + [(None, "null id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(docs) == plain(libraries, rows)


@pytest.mark.parametrize("work", [1, 2, 3, 5, 64, 10**6])
def test_merge_path(work):
    rng = np.random.default_rng(work)
    for n in (1, 2, 10, 300):
        a, b = (np.unique(np.append(rng.integers(1, 3 * n + 1, n), 3 * n)) for _ in range(2))
        cut_a, cut_b = A.diagonals(a, b, work)
        assert (np.diff(cut_a + cut_b)[:-1] == work).all() and cut_a[-1] == len(a) and cut_b[-1] == len(b)
        at_a, at_b, common_a, common_b = A.merge_ends(a, b, work)
        ends = np.union1d(a, b)
        assert sorted(zip(at_a.tolist(), at_b.tolist(), strict=True)) == list(zip(np.searchsorted(a, ends).tolist(), np.searchsorted(b, ends).tolist(), strict=True))
        assert a[common_a].tolist() == b[common_b].tolist() == np.intersect1d(a, b).tolist()


def test_groups_spell_the_text(spark, libraries):
    import public_tokenizers as P

    text = "Straße 😀 don't  stop\n\nhere <|endoftext|> naïve"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a▁b")], "doc_id long, text string")
    rows = A.token_groups(docs, P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")).orderBy("start").collect()
    assert {r.doc_id for r in rows} == {1} and rows[0].start == 0 and rows[-1].end == len((" " + text).encode())
    assert all(x.end == y.start for x, y in zip(rows, rows[1:], strict=False))
    assert [i for r in rows for i in r.a] == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert [i for r in rows for i in r.b] == libraries[1].encode(text)
