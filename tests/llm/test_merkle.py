"""Manifest against a plain tree."""

import hashlib
import zlib

import pytest

from fixturelake.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root and, for each leaf, its list of (siblings left, siblings right) by level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            paths[i].append((level[k - 1] if k % 2 else "", level[k + 1] if k % 2 == 0 and k + 1 < len(level) else ""))
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], paths


def plain(rows):
    """Result rows of rows (doc_id, text, lang, source, n_chars)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(*map(enc, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    order = sorted(groups)
    each = []
    for g in order:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        each.append((mine, *tree([leaf(r) for r in mine])))
    root, tops = tree([e[1] for e in each])
    out = []
    for (mine, sub, paths), top in zip(each, tops, strict=True):
        for r, path in zip(mine, paths, strict=True):
            at = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for a, b in path + top:
                at = H(a, at, b)
            out.append((r[0], leaf(r), sub, root, H(*[x for ab in path + top for x in ab]), at, at == root))
    return sorted(out, key=str)


def ours(docs):
    return sorted((tuple(r) for r in M.verified(M.manifest(M.document_leaves(docs))).collect()), key=str)


def test_awkward_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_docs.collect()]
    assert ours(odd_docs) == plain(rows)
    assert ours(no_docs) == []


def test_groups_of_many_sizes_and_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 2)
    rows = [(i, f"t{i}", f"l{n}" if n else None, "s", i if i % 5 else None) for n, size in enumerate((33, 1, 2, 3, 16, 17)) for i in range(100 * n, 100 * n + size)]
    rows += [(5, "t5", None, "s", None)] * 4 + [(2**62, "é", "", None, 2**63 - 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = ours(docs)
    assert found == plain(rows)
    # Tampering is found wherever it changes the leaf, and nowhere else.
    changed = {r[0] for r in rows if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r[0] for r in found if not r[6]} == changed


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_one_group(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "'s' as source", "id as n_chars")
    rows = [(i, str(i), "en", "s", i) for i in range(n)]
    assert ours(docs) == plain(rows)
