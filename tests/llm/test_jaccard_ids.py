"""Near copies among rows whose ids are null or repeated."""

from fixturelake.llm import jaccard


def test_unrelated_texts_without_an_id_or_under_one_id_stay(spark):
    text = lambda tag, n=40: " ".join(f"{tag}{i}" for i in range(n))
    near = text("c") + " end"
    rows = [(None, text("a")), (None, text("b")), (7, text("d")), (7, text("e")), (1, text("c")), (None, near), (None, text("f")), (None, text("f") + " end"), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each_group(docs).collect()), key=str)
    assert len(kept) == 6 and (1, text("c")) in kept and (None, near) not in kept
    assert {(None, text("a")), (None, text("b")), (7, text("d")), (7, text("e"))} < set(kept)
    assert sum(t.startswith("f0 ") for _, t in kept) == 1
    links = {(r["doc_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect()}
    assert links == {(None, 1), (None, 0), (7, 0), (1, 1)}
