"""Quality scores of documents whose labels are left out, and of copies."""

import pytest
from pyspark.sql import functions as F

from fixturelake.llm import quality


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_left_out_good_documents_are_kept(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    got = quality.quality(docs, labels.where(fold != 0)).join(labels.where(fold == 0), "doc_id").where(~F.col("base_failed"))
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.03 * (n.get((1, True), 0) + n.get((1, False), 0)), n


def test_unlabelled_copies_do_not_lower_their_own_score(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").dropDuplicates(["text"])
    first = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    one = min(i for i in good if i in first and first[i]["kept"])
    others = labels.where(F.col("doc_id") != one)
    alone = {r["doc_id"]: (r["score"], r["kept"]) for r in quality.quality(docs, others).collect()}
    copies = docs.where(F.col("doc_id") == one).select(F.explode(F.sequence(F.lit(10**9), F.lit(10**9 + 450))).alias("doc_id"), "text")
    many = {r["doc_id"]: (r["score"], r["kept"]) for r in quality.quality(docs.unionByName(copies), others).collect()}
    assert alone[one][1] and len(bad) and {i: v for i, v in many.items() if i < 10**9} == alone
    assert {v for i, v in many.items() if i >= 10**9} == {alone[one]}
