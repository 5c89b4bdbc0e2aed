"""Texts meet their bitmaps by one kind of join, whatever the number of bitmaps."""

from fixturelake.llm import lines


def test_few_bitmaps_are_joined_like_many(spark):
    text = "a line that is long enough to be counted as a key of forty\n"
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(20)], "doc_id long, text string")
    out = lines.with_bitmaps(docs, lines.line_bitmaps(docs))
    assert sum(r["keep"] is not None for r in out.collect()) == 19
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [doc_id" not in plan
