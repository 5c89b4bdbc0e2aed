"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.llm.common import discard, materialise


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id reachable.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, so long chains shrink by about half a round.
    Labels are written to the shared folder after each round and those of the
    round before are deleted. Both sides of each join on a node of high degree
    are stored tables, so the engine can split it; minima are combined before
    the shuffle.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    stored = labels
    for _ in range(most_rounds):
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        new = materialise(
            step.join(jump, "to").select("id", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("old")).alias("moved")),
            "labels",
        )
        discard(stored)
        stored, labels = new, new.select("id", "component")
        if not new.where("moved").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
