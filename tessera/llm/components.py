"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, few_tasks


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node that can be reached) for the nodes of ``edges`` (``a, b``, longs).

    Labels go along edges and then jump to their label's label, so the rounds are few even for long chains;
    every round is written to the shared checkpoint folder. Repeated edges and edges from a node to itself change
    nothing; without edges there are no nodes. An edge with a null end is left out. Edges are counted first: give
    a table, not a long plan.
    """
    edges = edges.where("a is not null and b is not null")
    most = 2 * edges.count()  # nodes are no more either
    links = cut(few_tasks(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), most))
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = cut(few_tasks(labels.withColumn("moved", F.lit(True)), most))
    while not labels.where("moved").isEmpty():
        seen = links.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        best = seen.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        best = best.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        labels = cut(few_tasks(best.select("node", "label", (F.col("label") < F.col("old")).alias("moved")), most))
    return labels.select("node", "label")
