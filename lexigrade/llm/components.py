"""Connected components by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrade.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): for each end of an edge the smallest node it reaches.

    ``edges`` has long columns u and v; direction, order and repetition don't matter.
    Labels only fall.  A round takes the least label among neighbours, then the label
    of that label, so paths halve; rounds end when nothing changes.  Each round's
    labels are written to the shared folder, which cuts lineage.  No edge or label
    reaches the driver, only the count of changes.
    """
    spark = edges.sparkSession
    ends = scratch.save(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "ends")
    labels = scratch.save(ends.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels0")
    turn = 0
    while True:
        near = ends.join(labels, ends.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        least = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        up = labels.select(F.col("node").alias("now"), F.col("component").alias("above"))
        step = least.join(up, "now").select("node", "was", F.least("now", "above").alias("component"))
        turn += 1
        step = scratch.save(step, f"labels{turn}")
        if step.where("was <> component").isEmpty():
            scratch.drop(f"labels{turn - 1}", "ends")
            return spark.read.schema(step.schema).parquet(scratch.paths[f"labels{turn}"]).select("node", "component")
        scratch.drop(f"labels{turn - 1}")
        labels = step.select("node", "component")
