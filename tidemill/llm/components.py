"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged_at


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round gives a node the smallest label among itself and its neighbours,
    then replaces that label by the label's own label (pointer jumping), so the
    number of rounds grows with the logarithm of the longest path. Labels are
    aggregated map-side, so a node with very many links is no burden on one task.
    Rounds end at a table in shared storage. Nulls and self links are ignored;
    an empty edge table gives an empty result.
    """
    both = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct()
    )
    both, edges_at = staged_at(both, "edges")
    labels, labels_at = staged_at(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("u").alias("v"), "l"), "v")
            .select("u", "l")
            .unionByName(labels)
            .groupBy("u")
            .agg(F.min("l").alias("l"))
        )
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("j"))
        after, after_at = staged_at(
            near.join(jump, "l", "left").select("u", F.least("l", F.coalesce("j", "l")).alias("l")), "labels"
        )
        changed = after.alias("x").join(labels.alias("y"), F.expr("x.u = y.u and x.l <> y.l"), "left_semi")
        done = changed.isEmpty()
        discard(both.sparkSession, labels_at)
        if done:
            discard(both.sparkSession, edges_at)
            return after.select(F.col("u").alias("node"), F.col("l").alias("component"))
        labels, labels_at = after, after_at
