"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b: longs); label is the component's smallest node.

    Every round a node takes the smallest label around it and then that label's own label, so paths
    halve and the rounds grow with the logarithm of a component's diameter. Labels are written to
    the shared folder after each round.
    """
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = C.materialise(both.distinct(), "edges")
    labels = C.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in itertools.count():
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "m").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("label").alias("its"))
        after = C.materialise(lower.join(of, "low").select("node", F.col("label").alias("was"), F.least("low", "its").alias("label")), "labels")
        C.discard(labels)
        labels = after
        if labels.filter("label <> was").isEmpty():
            C.discard(both)
            return labels.select("node", "label")
