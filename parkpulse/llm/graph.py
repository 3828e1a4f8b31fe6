"""Connected components of a graph of links, by joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.shared import written


def _contracted(links: DataFrame) -> DataFrame:
    """Links of each partition as stars: node, root. Keeps what is connected, shortens the paths."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = np.array(list(parent), np.int64)
        roots = np.array([root(x) for x in parent], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return links.select("a", "b").mapInArrow(run, "node bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest member), for every node of the links a, b (BIGINT).

    Each round takes the smallest label among a node and its neighbours, then the label's label, so
    rounds grow with the logarithm of the longest path. Labels are written each round: both sides
    of each join are plain tables, whose hot partitions adaptive execution can cut, and a lost
    executor costs no more than one round.
    """
    stars = written(_contracted(links).where("node <> root"))
    edges = written(
        stars.select(F.col("node").alias("from"), F.col("root").alias("to"))
        .union(stars.select(F.col("root").alias("from"), F.col("node").alias("to")))
        .distinct()
    )
    labels = written(edges.groupBy("from").agg(F.min("to").alias("least")).select(
        F.col("from").alias("node"), F.least("from", "least").alias("label")
    ))
    while True:
        near = edges.join(labels, edges["to"] == labels["node"]).select(F.col("from").alias("node"), "label")
        up = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node")).select("x.node", "y.label")
        least = near.union(up).union(labels).groupBy("node").agg(F.min("label").alias("label"))
        new = written(least)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
