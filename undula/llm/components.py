"""Connected components of a distributed edge list: every round links each node and its neighbours to their minimum, after a contraction within tasks.

Nothing is collected: labels live in tables, lineage is cut by writing each round to the shared folder, and a node's neighbours are only ever aggregated to
their minimum, so a hub is pre-aggregated like any key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import materialize


#: Edges that one task contracts (16 bytes each); the more a task sees, the fewer rounds it takes.
PER_TASK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that the edges a-b touch, and the smallest node that it is connected to."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        left = label[x] != label[y]
        x, y = x[left], y[left]
    return nodes, nodes[label]


def _local(batches):
    """The edges of a partition become stars."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column("a").to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column("b").to_numpy(zero_copy_only=False)])
        if len(a) > 1 << 20:
            b, a = forest(a, b)
            a, b = a[a != b], b[a != b]
    if len(a):
        node, root = forest(a, b)
        own = node != root
        yield pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(node[own])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b: long). Edges may repeat, point either way, or be loops."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    e = materialize(e.distinct())  # no contraction yet: edges come from Python, and two Python nodes of one stage are two workers for each task
    tasks = max(1, -(-e.count() // PER_TASK))
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("low"))
        new = both.join(low, "a").select("low", "b").unionByName(low.select("low", F.col("a").alias("b"))).filter("low < b").select(F.col("low").alias("a"), "b")
        e = materialize(new.coalesce(tasks).mapInArrow(_local, "a long, b long"))  # an edge may be left in two tasks; each round that makes it again drops its repeats
        # done when no node has two roots and no root is below another
        ends = e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")))
        loose = ends.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").limit(1).count()
        if not loose:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")))
    return ends.distinct()
