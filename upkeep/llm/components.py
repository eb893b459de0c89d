"""Connected components of an undirected graph as DataFrame jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import drop_shared, shared_table


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component, for every node on an edge.

    ``edges`` has two bigint columns ``u`` and ``v``; loops, repeated edges
    and either direction are allowed, nulls are not.  Returns ``node, comp``;
    no edges, no rows.

    Each round points every node at the smallest node next to it, follows the
    pointers to their ends, and contracts: the ends of every edge are replaced
    by those, loops go and equal edges become one.  So the list that the next
    round joins has no more edges than there are left between different
    contracted nodes, however many edges a group began with.  A table of the
    original nodes follows along.  All tables lie in the shared folder, the
    minima are combined before they are shuffled, and only a yes or no a round
    reaches the driver.
    """
    edges = shared_table(_contracted(edges.select("u", "v")), "edges")
    labels = None
    while not edges.isEmpty():
        up = _to_the_ends(shared_table(_smallest_near(edges), "pointers"))
        at = up.select(F.col("node").alias("at"), F.col("up").alias("to"))
        if labels is None:
            moved = up.select("node", F.col("up").alias("comp"))
        else:
            moved = (labels.join(at, labels.comp == F.col("at"), "left")
                     .select("node", F.coalesce("to", "comp").alias("comp")))
        moved = shared_table(moved, "labels")
        left = (edges.join(at, edges.u == F.col("at")).select(F.col("to").alias("u"), "v")
                .join(at, F.col("v") == F.col("at")).select("u", F.col("to").alias("v")))
        left = shared_table(_contracted(left), "edges")
        drop_shared(edges, up, *([labels] if labels is not None else []))
        edges, labels = left, moved
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    drop_shared(edges)
    # The contracted nodes are members of their components, not always the smallest ones.
    least = labels.groupBy("comp").agg(F.min("node").alias("least")).withColumnRenamed("comp", "of")
    named = shared_table(labels.join(least, labels.comp == least["of"]).select("node", F.col("least").alias("comp")),
                         "components")
    drop_shared(labels)
    return named


def _contracted(edges: DataFrame) -> DataFrame:
    """Each edge once, larger node first, without loops."""
    return (edges.where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _smallest_near(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
    return near.select("node", F.least("node", "near").alias("up"))


def _to_the_ends(pointers: DataFrame) -> DataFrame:
    """Pointers followed until they no longer move; each step doubles the way."""
    while True:
        above = pointers.select(F.col("node").alias("at"), F.col("up").alias("above"))
        followed = shared_table(
            pointers.join(above, pointers.up == F.col("at"))
                    .select("node", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved")),
            "pointers")
        drop_shared(pointers)
        if followed.where("moved").isEmpty():
            return followed
        pointers = followed


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for the edges (i, j) of one task."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label[label], label):
            label = label[label]
