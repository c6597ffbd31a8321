"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.skew import join_hot
from signflow.session import discard, materialize, ship

#: Nodes up to which the labels (16 bytes each) are broadcast.
BROADCAST_NODES = 200_000
#: Links (16 bytes each) that one task finishes.
SMALL = 100_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links held in memory, and each one's smallest node reached."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b], a, b):  # the labels' own nodes too
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(links: DataFrame) -> DataFrame:
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in labelled(t.column("a").to_numpy(), t.column("b").to_numpy())], ["node", "component"])

    return links.repartition(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, broadcast_nodes: int = BROADCAST_NODES, small: int = SMALL) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b: bigint).

    Up to ``small`` links are finished in one task. Beyond, each round takes the smallest label among the neighbours and then the label's own label, so labels travel
    twice as far as in the round before. Up to ``broadcast_nodes`` labels are broadcast; beyond, neighbours and
    labels are looked up by joins in which nodes of many edges and labels of many nodes are split off as hot.
    Every round's labels are written, which cuts lineage; those of the round before are deleted.
    """
    spark = edges.sparkSession
    kept = edges.where("a <> b").select("a", "b")
    both, both_path = materialize(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    if both.count() <= 2 * small:
        found, _ = materialize(_in_one_task(both.where("a < b")), "labels")
        discard(spark, both_path)
        return found
    labels, path = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component"), F.count("*").alias("degree")).withColumnRenamed("a", "node"), "labels")
    n = labels.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges")).first()
    small = n["nodes"] <= broadcast_nodes
    while True:
        around = labels.select(F.col("node").alias("b"), F.col("component").alias("label"), "degree")
        met = both.join(F.broadcast(around.drop("degree")), "b") if small else join_hot(both, around, ["b"], "degree", n["edges"])
        near = met.groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", "component", "degree", F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        if small:
            moved = lower.join(F.broadcast(jump), "new")
        else:
            lower, lower_path = materialize(lower, "lower")
            sizes = lower.groupBy("new").agg(F.count("*").alias("size"))
            moved = join_hot(lower, sizes.join(jump, "new"), ["new"], "size", n["nodes"])
        moved = moved.select("node", F.least("new", "next").alias("component"), "degree", (F.least("new", "next") != F.col("component")).alias("moved"))
        moved, new_path = materialize(moved, "labels")
        changed = moved.agg(F.bool_or("moved")).first()[0]
        discard(spark, path, *([] if small else [lower_path]))
        labels, path = moved, new_path
        if not changed:
            break
    discard(spark, both_path)
    return labels.select("node", "component")
