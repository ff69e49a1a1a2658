"""Connected components of a graph given as a table of links, by least labels and pointer jumping.

Links that fit a task are gone through there, in one step; more are gone through by joins, a few for each step. Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release

#: Links that a task goes through by itself: 32 MB of digests.
HELD = 1 << 20


def components(links: DataFrame, most: int = 60, held: int = HELD) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); a component is named by its least node."""
    return in_a_task(links) if links.count() <= held else by_joins(links, most)


def in_a_task(links: DataFrame) -> DataFrame:
    """``components`` of links that one task can hold."""
    kind = links.schema["a"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        node = pc.unique(pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]))
        node = node.take(pc.sort_indices(node))
        label = least_labels(*(pc.index_in(c, node).to_numpy().astype(np.int64) for c in t.columns), len(node))
        for i in range(0, len(node), 100_000):
            own = node.slice(i, 100_000)
            yield pa.record_batch([own, node.take(pa.array(label[i : i + len(own)]))], names=["node", "component"])

    return cut(links.sparkSession, links.select("a", "b").coalesce(1).mapInArrow(find, f"node {kind}, component {kind}"))


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that links (a, b) lead to, for each of the numbers below n."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # Roots are hung below lesser roots, so labels only fall, and then every node below its root.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def by_joins(links: DataFrame, most: int = 60) -> DataFrame:
    """``components`` of any number of links.

    All joins are by sort and merge: labels grow with the data. Each step takes the least label among the neighbours (a sum-like aggregate, so a node with many links is no hot
    task) and then the label of the label. Steps are cut with a checkpoint; they end when nothing changes.
    """
    spark = links.sparkSession
    both = cut(spark, links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for step_no in range(most):
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.hint("merge"), labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("n"), F.col("c").alias("cc"))
        new = cut(spark, step.join(jump.hint("merge"), step["c"] == jump["n"], "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), "was"))
        moved = not new.where("component <> was").isEmpty()
        labels = new.select("node", "component")
        if step_no % 2:
            release(spark)
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def joined(found: DataFrame, more: DataFrame, links: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """Components like ``found`` once the links ``more`` are there, too; only the components that they meet are gone through.

    ``links``, if given, are all links, ``more`` among them: where they fit a task, they are gone through again, which takes no join.
    """
    if links is not None and links.count() <= held:
        return in_a_task(links)
    spark = found.sparkSession
    label = lambda c: F.coalesce(f"{c}_of", c).alias(c)
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = more.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left").select(label("a"), label("b")).where("a <> b").distinct()
    top = components(cut(spark, between), held=held).select(F.col("node").alias("component"), F.col("component").alias("top"))
    alone = top.join(found.select("component").distinct().hint("merge"), "component", "left_anti").select(F.col("component").alias("node"), "component")
    every = found.select("node", "component").unionAll(alone)
    return cut(spark, every.join(top.hint("merge"), "component", "left").select("node", F.coalesce("top", "component").alias("component")))
