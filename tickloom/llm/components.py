"""Connected components of a graph of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tidy

#: Links that a task joins at once.
JOINED = 1 << 18


def _forest(links: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Links from each node of the given ones to the least node that these join it with."""
    a, b = (pa.concat_arrays([x.column(k) for x in links]) for k in range(2))
    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = (pc.index_in(x, value_set=nodes).to_numpy() for x in (a, b))
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        for side in (a, b, before[a], before[b]):
            np.minimum.at(label, side, low)
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(joined)), nodes.take(pa.array(label[joined]))], ["a", "b"])


@tidy
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the same nodes, by so many of a task at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= JOINED:
            yield _forest(held)
            held = []
    if sum(x.num_rows for x in held):
        yield _forest(held)


def _settled(links: DataFrame) -> bool:
    """Whether each node that links to a smaller one has one link, to a node that links to no smaller one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return open_.agg(F.count(F.lit(1))).first()[0] == 0


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours (the larger ones, or the smaller ones and itself) to the least node around it. For the larger ones the least are written first,
    so that nothing but shuffles stands below the join, and adaptive execution can split a node with very many links."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "links-least")
        new = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every link goes from the larger node a to the smaller node b
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        new = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    return new.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component. links: (a, b) without nulls.

    Stars double what a node reaches, so rounds grow with the logarithm of a component's width; before each, every task joins the links that it reads. Each round is
    written to the shared folder, and there is none once all links go straight to the smallest nodes.
    No links give an empty result; repeated links and links of a node with itself change nothing.
    """
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    while not _settled(links):
        links = stage(links.mapInArrow(_joined, links.schema), "links-joined")
        links = stage(_star(_star(links, True), False), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
