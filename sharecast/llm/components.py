"""Connected components of an edge table by repeated contraction.

In a round every edge goes to the tasks of both its ends, sorted by end, so a task
sees all edges of its vertices. It finds the components of what it sees, in chunks
of bounded size (the last vertex of a chunk is carried into the next), and writes
each vertex with the least vertex of its component there. Ahead of the shuffle, a task
shortens the edges that it reads in the same way (a map-side combine, in chunks of the
same size), so that fewer and shorter paths are dealt. Paths shrink to stars in a few
rounds; a round in which no task writes an edge that it has not been dealt is the
last. Every round is one shuffle and one written table, so a lost executor costs one
round at most, and one flag per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import drop_files, pin_table
from .common import ship_package

CHUNK_EDGES = 1_000_000


def least_vertices(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges and the least vertex of each one's component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)          # hook the roots of both ends
        np.minimum.at(new, label[v], low)
        while True:                                # and shorten the paths to them
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def shorten(batches):
    """Edges (two integer columns, in any order) to stars that connect the same vertices,
    a chunk at a time: each vertex with the least one of its component in the chunk. A
    vertex that has only a loop there keeps it."""
    import pyarrow as pa

    held, rows, names = [], 0, None

    def stars():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, least = least_vertices(a, b)
        linked = np.isin(nodes, np.concatenate((a[a != b], b[a != b])))
        keep = (nodes != least) | ~linked
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], names)

    for batch in batches:
        if batch.num_rows:
            names = batch.schema.names
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
        if rows >= CHUNK_EDGES:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def _round(batches):
    """(end, a, b) in the order of ends to (a, b, new) with b the least vertex that is
    seen to be connected with a; loops stay."""
    import pyarrow as pa

    held, rows, carry = [], 0, None

    def contract():
        end, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        if carry is not None:
            a, b = np.concatenate((a, [carry[0]])), np.concatenate((b, [carry[1]]))
        nodes, least = least_vertices(a, b)
        loop = np.unique(a[a == b])
        loop = loop[~np.isin(loop, np.concatenate((a[a != b], b[a != b])))]
        x, y = nodes[nodes != least], least[nodes != least]
        high, low = np.maximum(a, b), np.minimum(a, b)
        both = np.concatenate((np.stack((high, low)), np.stack((x, y))), axis=1)
        _, kind = np.unique(both, axis=1, return_inverse=True)
        kind = kind.ravel()
        new = ~np.isin(kind[len(a):], kind[:len(a)])
        made = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((x, loop))), pa.array(np.concatenate((y, loop))),
             pa.array(np.concatenate((new, np.zeros(len(loop), bool))))], ["a", "b", "new"])
        return (end[-1], least[np.searchsorted(nodes, end[-1])]), made

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
        if rows >= CHUNK_EDGES:
            carry, made = contract()
            yield made
            held, rows = [], 0
    if rows:
        yield contract()[1]


def connected_components(edges: DataFrame, a: str, b: str, *, shortened: bool = False) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.
    Edges with a null end are ignored; a loop makes a component of one. ``edges`` is
    read once; it may hold an edge any number of times, either way round. ``shortened``
    says that the tasks that make the edges have shortened them (a second Python worker
    beside theirs would gain nothing)."""
    spark = edges.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter(
        "a is not null and b is not null")
    path = None
    while True:
        if path or not shortened:
            now = now.mapInArrow(shorten, "a bigint, b bigint")
        ends = now.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("end"), "a", "b")
        dealt = ends.repartition(parts, "end").sortWithinPartitions("end")
        nxt, new_path = pin_table(dealt.mapInArrow(_round, "a bigint, b bigint, new boolean"), "edges", with_path=True)
        if path:
            drop_files(spark, path)
        now, path = nxt.select("a", "b"), new_path
        if not nxt.agg(F.coalesce(F.bool_or("new"), F.lit(False))).first()[0]:
            break
    # stars: every vertex with its root, and every root with itself
    both = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")),
                                        F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("e"))
    return both.select("e.node", "e.component").groupBy("node").agg(F.min("component").alias("component"))

