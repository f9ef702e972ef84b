"""Connected components of link tables, without gathering any of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored

#: Edges of one task, about: 4 MB. More edges are more tasks.
EDGES = 1 << 18


def _least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes but the least of each component of these edges, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while len(a):
        least = np.minimum(top[a], top[b])
        np.minimum.at(top, top[a], least)
        np.minimum.at(top, top[b], least)
        while (top != top[top]).any():
            top = top[top]
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
    own = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[own], nodes[top[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: those of a task become stars."""

    def of(batches):
        u, v, size = [], [], 0
        for b in batches:
            u.append(b.column(0).to_numpy())
            v.append(b.column(1).to_numpy())
            size += b.num_rows
            if size >= 4 * EDGES:  # a task much larger than planned keeps its stars only
                x, y = _least_nodes(np.concatenate(u), np.concatenate(v))
                u, v, size = [x], [y], len(x)
                if size >= 2 * EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                    u, v, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least_nodes(np.concatenate(u), np.concatenate(v))], ["u", "v"])

    return edges.mapInArrow(of, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (least node of the component) of every node in ``links`` (a, b).

    Tasks of about EDGES edges first turn their own edges into stars; where one such task holds them all, that is the result.
    Then alternating large and small stars; each step aggregates minima with map-side
    combine and joins them back by key, so a node of any degree is no group in one
    task (a hub's rows in that join are split by Spark's skew handling).  Steps are cut by tables in the
    shared folder; they end when all edges form stars.  Links with a null end are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(_contracted(edges), "edges")
    tasks = -(-edges.count() // EDGES)
    if tasks > 1:
        past, edges = edges, stored(edges.distinct(), "edges")
        drop(past)
    else:
        past, edges = edges, stored(_contracted(edges.coalesce(1)), "edges")
        drop(past)
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large, past = stored(large, "edges"), edges
        drop(past)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c"))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = stored(small, "edges")
        drop(large)
        roots = edges.select(F.col("v").alias("r"), F.lit(1).alias("is_root")).distinct()
        ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(roots, F.col("u") == F.col("r"), "left")
        if ends.filter("n > 1 or is_root is not null").isEmpty():  # every node has one root, and no root has one
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
