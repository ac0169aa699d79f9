"""Connected components: distributed union-find.

Each task first joins what its own edges join, by union-find with path halving, and keeps a star for each of its
components. Large-star and small-star steps then bring together what different tasks hold: each is an aggregation and an
equi-join, so no node's neighbours are ever gathered in one place, and the minimum of a hot node is pre-aggregated before
the shuffle. Every round is written to the shared folder, which cuts the lineage, and the round before it is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import freed, written

#: Nodes a task holds in its union-find before it hands its stars on and starts afresh.
HELD_NODES = 1_000_000


def _stars(parent: dict) -> tuple[list, list]:
    """(node, root) of all nodes that are not their own root."""
    nodes, roots = [], []
    for x in parent:
        r = x
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        if r != x:
            nodes.append(x)
            roots.append(r)
    return nodes, roots


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    kinds = None
    for batch in batches:
        kinds = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for z in (x, y):
                r = parent.setdefault(z, z)
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                if z is x:
                    left = r
            if left != r:
                low, high = (left, r) if left < r else (r, left)
                parent[high] = low
        if len(parent) > HELD_NODES:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(_stars(parent))], kinds.names)
            parent = {}
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(_stars(parent))], kinds.names)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or none and is a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    tangled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
    return tangled.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node of the component. A node whose only edge
    is to itself has no row of its own; nulls are no nodes."""
    kind = edges.schema["a"].dataType.simpleString()
    apart = edges.filter("a != b").select("a", "b")
    now = written(apart.mapInArrow(_joined_in_task, f"a {kind}, b {kind}"), "edges")
    while not _are_stars(now):
        before, now = now, written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        freed(before)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
