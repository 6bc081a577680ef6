"""Connected components by distributed union-find: hook every node to its least neighbour, shorten paths, contract."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _forest(batches):
    """Union-find over the edges of one task: of its edges only a spanning star per local group goes on."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = np.array([x for x in parent if find(x) != x], np.int64)
    roots = np.array([parent[x] for x in nodes.tolist()], np.int64)
    for at in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(roots[at : at + 50_000]), pa.array(nodes[at : at + 50_000])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the least node of its group.

    Each round joins and aggregates by node with partial sums, so a node with very many edges is no single
    task's work, and the driver sees one count a round. Self loops and repeated edges do no harm; edges with a
    null end are left out; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a != b").select("a", "b")
    edges = stage(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    levels = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        hooked = stage(hooked.select("node", F.least("node", "least").alias("up")), "hooked")
        shorter = hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
        level = stage(shorter.select("node", F.col("top").alias("up")), "level")
        levels.append(level)
        left = edges.join(level.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        left = left.join(level.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").where("ua != ub")
        edges = stage(left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[0].select("node", F.col("up").alias("component"))
    for level in levels[1:]:
        out = out.join(level.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return stage(out, "components") if len(levels) > 1 else out
