"""Connected components of links between many nodes, without hot keys.

A node with many links would send them all to one task. So the links of each task are first joined
there (union-find over a bounded number of nodes at a time), and each group found leaves as a tree
in which a node has at most FAN children. Then labels spread by least label and pointer jumping,
each round written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import discard, written

FAN = 16
MOST_NODES = 200_000


class Groups(dict):
    """Union-find over hashable, ordered nodes: node -> parent."""

    def root(self, node):
        parent = self.setdefault(node, node)
        while parent != self[parent]:
            self[node] = self[parent]
            node, parent = self[node], self[self[node]]
        return parent

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)

    def trees(self) -> tuple[list, list]:
        """Links that hold each group together: the sorted members as a heap of FAN children."""
        groups: dict = {}
        for node in list(self):
            groups.setdefault(self.root(node), []).append(node)
        one, two = [], []
        for members in groups.values():
            members.sort()
            one += [members[(i - 1) // FAN] for i in range(1, len(members))]
            two += members[1:]
        return one, two


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components, none of whose nodes has many in one task."""
    kind = edges.schema["a"].dataType

    def run(batches):
        import pyarrow as pa

        groups = Groups()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                groups.join(a, b)
            if len(groups) > MOST_NODES:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("a").type) for x in groups.trees()], names=["a", "b"])
                groups = Groups()
        one, two = groups.trees()
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(one, batch.schema.field("a").type), pa.array(two, batch.schema.field("a").type)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component for each node of ``edges`` (a, b); no nulls."""
    thin = written(thinned(edges), "links")
    both = thin.union(thin.select("b", "a")).where("a <> b")
    last = now = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = both.join(now.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("least"))
        lower = now.join(seen, "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("label").alias("far"))
        lowest = F.coalesce(F.least("next", "far"), "next")
        new = written(lower.join(jump, "next", "left").select("node", lowest.alias("label"), (F.col("label") != lowest).alias("moved")), "labels")
        discard(last)
        last, now = new, new.select("node", "label")
        if new.where("moved").isEmpty():
            discard(thin)
            return now
