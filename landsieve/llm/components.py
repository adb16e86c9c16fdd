"""Connected components of a graph by hooking and pointer jumping, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


class Forest:
    """Union-find inside one task, for the nodes of one bounded block."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        parent = self.parent
        root = node
        while (up := parent.get(root, root)) != root:
            root = up
        while node != root:
            parent[node], node = root, parent.get(node, node)
        return root

    def join(self, a: int, b: int) -> bool:
        """Unite two nodes; false if they were together already."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def connected_components(store: Store, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks
    to their ends by doubling, and replaces the ends of every link by them; links inside a tree go.
    The rounds are logarithmic in practice. Minima are partially aggregated and labels are joined
    on a unique right side, so a hub costs no more than its links, which adaptive joins can split.
    """
    links = store.write(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        hooks = ends.groupBy("node").agg(F.min("other").alias("other"))
        hooks = store.write(hooks.select("node", F.least("node", "other").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved"))
            higher = store.write(higher, "hooks")
            hooks = higher.select("node", "root")
            if higher.filter("moved").isEmpty():
                break
        at_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        at_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        links = links.join(at_a, "a").join(at_b, "b").filter("root_a <> root_b")
        links = store.write(links.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
        if labels is None:
            labels = hooks
        else:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = store.write(labels.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
