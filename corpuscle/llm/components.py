"""Connected components of an edge table through joins: no group of neighbours is ever gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, staged


class Forest(dict):
    """Union-find whose roots are the smallest members."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x], x = root, up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
            self.setdefault(min(a, b), min(a, b))
        return a != b


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of each batch of edges."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            forest.union(a, b)
        members = list(forest)
        out = pd.DataFrame({"a": members, "b": [forest.find(x) for x in members]}, dtype="int64")
        yield out[out["a"] != out["b"]]


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node of edges (a, b: long, not null). Direction, repeats and loops don't matter.

    Each round takes the smallest label among neighbours and then jumps to the label's label, so long paths halve.
    """
    spark = edges.sparkSession
    ship(spark)
    thin = edges.select("a", "b").mapInPandas(_thin, "a long, b long").distinct()
    both = staged(thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("new"), F.col("root").alias("up"))
        now = staged(stepped.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("root"), "old"), "labels")
        if now.filter("root <> old").isEmpty():
            return now.select("node", "root")
        labels = now.select("node", "root")
