"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut
from gridloom.shipping import ship

MOST_IN_ONE_TASK = 500_000  # links; beyond, they stay distributed


def components(links: DataFrame, native: bool = False) -> DataFrame:
    """From links (a, b): node and root, its component's smallest node, for every node that has a link and
    is not itself the root.

    A table of at most ``MOST_IN_ONE_TASK`` links is worked through by one task (its size is counted first);
    a larger one by alternating large and small stars: each round is two joins on a node, tables are written
    between them, so that a node with very many links is split, and the number of rounds grows with the
    logarithm of the nodes. native: no Python in either way."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), few=True)
    state = _state(edges)
    if state[0] <= MOST_IN_ONE_TASK and not native:
        ship(links.sparkSession)
        return cut(edges.coalesce(1).mapInPandas(_joined, "node bigint, root bigint"), edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), edges, least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        every = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), large, least)
        before, state = state, _state(edges)
        if before == state:
            break
    return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), edges)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            up[max(x, y)] = up[min(x, y)] = min(x, y)
    nodes = [x for x in up if find(x) != x]
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([find(x) for x in nodes], dtype="int64")})


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.bit_xor(F.xxhash64(mixed, F.lit(1)))).first())
