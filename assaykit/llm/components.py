"""Connected components of an edge table, by alternating large and small stars.

Each round every node hands its larger neighbours, then its smaller ones, to its smallest neighbour;
after O(log^2 n) rounds each component is a star around its smallest node. Edges are written to the shared folder
after each round, so lineage stays short and a lost executor costs one round at most; the round before is removed. A hub's
rows are read through ``common.lookup`` and don't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import discard, lookup, written


def _to_smallest(pairs: DataFrame, n_rows: int) -> DataFrame:
    """(a, b, m): m the smallest of a and all b's of a."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_"))
    out = lookup(pairs, "a", least, "m", "n_", n_rows, F.col("b"))
    return out.withColumn("m", F.least("a", "m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long, not null); component is the smallest
    node reachable. Loops and repeated edges do no harm; an empty table gives an empty one."""
    directed = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(directed, "edges")
    last = None
    for _ in range(max_rounds):
        n, total = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if n == 0 or (n, total) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
        last = (n, total)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small = _to_smallest(large, n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        before, now = now, written(small.filter("a <> b").distinct(), "edges")
        discard(before)
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
