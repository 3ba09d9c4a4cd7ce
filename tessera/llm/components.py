"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _least(edges: DataFrame, name: str) -> DataFrame:
    """The least neighbour m of each a, written, so that a hub's join can be broadcast or split."""
    return materialise(edges.groupBy("a").agg(F.min("b").alias("m")), name)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    Only columns of ids move, each round is written to the shared folder, and
    no component is ever gathered in one place. Null ids and loops are ignored,
    repeated edges count once, and no edges give no rows. The rounds grow with
    the logarithm of the longest path; should ``max_rounds`` not do, it raises.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e = materialise(e, "edges")
    seen = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "large-star")
        large = materialise(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "edges")
        lower = _least(large, "small-star")
        small, before = large.join(lower, "a"), e
        e = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        e = materialise(e, "edges")
        for done in (least, large, lower, before):
            discard(done)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
