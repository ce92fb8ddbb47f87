"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.corpus import written

MOST_ROUNDS = 60


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours on the smallest of them.

    ``larger``: every node's larger neighbours go to its smallest neighbour (or itself). Otherwise its
    smaller neighbours, and itself, do. Connectivity stays as it is.
    """
    if larger:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:  # every edge as its larger end sees it
        around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if larger:
        hung = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        hung = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return hung.where("a < b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge table; ``root`` is the smallest node of its component.

    Large and small stars alternate until the edges are stars around roots, which takes a logarithmic
    number of rounds. Each round is written to the shared folder. Edges to oneself and repeated or NULL
    ends do no harm; such nodes have no row unless another edge has them. No edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(
        edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges"
    )
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = written(_star(_star(now, larger=True), larger=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
