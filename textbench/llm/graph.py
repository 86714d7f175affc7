"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.scratch import cut


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 64) -> DataFrame:
    """(node, component): each node with the smallest node it is joined to.

    `edges` holds whole numbers; order, repeats and loops do not matter. A
    component's smallest node and nodes without an edge to another are left out. Each round aggregates minima
    (partial sums first, so a hot node costs a row per task) and joins them
    back on the node, a join that adaptive execution may split. Rounds are
    about the logarithm of the longest path; each is written to the shared
    checkpoint folder. Nothing but a count and a checksum reaches the driver.
    """
    both = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    now = cut(
        both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    )
    seen = _sum(now)
    if not seen[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        # Large star: every larger neighbour is tied to the smallest one.
        turned = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = turned.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            turned.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # Small star: the node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        after = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = cut(after)
        last, seen = seen, _sum(now)
        if last == seen:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    raise RuntimeError("components did not settle")
