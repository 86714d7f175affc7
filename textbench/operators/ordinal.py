"""Positions in a global or grouped order without a one-task window.

`Window.orderBy` without a partition, or with a hot group, sends that whole
order through one task. Here the order is cut into bounded pieces first; rows
are numbered inside a piece and pieces carry the count of what precedes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.session import shared_dir

# A piece holds at most this many distinct numbers, a stretch as many pieces.
# Numbers should be dense: with gaps, pieces hold fewer rows and counts shrink less.
PIECE = 1 << 16


def piece_of(order: Column) -> Column:
    return F.shiftright(order, 16)


def piece_offsets(df: DataFrame, order: str, within: Sequence[str] = ()) -> DataFrame:
    """(within…, _piece, _rows, _before): rows per piece and rows before it.

    Counting is pre-aggregated in each task, so a hot group costs as many rows
    as it has pieces. The running sum has two levels: inside a stretch of
    65,536 pieces, and over the few stretches.
    """
    within = list(within)
    pieces = (
        df.groupBy(*within, piece_of(F.col(order)).alias("_piece"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_stretch", F.shiftright("_piece", 16))
    )
    # One row per 2**32 numbers: this window stays tiny even where `within` is empty.
    stretches = (
        pieces.groupBy(*within, "_stretch")
        .agg(F.sum("_rows").alias("_sum"))
        .withColumn(
            "_ahead",
            F.coalesce(
                F.sum("_sum").over(
                    Window.partitionBy(*within)
                    .orderBy("_stretch")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(*within, "_stretch")
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        pieces.join(stretches, [*within, "_stretch"])
        .withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .select(*within, "_piece", "_rows", "_before")
    )


def with_position(
    df: DataFrame, order: str, name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based position by a whole number that is unique within its group."""
    within = list(within)
    offsets = piece_offsets(df, order, within).drop("_rows")
    inside = Window.partitionBy(*within, "_piece").orderBy(order)
    return (
        df.withColumn("_piece", piece_of(F.col(order)))
        .withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*within, "_piece"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_piece", "_inside", "_before")
    )


def with_sorted_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based position under any total order.

    Rows are range-partitioned and sorted by the order and numbered in their
    partition, then written to the checkpoint folder, so that their numbers stay
    as they are whatever happens to an executor. Only one count per partition is
    summed up and joined back.
    """
    spark = df.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint()
    )
    # The number holds the partition in its high bits and the row in the low 33.
    part = F.shiftright("_id", 33)
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # At most one row per shuffle partition.
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before")
    )
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + inside)
        .drop("_part", "_id", "_before")
    )
