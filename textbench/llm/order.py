"""Running sums in a hashed order within groups, without a task per group.

A group's order starts with four hexadecimal digits, which cut it into pieces.
Sums per piece are aggregated first (a row per group, piece and task); the
window over them holds at most `PIECES` rows a group, and the window over rows
stays inside a piece. A group with a third of all rows thus spreads over
thousands of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.scratch import cut

PIECES = 4096


def piece_of(digest: Column, pieces: int = PIECES) -> Column:
    """Piece of an order, from the first four digits of its leading digest."""
    first = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    return F.floor(first * pieces / 65536)


def piece_sums(df: DataFrame, key: str, digest: str, sums: dict[str, Column]) -> DataFrame:
    """(key, _piece, _all_<name>…): sums per piece of each group, written once."""
    return cut(
        df.groupBy(key, piece_of(F.col(digest)).alias("_piece")).agg(
            *[F.coalesce(F.sum(value), F.lit(0)).alias(f"_all_{name}") for name, value in sums.items()]
        )
    )


def with_running_sums(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    sums: dict[str, Column],
    pieces: DataFrame,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Add per name in `sums` its sum over the rows before in the group.

    `order` starts with the digest column; `pieces` comes from `piece_sums`;
    `key` must not be null. Columns of `attach` (one row per key) are added on
    the way, through the small table of pieces. Rows that are equal in the
    order may come in any order; their sums are then interchangeable.
    """
    ahead = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        key,
        "_piece",
        *[F.coalesce(F.sum(f"_all_{n}").over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in sums],
    )
    if attach is not None:
        offsets = offsets.join(attach, key)
    inside = (
        Window.partitionBy(key, "_piece")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = df.withColumn("_piece", piece_of(F.col(order[0])))
    rows = rows.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(value).over(inside), F.lit(0)) for n, value in sums.items()}
    )
    out = rows.join(offsets, [key, "_piece"])
    out = out.withColumns({n: F.col(f"_ahead_{n}") + F.col(f"_in_{n}") for n in sums})
    return out.drop("_piece", *[f"_{p}_{n}" for n in sums for p in ("in", "ahead")])
