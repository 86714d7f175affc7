"""Comparing the entries of long posting lists piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired_pieces(
    postings: DataFrame, keys: list[str], salt: Column, limit: int, attach: DataFrame | None = None
) -> DataFrame:
    """Entries once for each pair of pieces of their list; lists of one entry are gone.

    Adds _mine, _i and _j. Lists are cut into pieces of about `limit` entries by
    `salt`, a hash; two entries meet in the pair of their pieces, and only there.
    Rows are dealt by the keys and the pair and sorted by them and _id. Columns of `attach` (one
    row per _id) join the entries that are left.
    """
    sizes = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut_up = postings.join(sizes, keys).withColumn("_many", F.ceil(F.col("_n") / limit).cast("int"))
    pairs = (
        cut_up.withColumn("_mine", F.pmod(salt, F.col("_many")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)))
        .withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")})
        .drop("_n", "_many", "_other")
    )
    if attach is not None:
        pairs = pairs.join(attach, "_id")
    by = [*keys, "_i", "_j"]
    return pairs.repartition(*by).sortWithinPartitions(*by, "_id")


def runs_of(
    batches: Iterator[pa.RecordBatch],
    keys: list[str],
    solve: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """Call `solve(batch, starts)` on whole runs of equal keys of a sorted stream.

    A run that spans batches is held back until it is whole; `starts` has the
    first row of each run and the end of the last.
    """
    kept: pa.RecordBatch | None = None

    def starts_of(batch):
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for name in keys:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            new |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]])

    for batch in batches:
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        starts = starts_of(batch)[:-1]
        kept = batch.slice(int(starts[-1]))
        if starts[-1]:
            yield solve(batch, starts)
    if kept is not None and kept.num_rows:
        yield solve(kept, np.array([0, kept.num_rows]))
