"""Sinks: partitioned Parquet, one row per response or prediction.

Rows are written in commits (`commits`): a repeated or failed job leaves each row once, and
`commits.read_committed` reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.reasoning import redact_keys
from textbench.sources.commits import commit_tables
from textbench.sources.schemas import EXPERIMENT


def clustered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a key together in as many tasks as its bytes need.

    Without it every task writes a file for each key it meets. Adaptive execution splits
    keys whose shuffled bytes pass `spark.sql.adaptive.advisoryPartitionSizeInBytes`, also those of
    equal rows, and joins small ones; without it a key is one task's.
    """
    return df.hint("rebalance", *[F.col(k) for k in by])


def write_responses(
    responses: DataFrame,
    path: str,
    secrets: Sequence[str] = (),
    config_columns: Sequence[str] = (),
    by: Sequence[str] = tuple(EXPERIMENT),
    commit: str | None = None,
) -> str:
    """Write responses by experiment with secret keys taken out of JSON columns, as table `responses`."""
    clean = responses.withColumns({c: redact_keys(F.col(c), secrets) for c in config_columns})
    return commit_tables({"responses": clustered(clean, by)}, path, by, commit)


def write_predictions(
    predictions: DataFrame,
    metrics: DataFrame,
    path: str,
    by: Sequence[str] = tuple(EXPERIMENT),
    commit: str | None = None,
) -> str:
    """Write parsed predictions (`samples`) and the long metric table (`metrics`) in one commit."""
    tables = {"samples": clustered(predictions, by), "metrics": clustered(metrics, by)}
    return commit_tables(tables, path, by, commit)


def split_write(df: DataFrame, path: str, by: Sequence[str] = ("split",)) -> None:
    """One pass over the rows, one folder per split (and model or experiment).

    Folders that get rows are replaced as the job commits, others stay, so writing twice
    leaves each row once; the result is plain Parquet.
    """
    writer = clustered(df, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def drop_null_fields(*columns: str) -> Column:
    """The row as JSON without its null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def write_json_rows(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Rows as JSON lines without null fields."""
    df.write.mode("append").option("ignoreNullFields", "true").partitionBy(*by).json(path)


def write_json_arrays(rows: DataFrame, path: str, file: str = "file", order: str = "ord", json: str = "json") -> None:
    """One JSON array per value of `file`, below `path`, of its rows in their order.

    A file is written by one task, row by row; how many rows share a file is the
    caller's choice.
    """
    inside = Window.partitionBy(file).orderBy(order)
    first, last = F.lag(order).over(inside).isNull(), F.lead(order).over(inside).isNull()
    line = F.concat(F.when(first, "[").otherwise(","), json, F.when(last, "]").otherwise(""))
    rows.select(file, line.alias("value")).write.partitionBy(file).text(path)
