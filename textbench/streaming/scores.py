"""Incremental scoring of response files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textbench.functions.answers import parse_answers
from textbench.operators.score import detection_per_item, extraction_per_item
from textbench.sources.schemas import RESPONSE_ROW


def score_rows(responses: DataFrame) -> DataFrame:
    """Parse and score each response; no state, so batch and stream share it."""
    return extraction_per_item(detection_per_item(parse_answers(responses)))


def score_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: str = RESPONSE_ROW,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Score the response files that are new since the last call, once each.

    The checkpoint folder records the files read and the file sink commits each
    batch as a whole, so a restarted run neither skips nor repeats rows.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    scored = score_rows(reader.parquet(source))
    return (
        scored.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
