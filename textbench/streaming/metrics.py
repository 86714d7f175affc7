"""Detection metrics that follow a stream of answers, retries included.

State is kept by experiment and stretch of positions: the outcome and the turn of
the newest answer at each position. A retry takes the place of what it repeats, so counts
change and never double. A stretch has `STRETCH` positions, so an experiment with a third of all
answers spreads over many tasks and a stretch's state has a bounded size.

Each micro-batch writes the counts of the stretches it changed under its own number,
again if it is repeated; `current_metrics` adds up the newest counts of all stretches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textbench.functions.answers import parse_answers
from textbench.operators.score import OUTCOMES, detection_per_item, detection_rates

STRETCH = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestOutcomes(StatefulProcessor):
    """Counts of the newest outcome at each position of a stretch.

    Rows have slot (position in the stretch), turn and code (1 to 4, see OUTCOMES). The higher turn
    counts; of equal turns the one that came last, and in one batch the higher code.
    """

    def __init__(self, by: Sequence[str]):
        self.by = list(by)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "codes binary, turns binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            codes, turns = (np.frombuffer(x, t).copy() for x, t in zip(self.state.get(), (np.uint8, np.int64)))
        else:
            codes, turns = np.zeros(STRETCH, np.uint8), np.full(STRETCH, np.iinfo(np.int64).min)
        # Batches of one key may split a position, so all rows of the micro-batch are ordered together.
        new = pd.concat(list(rows)).sort_values(["slot", "turn", "code"]).groupby("slot").tail(1)
        slot, turn = new["slot"].to_numpy(), new["turn"].to_numpy()
        newer = turn >= turns[slot]
        codes[slot[newer]] = new["code"].to_numpy()[newer]
        turns[slot[newer]] = turn[newer]
        self.state.update((codes.tobytes(), turns.tobytes()))
        found = np.bincount(codes, minlength=len(OUTCOMES) + 1)[1:]
        row = dict(zip([*self.by, "stretch"], key)) | dict(zip(OUTCOMES, map(int, found)))
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def metrics_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    by: Sequence[str],
    schema: str,
    turn: str = "run_ts",
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Follow the response files of `source`; `current_metrics(target)` has the metrics after each batch.

    `schema` has `by`, ord, error_flag, content and the `turn` column: a number, or a run stamp
    (digits and an underscore) that orders repeated answers. Null turns come first.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    scored = detection_per_item(parse_answers(reader.parquet(source)))
    code = F.array_position(F.array(*[F.lit(x) for x in OUTCOMES]), F.col("outcome")).cast("int")
    order = F.regexp_replace(F.col(turn).cast("string"), "[^0-9]", "").try_cast("bigint")
    rows = scored.select(
        *by,
        F.floor(F.col("ord") / STRETCH).cast("bigint").alias("stretch"),
        F.pmod(F.col("ord"), F.lit(STRETCH)).cast("int").alias("slot"),
        F.coalesce(order, F.lit(-1)).alias("turn"),
        code.alias("code"),
    )
    kinds = dict(rows.dtypes)
    out = ", ".join([*[f"{k} {kinds[k]}" for k in [*by, "stretch"]], *[f"{x} long" for x in OUTCOMES]])
    counts = rows.groupBy(*by, "stretch").transformWithStateInPandas(NewestOutcomes(by), out, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        # A batch that is repeated replaces its own folder.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = counts.writeStream.foreachBatch(write).outputMode("update")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def current_metrics(spark: SparkSession, target: str, by: Sequence[str], up_to: int | None = None) -> DataFrame:
    """(by…, tp … f1) after the last batch, or after batch `up_to`."""
    parts = spark.read.parquet(target)
    if up_to is not None:
        parts = parts.where(F.col("batch") <= up_to)
    newest = parts.groupBy(*by, "stretch").agg(F.max_by(F.struct(*OUTCOMES), "batch").alias("_counts"))
    summed = newest.groupBy(*by).agg(*[F.sum(f"_counts.{x}").alias(x) for x in OUTCOMES])
    return detection_rates(summed.withColumn("n", sum((F.col(x) for x in OUTCOMES[1:]), F.col(OUTCOMES[0]))))
