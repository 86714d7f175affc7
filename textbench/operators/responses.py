"""Collecting responses: grids, prompts through a responder, retries, merging."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textbench.functions import text as T
from textbench.operators.ordinal import piece_of
from textbench.operators.score import count_where
from textbench.session import scratch_path

RUN_STAMP = "yyyyMMdd_HHmmss"


def experiment_grid(models: DataFrame, **dimensions: Sequence[str]) -> DataFrame:
    """Every model with every value of the listed dimensions (datasets, templates)."""
    grid = models
    for name, values in dimensions.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


# --- which run counts -------------------------------------------------------


def latest_run(
    runs: DataFrame, by: Sequence[str], rule: str = "stamp", mtime: str = "modified"
) -> DataFrame:
    """Rows of the newest run of each experiment.

    Rules: `stamp` takes only valid 15-character stamps, `underscore` names with
    one `_`, `name` any name, `mtime` the latest file time.
    """
    stamp = F.col("run_ts")
    valid = {
        "stamp": (F.length(stamp) == 15) & F.try_to_timestamp(stamp, F.lit(RUN_STAMP)).isNotNull(),
        "underscore": F.size(F.split(stamp, "_")) == 2,
        "name": stamp.isNotNull(),
        "mtime": F.col(mtime).isNotNull() if rule == "mtime" else F.lit(True),
    }[rule]
    order = F.struct(mtime, "run_ts") if rule == "mtime" else stamp
    # Pre-aggregated in each task; one row per experiment remains.
    newest = runs.where(valid).groupBy(*by).agg(F.max_by("run_ts", order).alias("run_ts"))
    return runs.join(newest, [*by, "run_ts"], "left_semi")


# --- failures and retries ---------------------------------------------------


def failed(df_prefix: str = "") -> Column:
    return T.is_failed_response(F.col(f"{df_prefix}content"), F.col(f"{df_prefix}error"))


def incomplete_work(latest: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per experiment: responses, failed ones, and whether anything is left to do."""
    counts = latest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"), count_where(failed()).alias("failed")
    )
    status = F.when(F.col("failed") > 0, "partially_completed").otherwise("completed")
    return counts.withColumn("status", status)


def pending_samples(items: DataFrame, responses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Items without a successful response: failed ones and those never tried.

    `items` hold one row per experiment and position.
    """
    done = responses.where(~failed()).select(*by, "ord")
    return items.join(done, [*by, "ord"], "left_anti")


def merge_responses(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """A new response takes the place of the old one at its position."""
    keys = [*by, "ord"]
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    # A union and an aggregate keep null keys together, which a join would not.
    both = a.withColumnRenamed("_old", "_row").withColumn("_turn", F.lit(0)).unionByName(
        b.withColumnRenamed("_new", "_row").withColumn("_turn", F.lit(1))
    )
    kept = both.groupBy(*keys).agg(F.max_by("_row", "_turn").alias("_kept"))
    return kept.select(*keys, "_kept.*")


def failure_streaks(responses: DataFrame, by: Sequence[str], is_failed: Column) -> DataFrame:
    """(by…, stops_at): position of the second of the first two failures in a row.

    The order of an experiment is cut into pieces. Each piece looks back inside
    itself; its first row looks at the last row of the piece before.
    """
    by = list(by)
    rows = responses.select(*by, "ord", is_failed.alias("_failed")).withColumn(
        "_piece", piece_of(F.col("ord"))
    )
    inside = Window.partitionBy(*by, "_piece").orderBy("ord")
    looked = rows.withColumn("_previous", F.lag("_failed").over(inside))
    pieces = looked.groupBy(*by, "_piece").agg(
        F.min(F.when(F.col("_failed") & F.col("_previous"), F.col("ord"))).alias("_met"),
        F.min("ord").alias("_first"),
        F.min_by("_failed", "ord").alias("_first_failed"),
        F.max_by("_failed", "ord").alias("_last_failed"),
    )
    over_pieces = Window.partitionBy(*by).orderBy("_piece")
    edge = F.col("_first_failed") & F.coalesce(
        F.lag("_last_failed").over(over_pieces), F.lit(False)
    )
    joined = pieces.withColumn("_edge", F.when(edge, F.col("_first")))
    return (
        joined.groupBy(*by)
        .agg(F.least(F.min("_met"), F.min("_edge")).alias("stops_at"))
        .where(F.col("stops_at").isNotNull())
    )


# --- running a responder ----------------------------------------------------

Responder = Callable[[list[dict]], list[dict]]


def by_model(loaders: Mapping[str, Callable[[], Responder]]) -> Callable[[], Responder]:
    """A loader whose responder passes each row to that of its `model`."""

    def load() -> Responder:
        loaded: dict[str, Responder] = {}

        def respond(rows: list[dict]) -> list[dict]:
            answers: list[dict | None] = [None] * len(rows)
            for model in dict.fromkeys(row["model"] for row in rows):
                if model not in loaded:
                    loaded[model] = loaders[model]()
                own = [k for k, row in enumerate(rows) if row["model"] == model]
                for k, answer in zip(own, _answers(loaded[model], [rows[k] for k in own])):
                    answers[k] = answer
            return answers

        return respond

    return load


def _answers(respond: Responder, rows: list[dict]) -> list[dict]:
    """One answer per row; rows of a batch that fails are asked one by one."""
    try:
        answers = list(respond(rows))
        if len(answers) != len(rows):
            raise ValueError(f"{len(answers)} answers to {len(rows)} prompts")
        return [a if isinstance(a, dict) else {"error": f"no answer: {a!r}"} for a in answers]
    except Exception as problem:  # a service may raise anything
        if len(rows) == 1:
            return [{"error": str(problem) or type(problem).__name__}]
    return [answer for row in rows for answer in _answers(respond, [row])]


def _kept(token: str, load: Callable[[], Responder]) -> Responder:
    """The worker's responder of a token; a worker holds one at a time.

    Functions reach a worker by value, task by task, so what outlives a task is
    held by a module of the worker's own.
    """
    holder = sys.modules.setdefault("_textbench_worker", types.ModuleType("_textbench_worker"))
    if getattr(holder, "token", None) != token:
        holder.token = holder.respond = None
        holder.respond = load()
        holder.token = token
    return holder.respond


def apply_responder(
    prompts: DataFrame, load: Callable[[], Responder], keys: Sequence[str], token: str | None = None
) -> DataFrame:
    """(keys…, content, reasoning, error) of a responder over prompt rows.

    `load` runs once per Python worker, which keeps what it returned for later
    tasks of the same `token` (one per call unless given). It returns
    respond(batch), which takes row dicts and gives dicts with `content`, `reasoning` and `error`. When a batch
    raises or gets a wrong number of answers its rows are asked one by one, and
    those that fail are recorded as failed; the job goes on.
    """
    keys, token = list(keys), token or uuid.uuid4().hex
    answer = [Ty.StructField(n, Ty.StringType()) for n in ("content", "reasoning", "error")]
    schema = Ty.StructType([prompts.schema[k] for k in keys] + answer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        respond = _kept(token, load)
        for batch in batches:
            answers = _answers(respond, batch.to_dict("records"))
            out = batch[keys].copy()
            for field in answer:
                out[field.name] = [a.get(field.name) for a in answers]
            yield out

    return prompts.mapInPandas(run, schema)


def latest_answers(rounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The answer of the last round at each key, from appended rounds with a `_round`."""
    values = [c for c in rounds.columns if c not in (*keys, "_round")]
    last = rounds.groupBy(*keys).agg(F.max_by(F.struct(*values), "_round").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def resume_rounds(
    spark: SparkSession,
    prompts: DataFrame,
    load: Callable[[], Responder],
    by: Sequence[str],
    rounds: int,
    existing: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """Ask for pending rows up to `rounds` times; returns responses and rounds used.

    `existing` holds the responses of an earlier run: what it answered is not
    asked again. Every round appends its answers to the shared folder, so a
    lost executor never makes the responder run again for rows already
    answered, and the latest answer of a row counts.
    """
    keys, token = [*by, "ord"], uuid.uuid4().hex
    path = scratch_path(spark, "responses")
    blank = apply_responder(prompts.limit(0), load, keys)
    before = blank if existing is None else existing.select(*blank.columns)
    before.withColumn("_round", F.lit(0)).write.parquet(path)

    def merged() -> DataFrame:
        return latest_answers(spark.read.parquet(path), keys)

    used = 0
    for used in range(1, rounds + 1):
        todo = pending_samples(prompts, merged(), by)
        answered = apply_responder(todo, load, keys, token).withColumn("_round", F.lit(used))
        # Written aside first: a round reads the folder that it adds to.
        fresh = scratch_path(spark, "answers")
        answered.write.parquet(fresh)
        spark.read.parquet(fresh).write.mode("append").parquet(path)
        if pending_samples(prompts, merged(), by).isEmpty():
            break
    return merged(), used
