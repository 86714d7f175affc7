"""The two whole flows: score a set of experiments, and build a benchmark.

Each step that later steps read more than once is written to the shared folder
and read back, so nothing is computed twice and a lost executor costs no more
than its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.functions import synthesis
from textbench.functions.answers import parse_answers
from textbench.functions.verdicts import parse_judgments
from textbench.operators import curate, prompts, responses, score, train
from textbench.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def evaluate(
    items: DataFrame,
    templates: Mapping[str, tuple[str, str]],
    responders: Mapping[str, Callable[[], responses.Responder]],
    values: Mapping[str, Column],
) -> DataFrame:
    """Items under every template and responder, parsed: one row per answer.

    `responders` maps a model name to a loader as `apply_responder` takes it.
    """
    named = F.explode(F.array(*[F.lit(t) for t in templates]))
    asked = prompts.render_templates(items.withColumn("template", named), templates, values)
    chat = asked.select("ord", "template", "messages")
    # Prompts are rendered once, whatever the number of models.
    models = F.explode(F.array(*[F.lit(m) for m in responders]))
    chat = chat.withColumn("model", models)
    answers = responses.apply_responder(
        chat, responses.by_model(responders), ["ord", "template", "model"]
    )
    # Asking is the costly step: it happens once.
    kept = stored(answers, "answers")
    truth = items.select(
        "ord", "sample_id", "error_flag", "error_sentence_id", "corrected_sentence"
    )
    return parse_answers(kept).join(truth, "ord")


def evaluation_metrics(parsed: DataFrame, by: Sequence[str] = ("model", "template")) -> DataFrame:
    """Detection, extraction and correction metrics of each experiment side by side."""
    detection = score.detection_metrics(parsed, by).select(
        *by, "accuracy", "precision", "recall", "f1"
    )
    extraction = score.extraction_metrics(parsed, by).select(*by, "exact_match", "error_accuracy")
    pairs = parsed.select(
        *by,
        "ord",
        F.coalesce("ec_pred", F.lit("")).alias("prediction"),
        F.coalesce("corrected_sentence", F.lit("")).alias("reference"),
    )
    correction = score.correction_metrics(pairs, by, "ord", count_empty_na=True).select(
        *by,
        F.col("error_samples").alias("correction_pairs"),
        "no_error_accuracy",
        F.col("composite_avg").alias("correction_composite"),
    )
    return detection.join(extraction, list(by)).join(correction, list(by))


def synthesis_to_items(
    responses_: DataFrame,
    models: Sequence[str],
    dedup: Callable[[DataFrame], DataFrame] = curate.dedup_alternating,
) -> DataFrame:
    """Synthesis responses of several models → one item per question and choice.

    `responses_` hold ord, question_id, model and content; `ord` is unique among
    the responses of a model.
    """
    records = curate.record_position(synthesis.parse_synthesis(responses_))
    items = synthesis.usable_items(synthesis.assemble_items(records))
    # Read by several steps of the duplicate removal; texts are parsed once.
    return dedup(stored(curate.union_models(items, models), "items"))


def training_rows(
    samples: DataFrame,
    details: DataFrame,
    answers: DataFrame,
    by: Sequence[str],
    pattern: str,
) -> DataFrame:
    """Samples of experiments that have a correct one, with the answers' reasoning cleaned.

    Adds `split` (correct, incorrect_error_flag_0, incorrect_error_flag_1), by
    which `split_write` stores them, content, reasoning, source_model and
    removed_sentences.
    """
    split = train.correct_samples(train.join_details(samples, details, by))
    stats = train.correct_sample_stats(split, by)
    used = train.without_empty_experiments(split, stats, by)
    return train.clean_table(train.attach_responses(used, answers, by), pattern)


def build_benchmark(
    items: DataFrame,
    preds: DataFrame,
    limits: DataFrame,
    judgments: DataFrame,
    total_models: int,
    dedup: Callable[[DataFrame], DataFrame] = curate.dedup_alternating,
) -> DataFrame:
    """Items of fitting difficulty, one per question and choice, that no judge rejects."""
    accuracies = curate.item_accuracy(preds)
    filtered = curate.quality_filter(
        curate.join_item_accuracy(items, accuracies), limits, total_models
    )
    adopted = stored(filtered.where(F.col("split") == "adopted").drop("split"), "adopted")
    single = dedup(adopted)
    verdicts = curate.consolidate_judgments(parse_judgments(judgments))
    judged = curate.join_judgments(single, verdicts)
    return judged.where(F.col("split") == "accepted").drop("split")
