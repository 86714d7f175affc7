"""Training rows: correct answers with their responses, and cleaned reasoning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.functions.reasoning import clean_reasoning
from textbench.operators.score import (
    count_where,
    detection_per_item,
    extraction_per_item,
    ratio,
)

SAMPLE_FIELDS = [
    "sample_id",
    "sentences",
    "error_flag",
    "error_type",
    "error_sentence_id",
    "error_sentence",
    "corrected_sentence",
    "corrected_text",
]


def join_details(samples: DataFrame, details: DataFrame, by: Sequence[str]) -> DataFrame:
    """Samples with the per-item metrics at the same position of the same experiment."""
    scores = details.select(*by, "ord", "is_correct", "is_exact_match")
    return samples.join(scores, [*by, "ord"], "left")


def details_of(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """The per-item metrics that extraction looks at."""
    return extraction_per_item(detection_per_item(preds)).select(
        *by, "ord", "is_correct", "is_exact_match"
    )


def correct_samples(detailed: DataFrame) -> DataFrame:
    """Add `split`: correct, incorrect_error_flag_0 or incorrect_error_flag_1."""
    flag = F.coalesce(F.col("error_flag"), F.lit(0))
    right = F.coalesce(F.col("is_correct"), F.lit(False)) & (
        (flag != 1) | F.coalesce(F.col("is_exact_match"), F.lit(False))
    )
    wrong = F.when(flag == 1, "incorrect_error_flag_1").otherwise("incorrect_error_flag_0")
    return detailed.withColumn("split", F.when(right, "correct").otherwise(wrong))


def correct_sample_stats(split: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and ratios per experiment."""
    right, error = F.col("split") == "correct", F.coalesce(F.col("error_flag"), F.lit(0)) == 1
    counts = split.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(right).alias("correct_samples"),
        count_where(error).alias("error_samples"),
        count_where(~error).alias("no_error_samples"),
        count_where(right & error).alias("correct_error_samples"),
        count_where(right & ~error).alias("correct_no_error_samples"),
        count_where(~right & error).alias("incorrect_error_samples"),
        count_where(~right & ~error).alias("incorrect_no_error_samples"),
    )
    c = F.col
    return counts.withColumns(
        {
            "accuracy": ratio(c("correct_samples"), c("total_samples")),
            "error_ratio": ratio(c("error_samples"), c("total_samples")),
            "no_error_ratio": ratio(c("no_error_samples"), c("total_samples")),
            "error_accuracy": ratio(c("correct_error_samples"), c("error_samples")),
            "no_error_accuracy": ratio(c("correct_no_error_samples"), c("no_error_samples")),
            "filtered_error_ratio": ratio(c("correct_error_samples"), c("correct_samples")),
            "filtered_no_error_ratio": ratio(c("correct_no_error_samples"), c("correct_samples")),
        }
    )


def extraction_summary(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per experiment and in total (null keys). Experiments without a single
    correct row are left out of everything, totals included."""
    used = stats.where(F.col("correct_samples") > 0)
    sums = [
        "total_samples",
        "correct_samples",
        "error_samples",
        "no_error_samples",
        "correct_error_samples",
        "correct_no_error_samples",
        "incorrect_error_samples",
        "incorrect_no_error_samples",
    ]
    keys = F.struct(*by).alias("_keys")
    rolled = used.rollup(keys).agg(
        F.count(F.lit(1)).alias("experiments"), *[F.sum(s).alias(s) for s in sums]
    )
    out = rolled.select(*[F.col(f"_keys.{k}").alias(k) for k in by], "experiments", *sums)
    return out.withColumn("accuracy", ratio(F.col("correct_samples"), F.col("total_samples")))


def without_empty_experiments(split: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of experiments that have at least one correct row."""
    used = stats.where(F.col("correct_samples") > 0).select(*by)
    return split.join(used, list(by), "left_semi")


def attach_responses(samples: DataFrame, responses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add content, reasoning and the source model; '' where there is no response."""
    chosen = responses.select(
        *by,
        "ord",
        F.col("content").alias("_content"),
        F.col("reasoning").alias("_reasoning"),
        F.col("response_model").alias("_model"),
    )
    joined = samples.join(chosen, [*by, "ord"], "left")
    return joined.withColumns(
        {
            "content": F.coalesce(F.col("_content"), F.lit("")),
            "reasoning": F.coalesce(F.col("_reasoning"), F.lit("")),
            "source_model": F.coalesce(F.col("_model"), F.col("model")),
        }
    ).drop("_content", "_reasoning", "_model")


def clean_table(
    df: DataFrame, pattern: str, reasoning: str = "reasoning", within: str | None = None
) -> DataFrame:
    """Clean the reasoning of every row that has one; add `removed_sentences`.

    With `within` the text is a field of that struct (raw_response).
    """
    text = F.col(f"{within}.{reasoning}" if within else reasoning)
    given = F.coalesce(text != "", F.lit(False))
    done = clean_reasoning(text, pattern)
    counted = df.withColumn(
        "removed_sentences", F.when(given, done["removed"]).otherwise(F.lit(0))
    )
    cleaned = F.when(given, done["text"]).otherwise(text)
    if within:
        return counted.withColumn(within, F.col(within).withField(reasoning, cleaned))
    return counted.withColumn(reasoning, cleaned)


def clean_stats(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row of totals over cleaned rows."""
    given = F.coalesce(before != "", F.lit(False))

    def total(c):
        return F.coalesce(F.sum(F.when(given, c)), F.lit(0)).cast("bigint")

    out = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(given).alias("with_reasoning"),
        count_where(given & (F.col("removed_sentences") > 0)).alias("changed_samples"),
        total(F.col("removed_sentences")).alias("removed_sentences"),
        total(F.length(before)).alias("chars_before"),
        total(F.length(after)).alias("chars_after"),
    )
    return out.withColumns(
        {
            "avg_before": ratio(F.col("chars_before"), F.col("with_reasoning")),
            "avg_after": ratio(F.col("chars_after"), F.col("with_reasoning")),
        }
    )
