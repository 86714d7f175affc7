"""Metrics: per-item scores are projections, aggregates are one `groupBy`.

`by` names the experiment columns (model, template, …) everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import text as T
from textbench.functions.rouge import rouge


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """top / bottom, or a fixed value when the bottom is zero."""
    return F.coalesce(
        top.cast("double") / F.nullif(bottom, F.lit(0)).cast("double"), F.lit(otherwise)
    )


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


# --- detection --------------------------------------------------------------


def detection_per_item(preds: DataFrame) -> DataFrame:
    """Add `outcome` (tp, fp, tn, fn) and `is_correct`; an unreadable answer is wrong."""
    pred, ref = F.col("ed_pred"), F.col("error_flag")
    outcome = (
        F.when(ref == 1, F.when(pred == 1, "tp").otherwise("fn"))
        .when(pred == 0, "tn")
        .otherwise("fp")
    )
    return preds.withColumn("outcome", outcome).withColumn(
        "is_correct", F.col("outcome").isin("tp", "tn")
    )


OUTCOMES = ("tp", "fp", "tn", "fn")


def detection_metrics(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = detection_per_item(preds).groupBy(*by).agg(
        *[count_where(F.col("outcome") == x).alias(x) for x in OUTCOMES],
        F.count(F.lit(1)).alias("n"),
    )
    return detection_rates(counts)


def detection_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1 to counts of outcomes."""
    tp, fp, tn, fn = (F.col(x) for x in OUTCOMES)
    rates = counts.withColumns(
        {
            "accuracy": ratio(tp + tn, F.col("n")),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return rates.withColumn("f1", f1)


# --- sentence extraction ----------------------------------------------------


def extraction_per_item(preds: DataFrame) -> DataFrame:
    """Add `is_exact_match`, `has_error` and `is_correct_on_error`."""
    ref = F.coalesce(F.col("error_sentence_id"), F.lit(0))
    pred = F.col("se_pred")
    exact = F.coalesce((pred == ref) & (pred != K.NO_ANSWER), F.lit(False))
    return preds.withColumns(
        {
            "is_exact_match": exact,
            "has_error": ref > 0,
            "is_correct_on_error": (ref > 0) & exact,
        }
    )


def extraction_metrics(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = extraction_per_item(preds).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(F.col("has_error")).alias("error_samples"),
        count_where(F.col("is_exact_match")).alias("exact_matches"),
        count_where(F.col("is_correct_on_error")).alias("error_matches"),
    )
    exact = ratio(F.col("exact_matches"), F.col("total_samples"))
    return counts.withColumns(
        {
            "accuracy": exact,
            "exact_match": exact,
            "error_accuracy": ratio(F.col("error_matches"), F.col("error_samples")),
        }
    ).drop("error_matches")


def answer_metrics(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, detection, extraction): the metrics of both as structs, in one aggregate."""
    rows = extraction_per_item(detection_per_item(preds))
    outcomes = ("tp", "fp", "tn", "fn")
    counts = rows.groupBy(*by).agg(
        *[count_where(F.col("outcome") == x).alias(x) for x in outcomes],
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("has_error")).alias("errors"),
        count_where(F.col("is_exact_match")).alias("exact"),
        count_where(F.col("is_correct_on_error")).alias("exact_errors"),
    )
    tp, fp, tn, fn, n = (F.col(x) for x in (*outcomes, "n"))
    rates = counts.withColumns({"p": ratio(tp, tp + fp), "r": ratio(tp, tp + fn)})
    p, r = F.col("p"), F.col("r")
    match = ratio(F.col("exact"), n)
    return rates.select(
        *by,
        F.struct(
            *outcomes,
            ratio(tp + tn, n).alias("accuracy"),
            p.alias("precision"),
            r.alias("recall"),
            F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        ).alias("detection"),
        F.struct(
            match.alias("accuracy"),
            match.alias("exact_match"),
            ratio(F.col("exact_errors"), F.col("errors")).alias("error_accuracy"),
            n.alias("total_samples"),
            F.col("errors").alias("error_samples"),
            F.col("exact").alias("exact_matches"),
        ).alias("extraction"),
    )


# --- correction -------------------------------------------------------------


def group_language(
    df: DataFrame,
    reference: str,
    by: Sequence[str],
    order: str | None = None,
    votes: int | None = None,
) -> DataFrame:
    """(by…, language): majority over the references of each group.

    All references vote, counted inside the tasks first. With `votes` only the
    first ones by `order` do, as in the published scoring (five); then only so
    many rows per group leave a task.
    """
    if votes is None:
        voters = df.select(*by, F.col(reference).alias("_ref"))
    else:
        first = Window.partitionBy(*by).orderBy(order)
        voters = (
            df.select(*by, order, F.col(reference).alias("_ref"))
            .withColumn("_place", F.row_number().over(first))
            .where(F.col("_place") <= votes)
        )
    seen = voters.withColumn(
        "_lang", F.when(~T.is_blank(F.col("_ref")), T.detect_language(F.col("_ref")))
    )
    counts = seen.groupBy(*by).agg(
        *[count_where(F.col("_lang") == x).alias(x) for x in ("ja", "en", "unknown")]
    )
    ja, en, unknown = F.col("ja"), F.col("en"), F.col("unknown")
    winner = (
        F.when((ja >= en) & (ja >= unknown), "ja").when(en >= unknown, "en").otherwise("unknown")
    )
    return counts.select(*by, winner.alias("language"))


def clean_pairs(pairs: DataFrame, count_empty_na: bool = False) -> DataFrame:
    """Clean both sides and say what each pair is.

    `is_pair` goes to the text metrics, `correct_na` and `incorrect_na` are the
    counters. Empty predictions are counted only with `count_empty_na`.
    """
    clean = pairs.withColumns(
        {
            "prediction": T.clean_quotes(F.col("prediction")),
            "reference": T.clean_quotes(F.col("reference")),
        }
    )
    pred, ref = F.col("prediction"), F.col("reference")
    clean = clean.withColumns(
        {
            "pred_na": T.is_na_text(pred),
            "ref_na": T.is_na_text(ref),
            "na": T.na_case(pred, ref),
            "given": (pred != "") | F.lit(count_empty_na),
        }
    )
    given, pna, rna = F.col("given"), F.col("pred_na"), F.col("ref_na")
    return clean.withColumns(
        {
            "is_pair": given & ~pna & ~rna,
            "correct_na": given & pna & rna,
            "incorrect_na": given & pna & ~rna,
        }
    )


def pair_counters(pairs: DataFrame, by: Sequence[str], count_empty_na: bool = False) -> DataFrame:
    counted = clean_pairs(pairs, count_empty_na)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_texts"),
        count_where(F.col("ref_na")).alias("reference_na"),
        count_where(F.col("given")).alias("system_texts"),
        count_where(F.col("given") & F.col("pred_na")).alias("system_na"),
        count_where(F.col("correct_na")).alias("correct_na"),
        count_where(F.col("incorrect_na")).alias("incorrect_na"),
        count_where(F.col("is_pair")).alias("pairs"),
    )


def with_language(
    pairs: DataFrame,
    by: Sequence[str],
    order: str,
    language: str | None = None,
    votes: int | None = None,
) -> DataFrame:
    """Add the language of the group, detected unless it is given; null keys are a group too."""
    if language is not None:
        return pairs.withColumn("language", F.lit(language))
    found = group_language(pairs, "reference", by, order, votes)
    found = found.select(*[F.col(k).alias(f"_{k}") for k in by], "language")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    return pairs.join(found, same).drop(*[f"_{k}" for k in by])


def score_pairs(
    pairs: DataFrame,
    method: str = "auto",
    japanese=T.char_tokens,
    count_empty_na: bool = False,
    scorers: Sequence[str] = (),
) -> DataFrame:
    """Per-item scores of `prediction`, `reference`, `language` rows.

    Adds `rouge` (null unless the row is a text pair), `score_1`, `score_2`,
    `score_l` with the no-answer score filled in, and `composite`, the mean of
    these and of the columns named in `scorers`.
    """
    clean = clean_pairs(pairs, count_empty_na)
    compared = F.col("is_pair")
    # Unreadable answers are compared for the aggregate, so only tokens of pairs are made.
    tokens = {
        f"_{side}": F.when(compared, T.tokenize(F.col(side), F.col("language"), method, japanese))
        for side in ("prediction", "reference")
    }
    scored = (
        clean.withColumns(tokens)
        .withColumn("rouge", rouge(F.col("_prediction"), F.col("_reference")))
        .drop(*tokens)
    )
    na, fixed = F.col("na.is_na"), F.col("na.score")

    def filled(c):
        return F.when(na, fixed).otherwise(F.coalesce(c, F.lit(0.0)))

    parts = [filled(F.col(f"rouge.rouge_{n}_f")) for n in "12l"]
    others = [filled(F.col(name)) for name in scorers]
    total = sum(parts[1:] + others, parts[0])
    return scored.withColumns(
        {
            "score_1": parts[0],
            "score_2": parts[1],
            "score_l": parts[2],
            "composite": F.when(na, fixed).otherwise(total / (len(parts) + len(others))),
        }
    )


def correction_per_item(
    pairs: DataFrame,
    by: Sequence[str],
    order: str,
    language: str | None = None,
    votes: int | None = None,
    **options,
) -> DataFrame:
    return score_pairs(with_language(pairs, by, order, language, votes), **options)


def correction_metrics(
    pairs: DataFrame,
    by: Sequence[str],
    order: str,
    language: str | None = None,
    scorers: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Means over text pairs, the composite that credits right no-answers, counters."""
    scored = correction_per_item(pairs, by, order, language, scorers=scorers, **options)
    pair = F.col("is_pair")

    def mean(c):
        return F.coalesce(F.avg(F.when(pair, c)), F.lit(0.0))

    names = {"rouge_1_f": "rouge.rouge_1_f", **{s: s for s in scorers}}
    each = [F.col(c) for c in names.values()]
    average = sum(each[1:], each[0]) / len(each)
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(pair).alias("error_samples"),
        count_where(F.col("correct_na")).alias("correct_na"),
        count_where(F.col("incorrect_na")).alias("incorrect_na"),
        *[mean(F.col(c)).alias(n) for n, c in names.items()],
        mean(F.col("rouge.rouge_2_f")).alias("rouge_2_f"),
        mean(F.col("rouge.rouge_l_f")).alias("rouge_l_f"),
        mean(average).alias("average_score"),
    )
    n, right = F.col("error_samples"), F.col("correct_na")
    composites = {
        f"{name.removesuffix('_f')}_composite": ratio(F.col(name) * n + right, F.col("total_samples"))
        for name in names
    }
    values = list(composites.values())
    return out.withColumns(
        {
            "no_error_samples": F.col("total_samples") - n,
            "no_error_accuracy": ratio(right, right + F.col("incorrect_na"), otherwise=1.0),
            **composites,
            "composite_avg": sum(values[1:], values[0]) / len(values),
        }
    )


def apply_pair_scorer(
    pairs: DataFrame,
    load: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]],
    name: str,
    count_empty_na: bool = False,
) -> DataFrame:
    """Add a score in [0, 1] from a batch scorer for text pairs, null elsewhere.

    `load` runs once per Python worker and returns score(predictions, references).
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for preds, refs in batches:
            given = preds.notna() & refs.notna()
            out = pd.Series(float("nan"), index=preds.index, dtype="float64")
            if given.any():
                out[given] = list(score(preds[given].tolist(), refs[given].tolist()))
            yield out.where(given, None)

    clean = clean_pairs(pairs, count_empty_na)
    pair = F.col("is_pair")
    raw = run(F.when(pair, F.col("prediction")), F.when(pair, F.col("reference")))
    scored = clean.withColumn(name, raw)
    kept = F.when(pair, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)))
    return scored.withColumn(name, kept).select(*pairs.columns, name)


# --- error types ------------------------------------------------------------


def error_type_per_item(labels: DataFrame) -> DataFrame:
    """Readable labels with `classification_correct`."""
    none, flag = F.col("label.error_type") == "none", F.col("error_flag")
    right = (none & (flag == 0)) | (~none & (flag == 1))
    return labels.where(~F.col("label.parse_error")).withColumn("classification_correct", right)


def error_type_metrics(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    ok = ~F.col("label.parse_error")
    none, flag = F.col("label.error_type") == "none", F.col("error_flag")
    counts = labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(~ok).alias("parse_errors"),
        count_where(ok).alias("valid_samples"),
        count_where(ok & (flag == 0)).alias("correct_samples"),
        count_where(ok & (flag == 1)).alias("error_samples"),
        count_where(ok & none).alias("none_predictions"),
        count_where(ok & none & (flag == 0)).alias("none_for_correct"),
        count_where(ok & none & (flag == 1)).alias("none_for_error"),
        count_where(ok & ~none & (flag == 1)).alias("classified_errors"),
        count_where(ok & ~none & (flag == 0)).alias("_typed_for_correct"),
        *[
            count_where(ok & (F.col("label.confidence") == x)).alias(f"{x}_confidence")
            for x in K.CONFIDENCE_LEVELS
        ],
    )
    errors, correct = F.col("error_samples"), F.col("correct_samples")
    typed = F.col("classified_errors")
    return counts.withColumns(
        {
            "parse_error_rate": ratio(F.col("parse_errors"), F.col("total_samples")),
            "classification_accuracy": ratio(
                F.col("none_for_correct") + typed, F.col("valid_samples")
            ),
            "error_type_coverage": ratio(typed, errors),
            "false_positive_rate": ratio(errors - typed, correct),
            "typed_for_correct_rate": ratio(F.col("_typed_for_correct"), correct),
        }
    ).drop("_typed_for_correct")


def error_type_distribution(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, error_type, count, rate) over readable labels."""
    counts = (
        labels.where(~F.col("label.parse_error"))
        .groupBy(*by, F.col("label.error_type").alias("error_type"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # One row per experiment and type.
    whole = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("rate", ratio(F.col("count"), whole))


# --- judgments --------------------------------------------------------------


def screening_metrics(judgments: DataFrame, by: Sequence[str]) -> DataFrame:
    ok = ~F.col("judgment.parse_error")
    counts = judgments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(~ok).alias("parse_errors"),
        count_where(ok).alias("valid_samples"),
        count_where(ok & F.col("judgment.is_valid")).alias("valid_for_benchmark"),
        F.coalesce(
            F.sum(F.when(ok & (F.col("judgment.total_issues") >= 0), F.col("judgment.total_issues"))),
            F.lit(0).cast("bigint"),
        ).alias("total_issues"),
        *[
            count_where(ok & (F.col(f"judgment.{c}") > 0)).alias(f"{c}_count") for c in K.CRITERIA
        ],
    )
    valid = F.col("valid_samples")
    return counts.withColumns(
        {
            "parse_error_rate": ratio(F.col("parse_errors"), F.col("total_samples")),
            "overall_valid_rate": ratio(F.col("valid_for_benchmark"), valid),
            "avg_issues_per_sample": ratio(F.col("total_issues"), valid),
            **{f"{c}_rate": ratio(F.col(f"{c}_count"), valid) for c in K.CRITERIA},
        }
    )


def issue_histogram(judgments: DataFrame, by: Sequence[str], most: int = 5) -> DataFrame:
    """(by…, issues, samples, rate) for 0 … `most` issues, zeros included.

    The bin `most` + 1 holds all higher totals.
    """
    total = F.col("judgment.total_issues")
    ok = ~F.col("judgment.parse_error")
    counts = judgments.groupBy(*by).agg(
        count_where(ok).alias("_valid"),
        *[count_where(ok & (total == i)).alias(f"_{i}") for i in range(most + 1)],
        count_where(ok & (total > most)).alias(f"_{most + 1}"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("issues"), F.col(f"_{i}").alias("samples"))
            for i in range(most + 2)
        ]
    )
    return (
        counts.select(*by, "_valid", F.inline(rows))
        .withColumn("rate", ratio(F.col("samples"), F.col("_valid")))
        .drop("_valid")
    )
