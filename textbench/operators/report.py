"""Reports: leaderboards, per-item accuracy, sorted and filtered item lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import text as T
from textbench.operators.ordinal import with_sorted_position
from textbench.operators.score import count_where, ratio

# --- experiments ------------------------------------------------------------


def available_experiments(grid: DataFrame, results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the grid that have results."""
    return grid.join(results.select(*by), list(by), "left_semi")


def task_status(configured: DataFrame, implemented: DataFrame, with_results: DataFrame) -> DataFrame:
    """(task, has_implementation, has_results, status) of the configured tasks."""
    done = with_results.select("task").distinct().withColumn("_results", F.lit(True))
    code = implemented.select("task").distinct().withColumn("_code", F.lit(True))
    joined = configured.select("task").join(code, "task", "left").join(done, "task", "left")
    has_code, has_data = F.col("_code").isNotNull(), F.col("_results").isNotNull()
    status = (
        F.when(has_code & has_data, "ready")
        .when(has_data, "data_only")
        .when(has_code, "implementation_only")
        .otherwise("configured_only")
    )
    return joined.select(
        "task",
        has_code.alias("has_implementation"),
        has_data.alias("has_results"),
        status.alias("status"),
    )


def _metric_structs(category: str, values: dict[str, Column]) -> list[Column]:
    return [
        F.struct(
            F.lit(category).alias("category"),
            F.lit(f"{category}_{name}").alias("metric"),
            value.cast("double").alias("value"),
        )
        for name, value in values.items()
    ]


def metric_rows(metrics: DataFrame, by: Sequence[str], category: str, columns: Sequence[str]) -> DataFrame:
    """Wide metrics → (by…, category, metric, value) with the category in the name."""
    rows = _metric_structs(category, {c: F.col(c) for c in columns})
    return metrics.select(*by, F.inline(F.array(*rows)))


def all_metric_rows(
    metrics: DataFrame, by: Sequence[str], categories: dict[str, dict[str, Column]]
) -> DataFrame:
    """The same for several categories of one row per experiment; null values have no row."""
    rows = [s for category, values in categories.items() for s in _metric_structs(category, values)]
    given = F.filter(F.array(*rows), lambda m: m["value"].isNotNull())
    return metrics.select(*by, F.inline(given))


def displayed_metrics(metrics: DataFrame) -> DataFrame:
    """Without mere counts, which are known by their endings."""
    keep = F.lit(False)
    for category, endings in K.COUNT_SUFFIXES.items():
        count = F.lit(False)
        for ending in endings:
            count = count | F.col("metric").endswith(ending)
        keep = keep | ((F.col("category") == category) & ~count)
    return metrics.where(keep)


def leaderboard(
    metrics: DataFrame, by: Sequence[str], primary: Sequence[str] = tuple(K.PRIMARY_METRICS)
) -> DataFrame:
    """One row per experiment, one column per primary metric."""
    return metrics.groupBy(*by).pivot("metric", list(primary)).agg(F.first("value"))


def overview_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """The metric shown per category: detection and extraction have one choice,
    correction takes the first available by priority."""
    rank = F.lit(None).cast("int")
    shown = {
        "error_detection": K.METRIC_PRIORITY["error_detection"][:1],
        "sentence_extraction": K.METRIC_PRIORITY["sentence_extraction"][:1],
        "error_correction": K.METRIC_PRIORITY["error_correction"],
    }
    for names in shown.values():
        for place, name in enumerate(names):
            rank = F.coalesce(rank, F.when(F.col("metric") == name, place))
    # A handful of metric rows per experiment.
    best = Window.partitionBy(*by, "category").orderBy("_rank")
    return (
        metrics.withColumn("_rank", rank)
        .where(F.col("_rank").isNotNull())
        .withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") == 1)
        .select(*by, "category", "metric", "value")
    )


def judge_overview(metrics: DataFrame) -> DataFrame:
    """Judge metrics shown: the primary ones always, criteria rates only above zero."""
    rates = [f"screening_metrics_{c}_rate" for c in K.CRITERIA]
    name = F.col("metric")
    return metrics.where(
        name.isin(*K.JUDGE_PRIMARY_METRICS) | (name.isin(*rates) & (F.col("value") > 0))
    )


def sample_counts(metrics: DataFrame, by: Sequence[str], dataset_size: Column) -> DataFrame:
    """(by…, processed, attempted, delta) from the counts among the metrics."""

    def value(name):
        return F.max(F.when(F.col("metric") == name, F.col("value").cast("bigint")))

    parts = [value(f"error_detection_{x}") for x in ("tp", "fp", "tn", "fn")]
    detection = F.lit(0).cast("bigint")
    for part in parts:
        detection = detection + F.coalesce(part, F.lit(0).cast("bigint"))
    has_detection = F.bool_or(F.col("category") == "error_detection")
    wide = metrics.groupBy(*by).agg(
        F.when(has_detection, detection).alias("_detection"),
        value("sentence_extraction_total_samples").alias("_extraction"),
        value("error_correction_total_pairs").alias("_pairs"),
    )
    zero = F.lit(0).cast("bigint")
    processed = F.coalesce("_detection", "_extraction", zero)
    attempted = F.coalesce(
        F.nullif(F.col("_extraction"), zero), F.nullif(F.col("_pairs"), zero), processed
    )
    return wide.select(
        *by,
        processed.alias("processed"),
        attempted.alias("attempted"),
        F.when(processed > 0, processed - dataset_size).otherwise(0).alias("delta"),
    )


def rank_experiments(metrics: DataFrame, metric: str, within: Sequence[str] = ()) -> DataFrame:
    """Add `rank` by one metric, best first. One row per experiment comes in."""
    return metrics.withColumn(
        "rank", F.rank().over(Window.partitionBy(*within).orderBy(F.desc(metric)))
    )


def precision_recall_points(detection: DataFrame, by: Sequence[str]) -> DataFrame:
    return detection.select(*by, F.col("recall").alias("x"), F.col("precision").alias("y"))


# --- items ------------------------------------------------------------------


def dataset_stats(items: DataFrame) -> DataFrame:
    has = F.col("error_flag") == 1
    return items.agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(has).alias("with_errors"),
        count_where(~has).alias("without_errors"),
        F.count_distinct(F.coalesce(T.null_if_empty(F.col("error_type")), F.lit("None"))).alias(
            "error_types"
        ),
    )


def type_distribution(items: DataFrame) -> DataFrame:
    kind = F.coalesce(T.null_if_empty(F.col("error_type")), F.lit("None"))
    return items.groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("items"))


def filter_items(
    items: DataFrame,
    status: Sequence[str] = (),
    categories: Sequence[str] = (),
    positive: Column | None = None,
    labels: tuple[str, str] = ("With Errors", "Without Errors"),
) -> DataFrame:
    """Keep items by status, when exactly one is chosen, and by error type.

    `positive` says which items have the first status; for judged items pass
    `coalesce(is_valid, true)` and the labels Valid and Invalid.
    """
    yes = F.col("error_flag") == 1 if positive is None else positive
    out = items
    if len(status) == 1 and status[0] in labels:
        # An unknown status counts as the second one.
        yes = F.coalesce(yes, F.lit(False))
        out = out.where(yes if status[0] == labels[0] else ~yes)
    if categories:
        kind = F.coalesce(T.null_if_empty(F.col("error_type")), F.lit("None"))
        out = out.where(kind.isin(*categories))
    return out


def lookup_predictions(items: DataFrame, preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """Items with the predictions of the chosen models."""
    chosen = preds.where(F.col("model").isin(*models)).select(
        "sample_id", "model", "template", "ed_pred", "se_pred"
    )
    return items.join(chosen, "sample_id")


def sample_model_accuracy(items: DataFrame, preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """(sample_id, detection, extraction) over the chosen models; 0 without any.

    Predictions shrink to one row per item before they meet the items.
    """
    chosen = preds.where(F.col("model").isin(*models))
    has, truth = F.col("error_flag") == 1, F.col("error_sentence_id")
    counted = has & F.col("se_pred").isNotNull() & truth.isNotNull()
    counts = chosen.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n"),
        count_where((F.col("ed_pred") == 1) == has).alias("_right"),
        count_where(counted).alias("_asked"),
        count_where(counted & (F.col("se_pred") == truth)).alias("_exact"),
    )
    joined = items.select("sample_id").join(counts, "sample_id", "left")
    return joined.select(
        "sample_id",
        ratio(F.col("_right"), F.col("_n")).alias("detection"),
        ratio(F.col("_exact"), F.col("_asked")).alias("extraction"),
    )


def sample_composite(items: DataFrame, scored: DataFrame) -> DataFrame:
    """(sample_id, composite): mean over models, null where nobody answered."""
    means = scored.groupBy("sample_id").agg(F.avg("composite").alias("composite"))
    return items.select("sample_id").join(means, "sample_id", "left")


def sample_screening(judgments: DataFrame) -> DataFrame:
    """Per item: mean validity, issues and criteria over judges.

    An unreadable judgment counts as valid with nothing found.
    """
    j, unread = F.col("judgment"), F.col("judgment.parse_error")

    def mean(c):
        return F.avg(F.when(unread, F.lit(0)).otherwise(c))

    return judgments.groupBy("sample_id").agg(
        F.avg(F.when(unread | j["is_valid"], 1.0).otherwise(0.0)).alias("validity"),
        mean(j["total_issues"]).alias("total_issues"),
        *[mean(j[c]).alias(c) for c in K.CRITERIA],
    )


# Names of the sort orders and the score each one uses.
SORT_KEYS = {
    "error_detection": "detection",
    "error_detection_f1": "detection",
    "sentence_extraction": "extraction",
    "sentence_extraction_error_accuracy": "extraction",
    "error_correction_top_metric": "composite",
    "validity": "validity",
    "total_issues": "total_issues",
}


def sort_samples(items: DataFrame, sort_key: str = "original_order") -> DataFrame:
    """Add `place`, the 0-based position under a sort order.

    `items` hold a unique ord (a repeated one is an error), sample_id and the
    score columns the key needs. Only these are sorted; other columns are joined
    to the positions at the end. A missing score counts as 0; descending orders turn the id tie-break round as well.
    Unknown keys keep the original order.
    """
    name, _, way = sort_key.rpartition("_")
    needed = ["ord"]
    if sort_key == "sample_id":
        needed = ["ord", "sample_id"]
        order = [F.col("sample_id").asc(), F.col("ord").asc()]
    elif way in ("asc", "desc") and name in SORT_KEYS:
        needed = ["ord", "sample_id", SORT_KEYS[name]]
        score = F.coalesce(F.col(SORT_KEYS[name]), F.lit(0.0))
        ends = [score, F.col("sample_id")]
        order = [c.asc() if way == "asc" else c.desc() for c in ends] + [F.col("ord").asc()]
    else:
        order = [F.col("ord").asc()]
    placed = with_sorted_position(items.select(*needed), order, "place")
    once = F.when(F.count(F.lit(1)) == 1, F.min("place")).otherwise(
        F.raise_error(F.concat(F.lit("position used twice: "), F.col("ord").cast("string"))).cast("long")
    )
    places = placed.groupBy("ord").agg(once.alias("place"))
    return items.join(places.withColumnRenamed("ord", "_ord"), F.col("ord").eqNullSafe(F.col("_ord"))).drop("_ord")


def compare_prediction(items: DataFrame, preds: DataFrame) -> DataFrame:
    """Prediction and truth side by side, with the sentence a model pointed at."""
    truth = items.select(
        "sample_id",
        F.col("error_flag").alias("_flag"),
        F.col("error_sentence_id").alias("_id"),
        "sentences",
        "error_sentence",
        "corrected_sentence",
    )
    flag, pointed = F.col("_flag"), F.col("se_pred")
    exact = F.when(flag == 0, pointed.isNull() | (pointed == 0)).otherwise(
        pointed.eqNullSafe(F.col("_id"))
    )
    joined = preds.select("sample_id", "model", "template", "ed_pred", "se_pred", "ec_pred").join(
        truth, "sample_id"
    )
    return joined.select(
        "sample_id",
        "model",
        "template",
        ((F.col("ed_pred") == 1) == (flag == 1)).alias("detection_correct"),
        exact.alias("extraction_correct"),
        F.col("se_pred").alias("predicted_id"),
        F.col("_id").alias("actual_id"),
        T.nth_sentence(F.col("sentences"), F.coalesce(pointed, F.lit(0))).alias(
            "predicted_sentence"
        ),
        F.coalesce("error_sentence", F.lit("")).alias("actual_sentence"),
        F.col("ec_pred").alias("predicted_correction"),
        F.coalesce("corrected_sentence", F.lit("")).alias("actual_correction"),
    )


def compare_judgment(items: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments next to what is known of the item."""
    j = F.col("judgment")
    known = items.select("sample_id", "error_flag", "error_type")
    return judgments.join(known, "sample_id").select(
        "sample_id",
        "template",
        j["is_valid"].alias("is_valid"),
        j["total_issues"].alias("total_issues"),
        *[j[c].alias(c) for c in K.CRITERIA],
        j["explanation"].alias("explanation"),
        (F.col("error_flag") == 1).alias("has_error"),
        F.coalesce("error_type", F.lit("None")).alias("error_type"),
    )
