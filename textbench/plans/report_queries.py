"""Queries over leaderboards and per-item reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import answers as A
from textbench.functions import verdicts as V
from textbench.operators import report, responses, score
from textbench.plans.answer_queries import JUDGE_COLUMNS
from textbench.plans.registry import query
from textbench.plans.score_queries import _CONFUSION, _EXACT, R6, _n

c = F.col
BY = ["dataset", "model", "template"]
MODELS = ["model1", "model4", "model9"]
CHOSEN = "model IN ('model1', 'model4', 'model9')"

# --- experiments ------------------------------------------------------------


@query(
    "available_experiments",
    "SELECT DISTINCT model, dataset, template FROM fx_attempt WHERE dataset IN ('en', 'fr') AND run_ts = 'backup_20240101'",
    ["attempt"],
)
def _(fx):
    # Only French experiments have a copied run; "xx" was never run.
    models = fx.pred.select("model").distinct()
    grid = responses.experiment_grid(models, dataset=["en", "fr", "xx"], template=["t0", "t1"])
    results = fx.attempt.where(c("run_ts") == "backup_20240101")
    return report.available_experiments(grid, results, ["model", "dataset", "template"])


@query(
    "task_status",
    """SELECT source AS task, CAST(max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS INT) AS has_implementation,
              CAST(max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS INT) AS has_results,
              CASE WHEN max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) = 1 THEN CASE WHEN max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) = 1 THEN 'ready' ELSE 'data_only' END
                   WHEN max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) = 1 THEN 'implementation_only' ELSE 'configured_only' END AS status
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
)
def _(fx):
    # Sources stand for tasks: French texts for an implementation, poor labels for results.
    docs = fx.documents.select("doc_id", c("source").alias("task"), "lang")
    poor = fx.labels.where(c("quality") == 0).select("doc_id")
    return report.task_status(
        docs.select("task").distinct(),
        docs.where(c("lang") == "fr"),
        docs.join(poor, "doc_id", "left_semi"),
    )


def _metrics(fx):
    """Long metric table of detection, extraction and a correction stand-in."""
    # One pass over the predictions; every metric is a row of the wide result.
    metrics = score.answer_metrics(fx.pred, BY)
    parts = {
        category: {f.name: c(f"{column}.{f.name}") for f in metrics.schema[column].dataType}
        for category, column in (("error_detection", "detection"), ("sentence_extraction", "extraction"))
    }
    # English experiments have a composite only, the others a mean score as well.
    f1 = c("detection.f1")
    parts["error_correction"] = {
        "composite_avg": f1,
        "average_score": F.when(c("dataset") != "en", f1 / 2),
    }
    return report.all_metric_rows(metrics, BY, parts)


_D = f"d AS (SELECT *, {R6('tp + tn', 'n')} AS acc, {R6('tp', 'tp + fp')} AS prec, {R6('tp', 'tp + fn')} AS rec, {R6('2.0 * tp', '2 * tp + fp + fn')} AS f1 FROM ({_CONFUSION}) x)"
_E = f"""e AS (SELECT dataset, model, template, {R6(_n(_EXACT), "count(*)")} AS acc, {R6(_n(_EXACT + " AND error_sentence_id > 0"), _n("error_sentence_id > 0"))} AS err
    FROM fx_pred GROUP BY dataset, model, template)"""


@query(
    "leaderboard",
    f"""WITH {_D}, {_E} SELECT d.dataset, d.model, d.template, d.f1 AS error_detection_f1, d.prec AS error_detection_precision, d.rec AS error_detection_recall,
            d.acc AS error_detection_accuracy, e.err AS sentence_extraction_error_accuracy, e.acc AS sentence_extraction_accuracy,
            CASE WHEN d.dataset <> 'en' THEN {R6("1.0 * tp", "2 * tp + fp + fn")} END AS error_correction_average_score, d.f1 AS error_correction_composite_avg,
            CAST(NULL AS DOUBLE) AS error_correction_rouge_1_f, CAST(NULL AS DOUBLE) AS error_correction_bleurt, CAST(NULL AS DOUBLE) AS error_correction_bertscore_f1
        FROM d JOIN e ON d.dataset = e.dataset AND d.model = e.model AND d.template = e.template""",
    ["pred"],
)
def _(fx):
    return report.leaderboard(report.displayed_metrics(_metrics(fx)), BY)


@query(
    "displayed_metrics",
    """SELECT metric, CAST(count(*) AS BIGINT) AS experiments FROM (SELECT DISTINCT dataset, model, template FROM fx_pred) x
       CROSS JOIN (SELECT unnest(['error_detection_accuracy', 'error_detection_precision', 'error_detection_recall', 'error_detection_f1', 'sentence_extraction_accuracy',
                                  'sentence_extraction_exact_match', 'sentence_extraction_error_accuracy', 'error_correction_composite_avg', 'error_correction_average_score']) AS metric) m
       WHERE metric <> 'error_correction_average_score' OR dataset <> 'en' GROUP BY metric""",
    ["pred"],
)
def _(fx):
    shown = report.displayed_metrics(_metrics(fx))
    return shown.groupBy("metric").agg(F.count(F.lit(1)).alias("experiments"))


@query(
    "overview_metrics",
    f"""WITH {_D}, {_E} SELECT dataset, model, template, 'error_detection' AS category, 'error_detection_f1' AS metric, f1 AS "value" FROM d
        UNION ALL SELECT dataset, model, template, 'sentence_extraction', 'sentence_extraction_error_accuracy', err FROM e
        UNION ALL SELECT dataset, model, template, 'error_correction', 'error_correction_composite_avg', f1 FROM d WHERE dataset = 'en'
        UNION ALL SELECT dataset, model, template, 'error_correction', 'error_correction_average_score', {R6("1.0 * tp", "2 * tp + fp + fn")} FROM d WHERE dataset <> 'en'""",
    ["pred"],
)
def _(fx):
    return report.overview_metrics(_metrics(fx), BY)


@query(
    "judge_overview",
    f"""WITH s AS (SELECT template, count(*) AS n, {_n("unread = 0")} AS ok, {_n("total_issues = 0")} AS valid, sum(CASE WHEN unread = 0 THEN total_issues ELSE 0 END) AS issues,
                {", ".join(f"{_n(x + ' > 0')} AS {x}" for x in K.CRITERIA)} FROM (SELECT template, unread, {JUDGE_COLUMNS} FROM fx_judge) j GROUP BY template)
        SELECT template, 'screening_metrics_overall_valid_rate' AS metric, {R6("valid", "ok")} AS "value" FROM s
        UNION ALL SELECT template, 'screening_metrics_parse_error_rate', {R6("n - ok", "n")} FROM s
        UNION ALL SELECT template, 'screening_metrics_avg_issues_per_sample', {R6("issues", "ok")} FROM s """
    + " ".join(f"UNION ALL SELECT template, 'screening_metrics_{x}_rate', {R6(x, 'ok')} FROM s WHERE {x} > 0" for x in K.CRITERIA),
    ["judge"],
)
def _(fx):
    wide = score.screening_metrics(V.parse_judgments(fx.judge), ["template"])
    names = [n for n in wide.columns if n != "template"]
    rows = report.metric_rows(wide, ["template"], "screening_metrics", names)
    return report.judge_overview(rows).select("template", "metric", "value")


@query(
    "sample_counts",
    f"""WITH {_D} SELECT dataset, model, template, n AS processed, n AS attempted, n - (SELECT count(*) FROM fx_sample) AS delta FROM d""",
    ["pred", "sample"],
)
def _(fx):
    size = fx.sample.agg(F.count(F.lit(1))).scalar()
    return report.sample_counts(_metrics(fx), BY, size)


@query(
    "rank_experiments",
    f"""WITH {_D} SELECT dataset, model, template, f1, CAST(rank() OVER (PARTITION BY dataset ORDER BY f1 DESC) AS INT) AS "rank" FROM d""",
    ["pred"],
)
def _(fx):
    detection = score.detection_metrics(fx.pred, BY)
    rounded = detection.select(*BY, F.round("f1", 6).alias("f1"))
    return report.rank_experiments(rounded, "f1", ["dataset"])


# --- items ------------------------------------------------------------------


@query(
    "dataset_stats",
    """SELECT count(*) AS total_samples, count(*) FILTER (WHERE error_flag = 1) AS with_errors, count(*) FILTER (WHERE error_flag = 0) AS without_errors,
              count(DISTINCT coalesce(error_type, 'None')) AS error_types FROM fx_sample""",
    ["sample"],
)
def _(fx):
    return report.dataset_stats(fx.sample)


@query(
    "type_distribution",
    "SELECT coalesce(error_type, 'None') AS error_type, count(*) AS items FROM fx_sample GROUP BY 1",
    ["sample"],
)
def _(fx):
    return report.type_distribution(fx.sample)


@query(
    "lookup_predictions",
    f"""SELECT s.sample_id, p.model, p.template, p.ed_pred, p.se_pred, s.error_flag FROM fx_sample s JOIN fx_pred p ON s.sample_id = p.sample_id WHERE {CHOSEN}""",
    ["sample", "pred"],
)
def _(fx):
    items = fx.sample.select("sample_id", "error_flag")
    return report.lookup_predictions(items, fx.pred, MODELS)


_ITEM_ACCURACY = f"""a AS (SELECT s.ord, s.sample_id, {R6(_n("(ed_pred = 1) = (p.error_flag = 1)"), "count(p.ord)")} AS detection,
    {R6(_n("p.error_flag = 1 AND se_pred = p.error_sentence_id"), _n("p.error_flag = 1 AND p.error_sentence_id IS NOT NULL"))} AS extraction
    FROM fx_sample s LEFT JOIN (SELECT * FROM fx_pred WHERE {CHOSEN}) p ON s.sample_id = p.sample_id GROUP BY s.ord, s.sample_id)"""


@query(
    "sample_model_accuracy",
    f"WITH {_ITEM_ACCURACY} SELECT sample_id, detection, extraction FROM a",
    ["sample", "pred"],
)
def _(fx):
    return report.sample_model_accuracy(fx.sample, fx.pred, MODELS)


def _sorted(fx, key):
    scores = report.sample_model_accuracy(fx.sample, fx.pred, MODELS)
    items = fx.sample.select("ord", "sample_id").join(scores, "sample_id")
    return report.sort_samples(items, key).select("sample_id", "place")


def _sort_query(name, key, order):
    sql = f"WITH {_ITEM_ACCURACY} SELECT sample_id, row_number() OVER (ORDER BY {order}) - 1 AS place FROM a"

    @query(name, sql, ["sample", "pred"])
    def _(fx):
        return _sorted(fx, key)


_sort_query("sort_samples", "error_detection_desc", "detection DESC, sample_id DESC")
_sort_query("sort_samples_extraction", "sentence_extraction_error_accuracy_asc", "extraction, sample_id")
_sort_query("sort_samples_id", "sample_id", "sample_id")
_sort_query("sort_samples_original", "original_order", "ord")


def _scored(fx):
    """Composite per answer: 1 for a right id, half for a right detection, else 0."""
    right = F.when(c("se_pred") == F.coalesce("error_sentence_id", F.lit(0)), 1.0).when(
        c("ed_pred") == c("error_flag"), 0.5
    )
    # Spanish answers were never scored.
    right = F.when(c("lang") != "es", F.coalesce(right, F.lit(0.0)))
    return fx.pred.where(c("model").isin(*MODELS)).select(
        "sample_id", right.alias("composite")
    )


_COMPOSITE = f"""m AS (SELECT sample_id, avg(CASE WHEN lang = 'es' THEN NULL WHEN se_pred = coalesce(error_sentence_id, 0) THEN 1.0 WHEN ed_pred = error_flag THEN 0.5 ELSE 0 END) AS composite
    FROM fx_pred WHERE {CHOSEN} GROUP BY sample_id)"""


@query(
    "sample_composite",
    f"WITH {_COMPOSITE} SELECT s.sample_id, round(composite, 6)::DOUBLE AS composite FROM fx_sample s LEFT JOIN m ON s.sample_id = m.sample_id",
    ["sample", "pred"],
)
def _(fx):
    return report.sample_composite(fx.sample, _scored(fx))


@query(
    "sort_samples_composite",
    f"""WITH {_COMPOSITE} SELECT s.sample_id, row_number() OVER (ORDER BY coalesce(round(composite, 6), 0) DESC, s.sample_id DESC) - 1 AS place
        FROM fx_sample s LEFT JOIN m ON s.sample_id = m.sample_id""",
    ["sample", "pred"],
)
def _(fx):
    scores = report.sample_composite(fx.sample, _scored(fx))
    rounded = scores.withColumn("composite", F.round("composite", 6))
    items = fx.sample.select("ord", "sample_id").join(rounded, "sample_id")
    return report.sort_samples(items, "error_correction_top_metric_desc").select("sample_id", "place")


def _avg(name: str) -> str:
    return f"round(avg(CASE WHEN unread = 1 THEN 0 ELSE {name} END), 6)::DOUBLE AS {name}"


@query(
    "sample_screening",
    f"""SELECT sample_id, round(avg(CASE WHEN unread = 1 OR total_issues = 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS validity,
               {", ".join(_avg(x) for x in ["total_issues", *K.CRITERIA])}
        FROM (SELECT sample_id, unread, {JUDGE_COLUMNS} FROM fx_judge) j GROUP BY sample_id""",
    ["judge"],
)
def _(fx):
    return report.sample_screening(V.parse_judgments(fx.judge))


@query(
    "compare_prediction",
    f"""SELECT r.sample_id, model, template, CAST((p1 = 1) = (s.error_flag = 1) AS INT) AS detection_correct,
               CAST(CASE WHEN s.error_flag = 0 THEN p2 = 0 ELSE coalesce(p2 = s.error_sentence_id, false) END AS INT) AS extraction_correct,
               p2 AS predicted_id, s.error_sentence_id AS actual_id,
               CASE WHEN p2 BETWEEN 1 AND s.n_sentences THEN string_split(s.sentences, chr(10))[p2] ELSE '' END AS predicted_sentence,
               coalesce(s.error_sentence, '') AS actual_sentence, pc AS predicted_correction, coalesce(s.corrected_sentence, '') AS actual_correction
        FROM (SELECT *, ed_pred AS p1, se_pred AS p2,
                     CASE WHEN ed_pred = 1 THEN answer_text
                          WHEN contains(content, 'CORRECT') THEN '' ELSE 'PARSE_FAILED' END AS pc FROM fx_response) r
        JOIN fx_sample s ON r.sample_id = s.sample_id""",
    ["response", "sample"],
)
def _(fx):
    answers = fx.response.select("sample_id", "model", "template", "content")
    return report.compare_prediction(fx.sample, A.parse_answers(answers))


@query(
    "compare_judgment",
    f"""SELECT sample_id, template, CAST(total_issues = 0 AS INT) AS is_valid, CAST(total_issues AS BIGINT) AS total_issues,
               {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in K.CRITERIA)}, CASE WHEN unread = 1 THEN 'Parse error' ELSE concat('seen in ', lang) END AS explanation,
               error_flag AS has_error, coalesce(error_type, 'None') AS error_type
        FROM (SELECT sample_id, template, unread, lang, error_flag, error_type, {JUDGE_COLUMNS} FROM fx_judge) j""",
    ["judge"],
)
def _(fx):
    judged = V.parse_judgments(fx.judge.select("sample_id", "template", "output"))
    return report.compare_judgment(fx.sample, judged)
