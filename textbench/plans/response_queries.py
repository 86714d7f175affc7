"""Queries over runs, responses, retries and the responder."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.operators import prompts, responses
from textbench.plans.registry import query
from textbench.plans.score_queries import R6, _n
from textbench.session import scratch_path
from textbench.streaming import metrics

c = F.col
BY = ["model", "template"]
FAILED = "(coalesce(error, '') <> '' OR trim(content) = '')"


@query(
    "experiment_grid",
    """SELECT model, dataset, template FROM (SELECT DISTINCT model FROM fx_pred) m
       CROSS JOIN (SELECT unnest(['en', 'fr', 'xx']) AS dataset) d CROSS JOIN (SELECT unnest(['t0', 't1']) AS template) t""",
    ["pred"],
)
def _(fx):
    models = fx.pred.select("model").distinct()
    return responses.experiment_grid(models, dataset=["en", "fr", "xx"], template=["t0", "t1"])


def _latest_sql(condition: str) -> str:
    return f"""SELECT a.model, a.template, a.dataset, a.run_ts, a.ord FROM fx_attempt a JOIN
        (SELECT dataset, model, template, max(run_ts) AS run_ts FROM fx_attempt WHERE {condition} GROUP BY dataset, model, template) m
        ON a.dataset = m.dataset AND a.model = m.model AND a.template = m.template AND a.run_ts = m.run_ts"""


def _latest(fx, rule):
    attempts = fx.attempt
    return responses.latest_run(attempts, ["dataset", *BY], rule).select(
        *BY, "dataset", "run_ts", "ord"
    )


@query("latest_run", _latest_sql("run_ts LIKE '________\\_______' ESCAPE '\\' AND run_ts LIKE '2%'"), ["attempt"])
def _(fx):
    return _latest(fx, "stamp")


@query("latest_run_by_name", _latest_sql("true"), ["attempt"])
def _(fx):
    return _latest(fx, "name")


@query("latest_run_underscore", _latest_sql("length(run_ts) - length(replace(run_ts, '_', '')) = 1"), ["attempt"])
def _(fx):
    return _latest(fx, "underscore")


@query(
    "latest_run_by_mtime",
    _latest_sql("true").replace("max(run_ts)", "min(run_ts)"),
    ["attempt"],
)
def _(fx):
    # The first run was touched last, the copy first.
    touched = F.when(c("run_ts") == "20240101_000000", 2).when(c("run_ts") == "20240101_000001", 1).otherwise(0)
    runs = fx.attempt.withColumn("modified", touched)
    return responses.latest_run(runs, ["dataset", *BY], "mtime").select(
        *BY, "dataset", "run_ts", "ord"
    )


def _run(fx, stamp):
    return fx.attempt.where(c("run_ts") == stamp)


@query(
    "pending_samples",
    f"""SELECT p.model, p.template, p.ord FROM fx_pred p LEFT JOIN
        (SELECT * FROM fx_attempt WHERE run_ts = '20240101_000000' AND NOT {FAILED}) a
        ON p.model = a.model AND p.template = a.template AND p.ord = a.ord WHERE a.ord IS NULL""",
    ["pred", "attempt"],
)
def _(fx):
    items = fx.pred.select(*BY, "ord")
    return responses.pending_samples(items, _run(fx, "20240101_000000"), BY)


@query(
    "merge_responses",
    # Run 1 asks again for German items only, and what unlabelled ones get is empty again.
    """SELECT model, template, ord, CASE WHEN lang = 'de' AND quality IS NULL THEN '' ELSE content END AS content,
              CASE WHEN lang = 'de' AND quality IS NULL AND n_sentences > 5 THEN 'timeout' END AS error
       FROM fx_response WHERE lang = 'de' OR NOT (lang = 'es' AND quality IS NULL)""",
    ["response"],
)
def _(fx):
    columns = [*BY, "ord", "content", "error"]
    old, new = (_run(fx, f"20240101_00000{i}").select(*columns) for i in (0, 1))
    return responses.merge_responses(old, new, BY)


@query(
    "stream_metrics",
    f"""SELECT model, template, tp, fp, tn, fn, n, round((tp + tn) / n::DOUBLE, 6)::DOUBLE AS accuracy, {R6("2.0 * tp", "2 * tp + fp + fn")} AS f1 FROM (
        SELECT model, template, {_n("error_flag = 1 AND p = 1")} AS tp, {_n("error_flag = 0 AND p <> 0")} AS fp,
               {_n("error_flag = 0 AND p = 0")} AS tn, {_n("error_flag = 1 AND p <> 1")} AS fn, count(*) AS n
        FROM (SELECT *, CASE WHEN lang = 'de' AND quality IS NULL THEN -1 ELSE ed_pred END AS p FROM fx_response
              WHERE lang = 'de' OR NOT (lang = 'es' AND quality IS NULL)) r GROUP BY model, template) x""",
    ["response"],
)
def _(fx):
    # The answers of run 0 arrive first, then those of run 1, which replace what they repeat.
    flags = fx.response.select(*BY, "ord", "error_flag")
    source, target, marks = (scratch_path(fx.spark, n) for n in ("arriving", "counts", "marks"))
    for i in (0, 1):
        arrived = _run(fx, f"20240101_00000{i}").join(flags, [*BY, "ord"])
        arrived = arrived.select(*BY, "run_ts", "ord", "error_flag", "content")
        arrived.write.mode("append").parquet(source)
        schema = ", ".join(f"{n} {t}" for n, t in arrived.dtypes)
        metrics.metrics_stream(fx.spark, source, target, marks, BY, schema).awaitTermination()
    return metrics.current_metrics(fx.spark, target, BY).select(*BY, "tp", "fp", "tn", "fn", "n", "accuracy", "f1")


@query(
    "incomplete_work",
    f"""SELECT model, template, count(*) AS responses, {_n(FAILED)} AS failed, CASE WHEN {_n(FAILED)} > 0 THEN 'partially_completed' ELSE 'completed' END AS status
        FROM (SELECT a.* FROM fx_attempt a JOIN (SELECT model, template, max(run_ts) AS run_ts FROM fx_attempt WHERE run_ts LIKE '2%' GROUP BY model, template) m
              ON a.model = m.model AND a.template = m.template AND a.run_ts = m.run_ts) l GROUP BY model, template""",
    ["attempt"],
)
def _(fx):
    return responses.incomplete_work(responses.latest_run(fx.attempt, BY), BY)


@query(
    "failure_streaks",
    """SELECT model, template, run_ts, min(ord) AS stops_at FROM
       (SELECT *, lag(coalesce(error, '') <> '') OVER (PARTITION BY model, template, run_ts ORDER BY ord) AS before FROM fx_attempt) x
       WHERE coalesce(error, '') <> '' AND before GROUP BY model, template, run_ts""",
    ["attempt"],
)
def _(fx):
    bad = F.coalesce(c("error") != "", F.lit(False))
    return responses.failure_streaks(fx.attempt, [*BY, "run_ts"], bad)


@query(
    "interaction_index",
    "SELECT ord, CASE WHEN ord < 999 THEN lpad(CAST(ord + 1 AS VARCHAR), 3, '0') ELSE CAST(ord + 1 AS VARCHAR) END AS interaction_index FROM fx_sample",
    ["sample"],
)
def _(fx):
    from textbench.functions.text import interaction_index

    return fx.sample.select("ord", interaction_index(c("ord")).alias("interaction_index"))


def echo_responder():
    """Answers with the length of the prompt; refuses German texts."""

    def respond(rows):
        return [
            {"error": "refused"}
            if row["lang"] == "de"
            else {"content": f"{len(row['prompt'])}: ok", "reasoning": row["sample_id"]}
            for row in rows
        ]

    return respond


def _prompts(fx):
    text = prompts.render("Find the error.\n{sentences}", {"sentences": c("sentences")})
    return fx.sample.select("ord", "sample_id", "lang", text.alias("prompt"))


@query(
    "apply_responder",
    """SELECT ord, CASE WHEN lang <> 'de' THEN concat(CAST(16 + length(sentences) AS VARCHAR), ': ok') END AS content,
              CASE WHEN lang <> 'de' THEN sample_id END AS reasoning, CASE WHEN lang = 'de' THEN 'refused' END AS error FROM fx_sample""",
    ["sample"],
)
def _(fx):
    return responses.apply_responder(_prompts(fx), echo_responder, ["ord"])


@query(
    "resume_rounds",
    """SELECT ord, sample_id, CASE WHEN lang <> 'de' THEN concat(CAST(16 + length(sentences) AS VARCHAR), ': ok') END AS content,
              CASE WHEN lang = 'de' THEN 'refused' END AS error FROM fx_sample""",
    ["sample"],
)
def _(fx):
    # German prompts fail in every round, so all rounds are used up.
    merged, _ = responses.resume_rounds(fx.spark, _prompts(fx), echo_responder, ["sample_id"], 2)
    return merged.select("ord", "sample_id", "content", "error")
