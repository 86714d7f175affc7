"""Queries over the two whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.functions import reasoning as R
from textbench.operators import train
from textbench.plans import flows
from textbench.plans.curate_queries import _ACCURACY, _KNOWN, _STAGED, _VERDICT, MODELS
from textbench.plans.registry import query
from textbench.plans.score_queries import _RIGHT, BY, R6, _n

c = F.col


def second_sentence():
    """Points at sentence two of every text of several sentences."""

    def respond(rows):
        texts = [row["messages"][1]["content"] for row in rows]
        return [{"content": "2: x" if "\n2. " in t else "CORRECT"} for t in texts]

    return respond


def silent():
    def respond(rows):
        raise TimeoutError("no service")

    return respond


_ANSWERED = """(SELECT template, model, error_flag, coalesce(error_sentence_id, 0) AS ref,
    CASE WHEN model = 'silent' THEN -1 WHEN n_sentences > 1 THEN 1 ELSE 0 END AS ed,
    CASE WHEN model = 'silent' THEN -1 WHEN n_sentences > 1 THEN 2 ELSE 0 END AS se,
    CASE WHEN model = 'silent' OR n_sentences > 1 THEN CASE WHEN error_flag = 1 THEN 'pair' ELSE 'none' END
         WHEN error_flag = 1 THEN 'wrong' ELSE 'right' END AS kind
    FROM fx_sample CROSS JOIN (SELECT unnest(['short', 'long']) AS template) t CROSS JOIN (SELECT unnest(['second', 'silent']) AS model) m) a"""


@query(
    "evaluate",
    f"""SELECT model, template, {R6("tp + tn", "n")} AS accuracy, {R6("tp", "tp + fp")} AS "precision", {R6("tp", "tp + fn")} AS recall,
               {R6("2.0 * tp", "2 * tp + fp + fn")} AS f1, {R6("ex", "n")} AS exact_match, {R6("er", "errors")} AS error_accuracy,
               pairs AS correction_pairs, {R6("good", "good + bad", "1")} AS no_error_accuracy, {R6("good", "n")} AS correction_composite
        FROM (SELECT model, template, count(*) AS n, {_n("error_flag = 1 AND ed = 1")} AS tp, {_n("error_flag = 0 AND ed <> 0")} AS fp,
                     {_n("error_flag = 0 AND ed = 0")} AS tn, {_n("error_flag = 1 AND ed <> 1")} AS fn,
                     {_n("se = ref AND se <> -1")} AS ex, {_n("ref > 0")} AS errors, {_n("ref > 0 AND se = ref")} AS er,
                     {_n("kind = 'pair'")} AS pairs, {_n("kind = 'right'")} AS good, {_n("kind = 'wrong'")} AS bad
              FROM {_ANSWERED} GROUP BY model, template) x""",
    ["sample"],
)
def _(fx):
    templates = {
        "short": ("You review texts.", "{sentences}"),
        "long": ("You review texts.", "Find the error in:\n{sentences}\nAnswer with its number."),
    }
    items = fx.sample.select(
        "ord", "sample_id", "sentences", "error_flag", "error_sentence_id", "corrected_sentence"
    )
    answered = flows.evaluate(
        items, templates, {"second": second_sentence, "silent": silent}, {"sentences": c("sentences")}
    )
    return flows.evaluation_metrics(answered)


@query(
    "build_benchmark",
    f"""{_STAGED.replace(_KNOWN, _ACCURACY)}, {_VERDICT}, kept AS (SELECT ord, sample_id, grp FROM filtered WHERE split = 'adopted'),
        g AS (SELECT grp, min(ord) AS first, count(*) AS size FROM kept GROUP BY grp),
        k AS (SELECT grp, size, row_number() OVER (ORDER BY first) - 1 AS k FROM g WHERE size > 1),
        r AS (SELECT kept.*, row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS place FROM kept)
        SELECT r.ord, r.sample_id, is_valid FROM r LEFT JOIN k ON r.grp = k.grp LEFT JOIN v ON r.sample_id = v.sample_id
        WHERE (k.grp IS NULL OR place = k % size) AND coalesce(is_valid, 1) = 1""",
    ["pred", "sample", "judge"],
)
def _(fx):
    limits = fx.spark.createDataFrame(
        [("default", 1, 7, 0.3), ("type2", 3, 9, 0.2)],
        "error_type string, stage1_min_models int, stage1_max_models int, stage2_max_diff double",
    )
    items = fx.sample.select(
        "ord", "sample_id", "sentences", "error_flag", "error_type", "error_sentence_id", "corrected_sentence"
    )
    built = flows.build_benchmark(items, fx.pred, limits, fx.judge, MODELS)
    return built.select("ord", "sample_id", "is_valid")


# Two models answer every question; choice c is an error record without a known sentence.
@query(
    "synthesis_to_benchmark",
    """WITH i AS (SELECT question_id, ord * 5 + p AS ord, concat(question_id, '_', ch) AS base
            FROM fx_synth CROSS JOIN (SELECT unnest(['a', 'b', 'd', 'e']) AS ch, unnest([0, 1, 3, 4]) AS p) x WHERE ch <> 'e' OR lang <> 'en'),
        k AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS k FROM i)
        SELECT concat(base, '_writer', CAST(k % 2 AS VARCHAR)) AS sample_id, concat('writer', CAST(k % 2 AS VARCHAR)) AS source_model FROM k""",
    ["synth"],
)
def _(fx):
    writer = F.explode(F.array(F.lit("writer0"), F.lit("writer1")))
    asked = fx.synth.select("ord", "question_id", "content", writer.alias("model"))
    items = flows.synthesis_to_items(asked, ["writer0", "writer1"])
    return items.select("sample_id", "source_model")


@query(
    "training_rows",
    f"""SELECT model, template, ord, CASE WHEN {_RIGHT} THEN 'correct' WHEN error_flag = 1 THEN 'incorrect_error_flag_1' ELSE 'incorrect_error_flag_0' END AS split,
               content, CASE WHEN lang = 'en' THEN 'Fine.' ELSE '' END AS reasoning, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS INT) AS removed_sentences
        FROM fx_response""",
    ["response"],
)
def _(fx):
    # English answers come with two sentences of reasoning, one of them to be removed.
    rows = fx.response.withColumns(
        {
            "reasoning": F.when(c("lang") == "en", "Fine. We are told that x holds."),
            "response_model": F.lit(None).cast("string"),
        }
    )
    samples = rows.select(*BY, "ord", "error_flag")
    answers = rows.select(*BY, "ord", "content", "reasoning", "response_model")
    out = flows.training_rows(samples, train.details_of(rows, BY), answers, BY, R.PATTERN_EN)
    return out.select("model", "template", "ord", "split", "content", "reasoning", "removed_sentences")
