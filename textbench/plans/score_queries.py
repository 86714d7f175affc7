"""Queries over metrics, training rows and cleaned reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import reasoning as R
from textbench.functions import text as T
from textbench.functions import verdicts as V
from textbench.functions.rouge import rouge
from textbench.operators import score, train
from textbench.plans.answer_queries import JUDGE_COLUMNS
from textbench.plans.registry import query

c = F.col
BY = ["model", "template"]


def R6(top: str, bottom: str, otherwise: str = "0") -> str:
    """Guarded division in SQL."""
    return f"round(CASE WHEN {bottom} = 0 THEN {otherwise} ELSE ({top})::DOUBLE / ({bottom}) END, 6)::DOUBLE"


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


# --- detection and extraction -----------------------------------------------

_CONFUSION = f"""SELECT dataset, model, template, {_n("error_flag = 1 AND ed_pred = 1")} AS tp, {_n("error_flag = 0 AND ed_pred <> 0")} AS fp,
    {_n("error_flag = 0 AND ed_pred = 0")} AS tn, {_n("error_flag = 1 AND ed_pred <> 1")} AS fn, count(*) AS n
    FROM fx_pred GROUP BY dataset, model, template"""
_F1 = R6("2.0 * tp", "2 * tp + fp + fn")


@query(
    "detection_metrics",
    f"""SELECT dataset, model, template, tp, fp, tn, fn, n, {R6("tp + tn", "n")} AS accuracy, {R6("tp", "tp + fp")} AS "precision",
               {R6("tp", "tp + fn")} AS recall, {_F1} AS f1 FROM ({_CONFUSION}) x""",
    ["pred"],
)
def _(fx):
    return score.detection_metrics(fx.pred, ["dataset", *BY])


@query(
    "detection_per_item",
    """SELECT model, template, ord, CASE WHEN error_flag = 1 THEN CASE WHEN ed_pred = 1 THEN 'tp' ELSE 'fn' END
              WHEN ed_pred = 0 THEN 'tn' ELSE 'fp' END AS outcome, CAST(ed_pred = error_flag AS INT) AS is_correct FROM fx_pred""",
    ["pred"],
)
def _(fx):
    return score.detection_per_item(fx.pred).select(*BY, "ord", "outcome", "is_correct")


@query(
    "precision_recall_points",
    f"""SELECT dataset, model, template, {R6("tp", "tp + fn")} AS x, {R6("tp", "tp + fp")} AS y FROM ({_CONFUSION}) c""",
    ["pred"],
)
def _(fx):
    from textbench.operators.report import precision_recall_points

    by = ["dataset", *BY]
    return precision_recall_points(score.detection_metrics(fx.pred, by), by)


_EXACT = "se_pred = coalesce(error_sentence_id, 0) AND se_pred <> -1"


@query(
    "extraction_metrics",
    f"""SELECT *, {R6("exact_matches", "total_samples")} AS accuracy, {R6("exact_matches", "total_samples")} AS exact_match,
               {R6("m", "error_samples")} AS error_accuracy FROM
        (SELECT model, template, count(*) AS total_samples, {_n("error_sentence_id > 0")} AS error_samples,
                {_n(_EXACT)} AS exact_matches, {_n(_EXACT + " AND error_sentence_id > 0")} AS m
         FROM fx_pred GROUP BY model, template) x""".replace("SELECT *,", "SELECT model, template, total_samples, error_samples, exact_matches,"),
    ["pred"],
)
def _(fx):
    return score.extraction_metrics(fx.pred, BY)


@query(
    "extraction_per_item",
    f"""SELECT model, template, ord, CAST({_EXACT} AS INT) AS is_exact_match, CAST(coalesce(error_sentence_id, 0) > 0 AS INT) AS has_error,
               CAST({_EXACT} AND error_sentence_id IS NOT NULL AS INT) AS is_correct_on_error FROM fx_pred""",
    ["pred"],
)
def _(fx):
    return score.extraction_per_item(fx.pred).select(
        *BY, "ord", "is_exact_match", "has_error", "is_correct_on_error"
    )


# --- correction -------------------------------------------------------------

_CLEAN = """(SELECT ord, dataset, trim(regexp_replace(prediction, '^\\s+|\\s+$', '', 'g'), '"') AS p,
    trim(regexp_replace(reference, '^\\s+|\\s+$', '', 'g'), '"') AS r FROM fx_pair)"""
_KIND = """CASE WHEN p = '' THEN 'silent' WHEN p = 'CORRECT' THEN CASE WHEN r = '' THEN 'right' ELSE 'wrong' END
    WHEN r = '' THEN 'spare' ELSE 'pair' END"""
_LANGUAGE = r"""CASE WHEN trim(r) = '' THEN NULL
    WHEN length(regexp_replace(r, '[^a-zA-Z]', '', 'g')) > 0.5 * length(regexp_replace(r, '\s', '', 'g')) THEN 'en' ELSE 'unknown' END"""
# Words or characters by the majority of the references of a dataset.
_TOKENS = f"""c AS {_CLEAN}, lang AS (SELECT dataset, CASE WHEN en >= un AND en > 0 THEN 'en' WHEN un > 0 THEN 'unknown' ELSE 'ja' END AS language
    FROM (SELECT dataset, {_n("l = 'en'")} AS en, {_n("l = 'unknown'")} AS un
          FROM (SELECT dataset, {_LANGUAGE} AS l FROM (SELECT dataset, reference AS r FROM fx_pair) a) b GROUP BY dataset) d),
    t AS (SELECT c.*, {_KIND} AS kind,
          CASE WHEN language = 'en' THEN regexp_extract_all(lower(p), '[a-z0-9]+') ELSE string_split(p, '') END AS pt,
          CASE WHEN language = 'en' THEN regexp_extract_all(lower(r), '[a-z0-9]+') ELSE string_split(r, '') END AS rt
          FROM c JOIN lang ON c.dataset = lang.dataset)"""


def _grams(n: int) -> str:
    def of(side):
        if n == 1:
            return f"{side}t"
        return f"list_transform(range(1, len({side}t)), lambda i: {side}t[i] || ' ' || {side}t[i + 1])"

    return f"""g{n} AS (SELECT ord, g, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y FROM
        (SELECT ord, unnest({of("p")}) AS g, 1 AS x, 0 AS y FROM t WHERE kind = 'pair'
         UNION ALL SELECT ord, unnest({of("r")}), 0, 1 FROM t WHERE kind = 'pair') u GROUP BY ord, g),
      f{n} AS (SELECT ord, CASE WHEN hit = 0 THEN 0.0 ELSE 2.0 * hit / (np + nr) END AS f{n}
               FROM (SELECT ord, sum(least(x, y)) AS hit, sum(x) AS np, sum(y) AS nr FROM g{n} GROUP BY ord) s)"""


# A prediction's words lie in the reference in order, but for the last one in odd turns.
_LONGEST = "fl AS (SELECT ord, CASE WHEN p = 'PARSE_FAILED' THEN 0.0 ELSE 2.0 * (len(pt) - ord % 2) / (len(pt) + len(rt)) END AS fl FROM t WHERE kind = 'pair')"
_ROUGE = f"WITH {_TOKENS}, {_grams(1)}, {_grams(2)}, {_LONGEST}"


@query(
    "rouge",
    f"""{_ROUGE} SELECT t.ord, round(coalesce(f1, 0), 6)::DOUBLE AS rouge_1_f, round(coalesce(f2, 0), 6)::DOUBLE AS rouge_2_f
        FROM t LEFT JOIN f1 ON t.ord = f1.ord LEFT JOIN f2 ON t.ord = f2.ord WHERE kind = 'pair'""",
    ["pair"],
)
def _(fx):
    scored = score.correction_per_item(fx.pair, ["dataset"], "ord")
    return scored.where("is_pair").select("ord", "rouge.rouge_1_f", "rouge.rouge_2_f")


@query(
    "rouge_l",
    """SELECT ord, round(CASE WHEN len(p) * len(r) = 0 OR prediction IN ('PARSE_FAILED', '"CORRECT"') THEN 0
                            ELSE 2.0 * (len(p) - ord % 2) / (len(p) + len(r)) END, 6)::DOUBLE AS rouge_l_f
       FROM (SELECT ord, prediction, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p,
                    regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM fx_pair) x""",
    ["pair"],
)
def _(fx):
    tokens = fx.pair.select(
        "ord",
        T.word_tokens(c("prediction")).alias("p"),
        T.word_tokens(c("reference")).alias("r"),
    )
    return tokens.select("ord", rouge(c("p"), c("r")).alias("x")).select("ord", "x.rouge_l_f")


@query(
    "pair_counters",
    f"""SELECT dataset, count(*) AS total_texts, {_n("r = ''")} AS reference_na, {_n("p <> ''")} AS system_texts,
               {_n("p = 'CORRECT'")} AS system_na, {_n("kind = 'right'")} AS correct_na, {_n("kind = 'wrong'")} AS incorrect_na,
               {_n("kind = 'pair'")} AS pairs
        FROM (SELECT dataset, p, r, {_KIND} AS kind FROM {_CLEAN} c) x GROUP BY dataset""",
    ["pair"],
)
def _(fx):
    return score.pair_counters(fx.pair, ["dataset"])


@query(
    "pair_counters_all",
    f"""SELECT dataset, count(*) AS total_texts, {_n("r = ''")} AS reference_na, count(*) AS system_texts,
               {_n("p IN ('', 'CORRECT')")} AS system_na, {_n("p IN ('', 'CORRECT') AND r = ''")} AS correct_na,
               {_n("p IN ('', 'CORRECT') AND r <> ''")} AS incorrect_na, {_n("kind = 'pair'")} AS pairs
        FROM (SELECT dataset, p, r, {_KIND} AS kind FROM {_CLEAN} c) x GROUP BY dataset""",
    ["pair"],
)
def _(fx):
    # The option that credits an empty answer as "no error".
    return score.pair_counters(fx.pair, ["dataset"], count_empty_na=True)


@query(
    "correction_metrics",
    f"""{_ROUGE} SELECT dataset, n AS total_samples, pairs AS error_samples, n - pairs AS no_error_samples, good AS correct_na, bad AS incorrect_na,
               round(s1 / nullif(pairs, 0), 6)::DOUBLE AS rouge_1_f, round(s2 / nullif(pairs, 0), 6)::DOUBLE AS rouge_2_f,
               round(sl / nullif(pairs, 0), 6)::DOUBLE AS rouge_l_f,
               round(s1 / nullif(pairs, 0), 6)::DOUBLE AS average_score,
               {R6("s1 + good", "n")} AS rouge_1_composite, {R6("s1 + good", "n")} AS composite_avg, {R6("good", "good + bad", "1")} AS no_error_accuracy
        FROM (SELECT dataset, count(*) AS n, {_n("kind = 'pair'")} AS pairs, {_n("kind = 'right'")} AS good, {_n("kind = 'wrong'")} AS bad,
                     sum(CASE WHEN kind = 'pair' THEN coalesce(f1, 0) END) AS s1, sum(CASE WHEN kind = 'pair' THEN coalesce(f2, 0) END) AS s2,
                     sum(CASE WHEN kind = 'pair' THEN fl END) AS sl
              FROM t LEFT JOIN f1 ON t.ord = f1.ord LEFT JOIN f2 ON t.ord = f2.ord LEFT JOIN fl ON t.ord = fl.ord GROUP BY dataset) x""",
    ["pair"],
)
def _(fx):
    return score.correction_metrics(fx.pair, ["dataset"], "ord")


@query(
    "correction_per_item",
    f"""{_ROUGE} SELECT t.ord, CAST(p = 'PARSE_FAILED' OR p IN ('', 'CORRECT') OR r = '' AS INT) AS is_na,
               round(CASE WHEN p = 'PARSE_FAILED' THEN 0 WHEN p IN ('', 'CORRECT') AND r = '' THEN 1 WHEN p IN ('', 'CORRECT') OR r = '' THEN 0 ELSE coalesce(f1, 0) END, 6)::DOUBLE AS score_1,
               round(CASE WHEN p = 'PARSE_FAILED' THEN 0 WHEN p IN ('', 'CORRECT') AND r = '' THEN 1 WHEN p IN ('', 'CORRECT') OR r = '' THEN 0 ELSE coalesce(f2, 0) END, 6)::DOUBLE AS score_2
        FROM t LEFT JOIN f1 ON t.ord = f1.ord LEFT JOIN f2 ON t.ord = f2.ord""",
    ["pair"],
)
def _(fx):
    scored = score.correction_per_item(fx.pair, ["dataset"], "ord")
    return scored.select("ord", c("na.is_na").alias("is_na"), "score_1", "score_2")


@query(
    "correction_composite",
    f"""{_ROUGE} SELECT ord, dataset, round(CASE WHEN fixed >= 0 THEN fixed ELSE fl END, 6)::DOUBLE AS score_l,
               round(CASE WHEN fixed >= 0 THEN fixed ELSE (f1 + f2 + fl) / 3 END, 6)::DOUBLE AS composite
        FROM (SELECT t.ord, dataset, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(fl, 0) AS fl,
                     CASE WHEN p = 'PARSE_FAILED' THEN 0 WHEN p IN ('', 'CORRECT') AND r = '' THEN 1 WHEN p IN ('', 'CORRECT') OR r = '' THEN 0 ELSE -1 END AS fixed
              FROM t LEFT JOIN f1 ON t.ord = f1.ord LEFT JOIN f2 ON t.ord = f2.ord LEFT JOIN fl ON t.ord = fl.ord) x""",
    ["pair"],
)
def _(fx):
    scored = score.correction_per_item(fx.pair, ["dataset"], "ord")
    return scored.select("ord", "dataset", "score_l", "composite")


def length_scorer():
    """A plain scorer: how close the lengths are, on a scale that needs clipping."""

    def run(predictions, references):
        return [1.5 - 2 * abs(len(p) - len(r)) / (len(p) + len(r)) for p, r in zip(predictions, references)]

    return run


_LENGTHS = "1.5 - 2.0 * abs(length(p) - length(r)) / (length(p) + length(r))"


@query(
    "apply_pair_scorer",
    f"""SELECT ord, CASE WHEN {_KIND} = 'pair' THEN round(least(greatest({_LENGTHS}, 0), 1), 6)::DOUBLE END AS closeness
        FROM {_CLEAN} c""",
    ["pair"],
)
def _(fx):
    return score.apply_pair_scorer(fx.pair, length_scorer, "closeness").select("ord", "closeness")


# --- labels and judgments ---------------------------------------------------

_OK = "form > 1"


@query(
    "error_type_metrics",
    f"""SELECT model, n AS total_samples, n - ok AS parse_errors, ok AS valid_samples, correct AS correct_samples, error AS error_samples,
               none AS none_predictions, n0 AS none_for_correct, n1 AS none_for_error, typed AS classified_errors,
               high AS high_confidence, medium AS medium_confidence, low AS low_confidence,
               {R6("n - ok", "n")} AS parse_error_rate, {R6("n0 + typed", "ok")} AS classification_accuracy,
               {R6("typed", "error")} AS error_type_coverage, {R6("error - typed", "correct")} AS false_positive_rate,
               {R6("correct - n0", "correct")} AS typed_for_correct_rate
        FROM (SELECT model, count(*) AS n, {_n(_OK)} AS ok, {_n(_OK + " AND error_flag = 0")} AS correct, {_n(_OK + " AND error_flag = 1")} AS error,
                     {_n(_OK + " AND kind = 'none'")} AS none, {_n(_OK + " AND kind = 'none' AND error_flag = 0")} AS n0,
                     {_n(_OK + " AND kind = 'none' AND error_flag = 1")} AS n1, {_n(_OK + " AND kind <> 'none' AND error_flag = 1")} AS typed,
                     {_n(_OK + " AND level = 'high'")} AS high, {_n(_OK + " AND level = 'medium'")} AS medium, {_n(_OK + " AND level = 'low'")} AS low
              FROM fx_label GROUP BY model) x""",
    ["label"],
)
def _(fx):
    return score.error_type_metrics(V.parse_error_types(fx.label), ["model"])


@query(
    "error_type_distribution",
    f"""SELECT model, kind AS error_type, count(*) AS "count", round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6)::DOUBLE AS rate
        FROM fx_label WHERE {_OK} GROUP BY model, kind""",
    ["label"],
)
def _(fx):
    return score.error_type_distribution(V.parse_error_types(fx.label), ["model"])


@query(
    "error_type_per_item",
    f"""SELECT model, sample_id, kind AS error_type, level AS confidence, CAST((kind = 'none') = (error_flag = 0) AS INT) AS classification_correct
        FROM fx_label WHERE {_OK}""",
    ["label"],
)
def _(fx):
    return score.error_type_per_item(V.parse_error_types(fx.label)).select(
        "model", "sample_id", "label.error_type", "label.confidence", "classification_correct"
    )


@query(
    "screening_metrics",
    f"""SELECT template, n AS total_samples, n - ok AS parse_errors, ok AS valid_samples, valid AS valid_for_benchmark, issues AS total_issues,
               {", ".join(f"{x}_count" for x in K.CRITERIA)},
               {R6("n - ok", "n")} AS parse_error_rate, {R6("valid", "ok")} AS overall_valid_rate, {R6("issues", "ok")} AS avg_issues_per_sample,
               {", ".join(f"{R6(x + '_count', 'ok')} AS {x}_rate" for x in K.CRITERIA)}
        FROM (SELECT template, count(*) AS n, {_n("unread = 0")} AS ok, {_n("total_issues = 0")} AS valid,
                     CAST(sum(CASE WHEN unread = 0 THEN total_issues ELSE 0 END) AS BIGINT) AS issues,
                     {", ".join(f"{_n(x + ' > 0')} AS {x}_count" for x in K.CRITERIA)}
              FROM (SELECT template, unread, {JUDGE_COLUMNS} FROM fx_judge) j GROUP BY template) x""",
    ["judge"],
)
def _(fx):
    return score.screening_metrics(V.parse_judgments(fx.judge), ["template"])


@query(
    "issue_histogram",
    f"""SELECT template, issues, samples, {R6("samples", "ok")} AS rate FROM
        (SELECT template, {_n("unread = 0")} AS ok FROM fx_judge GROUP BY template) a
        JOIN (SELECT b.template, issues, {_n("unread = 0 AND least(total_issues, 6) = issues")} AS samples
              FROM (SELECT template, unread, {JUDGE_COLUMNS} FROM fx_judge) b CROSS JOIN (SELECT CAST(unnest(range(0, 7)) AS INT) AS issues) i
              GROUP BY b.template, issues) c USING (template)""",
    ["judge"],
)
def _(fx):
    return score.issue_histogram(V.parse_judgments(fx.judge), ["template"])


# --- training rows ----------------------------------------------------------

_RIGHT = f"(ed_pred = error_flag AND (error_flag = 0 OR ({_EXACT})))"
_SPLIT = f"CASE WHEN {_RIGHT} THEN 'correct' WHEN error_flag = 1 THEN 'incorrect_error_flag_1' ELSE 'incorrect_error_flag_0' END"


def _split(fx):
    samples = fx.pred.select(*BY, "ord", "sample_id", "error_flag", "lang")
    details = train.details_of(fx.pred, BY)
    return train.correct_samples(train.join_details(samples, details, BY))


@query(
    "join_details",
    f"""SELECT model, template, ord, CAST(ed_pred = error_flag AS INT) AS is_correct, CAST({_EXACT} AS INT) AS is_exact_match FROM fx_pred""",
    ["pred"],
)
def _(fx):
    samples = fx.pred.select(*BY, "ord")
    return train.join_details(samples, train.details_of(fx.pred, BY), BY)


@query(
    "correct_samples",
    f"SELECT model, template, ord, {_SPLIT} AS split FROM fx_pred",
    ["pred"],
)
def _(fx):
    return _split(fx).select(*BY, "ord", "split")


_STATS = f"""SELECT dataset, model, template, count(*) AS total_samples, {_n(_RIGHT)} AS correct_samples, {_n("error_flag = 1")} AS error_samples,
    {_n("error_flag = 0")} AS no_error_samples, {_n(_RIGHT + " AND error_flag = 1")} AS correct_error_samples,
    {_n(_RIGHT + " AND error_flag = 0")} AS correct_no_error_samples, {_n("NOT " + _RIGHT + " AND error_flag = 1")} AS incorrect_error_samples,
    {_n("NOT " + _RIGHT + " AND error_flag = 0")} AS incorrect_no_error_samples
    FROM {{}} GROUP BY dataset, model, template"""


@query(
    "correct_sample_stats",
    f"""SELECT *, {R6("correct_samples", "total_samples")} AS accuracy, {R6("error_samples", "total_samples")} AS error_ratio,
               {R6("no_error_samples", "total_samples")} AS no_error_ratio, {R6("correct_error_samples", "error_samples")} AS error_accuracy,
               {R6("correct_no_error_samples", "no_error_samples")} AS no_error_accuracy,
               {R6("correct_error_samples", "correct_samples")} AS filtered_error_ratio,
               {R6("correct_no_error_samples", "correct_samples")} AS filtered_no_error_ratio
        FROM ({_STATS.format("fx_pred")}) s""",
    ["pred"],
)
def _(fx):
    by = ["dataset", *BY]
    samples = fx.pred.select(*by, "ord", "error_flag")
    split = train.correct_samples(train.join_details(samples, train.details_of(fx.pred, by), by))
    return train.correct_sample_stats(split, by)


# model7 is made to fail everything on French items, so its experiments vanish.
_BROKEN = "(SELECT * REPLACE (CASE WHEN model = 'model7' AND lang = 'fr' THEN -1 ELSE ed_pred END AS ed_pred) FROM fx_pred) p"


@query(
    "extraction_summary",
    f"""WITH s AS (SELECT * FROM ({_STATS.format(_BROKEN)}) x WHERE correct_samples > 0)
        SELECT *, {R6("correct_samples", "total_samples")} AS accuracy FROM (
            SELECT dataset, model, template, CAST(1 AS BIGINT) AS experiments, total_samples, correct_samples, error_samples, no_error_samples,
                   correct_error_samples, correct_no_error_samples, incorrect_error_samples, incorrect_no_error_samples FROM s
            UNION ALL SELECT NULL, NULL, NULL, count(*), {", ".join(f"CAST(sum({x}) AS BIGINT)" for x in
                ["total_samples", "correct_samples", "error_samples", "no_error_samples", "correct_error_samples",
                 "correct_no_error_samples", "incorrect_error_samples", "incorrect_no_error_samples"])} FROM s) y""",
    ["pred"],
)
def _(fx):
    by = ["dataset", *BY]
    lost = (c("model") == "model7") & (c("lang") == "fr")
    preds = fx.pred.withColumn("ed_pred", F.when(lost, -1).otherwise(c("ed_pred")))
    samples = preds.select(*by, "ord", "error_flag")
    split = train.correct_samples(train.join_details(samples, train.details_of(preds, by), by))
    return train.extraction_summary(train.correct_sample_stats(split, by), by)


@query(
    "attach_responses",
    """SELECT r.model, r.template, r.ord, r.sample_id, coalesce(a.content, '') AS content, '' AS reasoning,
              CASE WHEN a.ord IS NOT NULL AND r.lang = 'en' THEN concat('served ', r.model) ELSE r.model END AS source_model
       FROM fx_response r LEFT JOIN (SELECT * FROM fx_attempt WHERE run_ts = '20240101_000000') a
       ON r.model = a.model AND r.template = a.template AND r.ord = a.ord""",
    ["response", "attempt"],
)
def _(fx):
    # Only English responses name the model that served them.
    served = F.when(c("dataset") == "en", F.concat(F.lit("served "), c("model")))
    run = fx.attempt.where(c("run_ts") == "20240101_000000")
    responses = run.withColumns(
        {"reasoning": F.lit(None).cast("string"), "response_model": served}
    )
    samples = fx.pred.select(*BY, "ord", "sample_id")
    return train.attach_responses(samples, responses, BY)


@query(
    "drop_null_fields",
    """SELECT sample_id, CASE WHEN error_type IS NULL THEN concat('{"sample_id":"', sample_id, '","error_flag":0}')
              WHEN error_sentence_id IS NULL THEN concat('{"sample_id":"', sample_id, '","error_flag":1,"error_type":"', error_type, '"}')
              ELSE concat('{"sample_id":"', sample_id, '","error_flag":1,"error_type":"', error_type, '","error_sentence_id":', CAST(error_sentence_id AS VARCHAR), '}') END AS row_json
       FROM fx_sample""",
    ["sample"],
)
def _(fx):
    from textbench.sources.writers import drop_null_fields

    row = drop_null_fields("sample_id", "error_flag", "error_type", "error_sentence_id")
    return fx.sample.select("sample_id", row.alias("row_json"))


# --- reasoning --------------------------------------------------------------

# What the built texts hold of the lists, written down on its own: the tests derive the whole lists.
_REMOVED_EN = "are told that|from scratch|this time.*reviewing.*error.*example|problem states"
_REMOVED_JA = "事前に|実際は|今回は.*エラー.*例|分かっている"


def _cleaned(column: str, period: str, words: str, source: str = "fx_reasoning") -> str:
    """Sentence list, those with a phrase taken out, the tail put back."""
    return f"""(SELECT doc_id, lang, {column} AS before, array_to_string(list_filter(s, lambda x: NOT regexp_matches(x, '(?i){words}')), '') || tail AS after,
        len(list_filter(s, lambda x: regexp_matches(x, '(?i){words}'))) AS removed
        FROM (SELECT doc_id, lang, {column}, regexp_extract_all({column}, '[^{period}]*[{period}]') AS s,
                     regexp_extract({column}, '[^{period}]*$') AS tail FROM {source}) x)"""


def _clean_query(name, column, period, words, clean):
    sql = f"SELECT doc_id, after AS cleaned, CAST(removed AS INT) AS removed FROM {_cleaned(column, period, words)} y"

    @query(name, sql, ["reasoning"])
    def _(fx):
        return fx.reasoning.select("doc_id", clean(c(column)).alias("x")).select(
            "doc_id", c("x.text").alias("cleaned"), "x.removed"
        )


_clean_query("clean_reasoning_en", "reasoning_en", ".", _REMOVED_EN, R.clean_reasoning_en)
_clean_query("clean_reasoning_ja", "reasoning_ja", "。", _REMOVED_JA, R.clean_reasoning_ja)

_SHORT = R.removal_pattern(["told that", "from scratch"])


@query(
    "clean_table",
    f"SELECT doc_id, after AS reasoning, CAST(removed AS INT) AS removed_sentences FROM {_cleaned('reasoning_en', '.', 'told that|from scratch')} y",
    ["reasoning"],
)
def _(fx):
    # Texts sit inside the raw response of an interaction.
    raw = F.struct(F.lit("x").alias("content"), c("reasoning_en").alias("reasoning"))
    rows = fx.reasoning.select("doc_id", raw.alias("raw_response"))
    return train.clean_table(rows, _SHORT, within="raw_response").select(
        "doc_id", "raw_response.reasoning", "removed_sentences"
    )


@query(
    "clean_stats",
    f"""SELECT count(*) AS total_samples, {_n("before <> ''")} AS with_reasoning, {_n("removed > 0")} AS changed_samples, CAST(sum(removed) AS BIGINT) AS removed_sentences,
               CAST(sum(length(before)) AS BIGINT) AS chars_before, CAST(sum(length(after)) AS BIGINT) AS chars_after,
               {R6("sum(length(before))", _n("before <> ''"))} AS avg_before, {R6("sum(length(after))", _n("before <> ''"))} AS avg_after
        FROM {_cleaned('reasoning_en', '.', 'told that|from scratch')} y""",
    ["reasoning"],
)
def _(fx):
    rows = fx.reasoning.select("doc_id", "reasoning_en", c("reasoning_en").alias("reasoning"))
    cleaned = train.clean_table(rows, _SHORT)
    return train.clean_stats(cleaned, c("reasoning_en"), c("reasoning"))
