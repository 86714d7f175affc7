"""Queries over parsed answers, verdicts and synthesis responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import answers as A
from textbench.functions import synthesis as S
from textbench.functions import text as T
from textbench.functions import verdicts as V
from textbench.operators import curate, score
from textbench.operators.score import count_where, ratio
from textbench.plans.registry import query

c = F.col
KEYS = ["model", "template", "ord"]

# What each built answer means.
DETECTION = "ed_pred"
SENTENCE = "se_pred"
CORRECTION = """CASE WHEN ed_pred = 1 THEN answer_text
    WHEN contains(content, 'CORRECT') THEN '' ELSE 'PARSE_FAILED' END"""
# The same under the published limits: a bare `N.` up to fifty, and the ends of long answers.
LISTED = "CASE WHEN ed_pred = 1 AND ord % 6 = 3 AND se_pred > 50 THEN -1 ELSE {} END"
CUT = """CASE WHEN ed_pred = 1 THEN CASE WHEN length(content) <= 5000 THEN answer_text
         ELSE rtrim(substr(content, length(lead) + 1, 2490 - length(lead))) END
    WHEN contains(content, 'CORRECT') THEN '' ELSE 'PARSE_FAILED' END"""


@query(
    "parse_detection",
    f"SELECT model, template, ord, CAST({DETECTION} AS INT) AS pred FROM fx_response",
    ["response"],
)
def _(fx):
    return A.parse_outcome(fx.response).select(*KEYS, c("ed_pred").alias("pred"))


@query(
    "parse_sentence_id",
    f"SELECT model, template, ord, CAST({SENTENCE} AS BIGINT) AS pred FROM fx_response",
    ["response"],
)
def _(fx):
    return A.parse_outcome(fx.response).select(*KEYS, c("se_pred").alias("pred"))


@query(
    "parse_correction",
    f"SELECT model, template, ord, {CORRECTION} AS pred FROM fx_response",
    ["response"],
)
def _(fx):
    return A.parse_correction(fx.response).select(*KEYS, c("ec_pred").alias("pred"))


@query(
    "parse_limited",
    f"""SELECT model, template, ord, CAST({LISTED.format("ed_pred")} AS INT) AS ed, CAST({LISTED.format("se_pred")} AS BIGINT) AS se, {CUT} AS ec
        FROM fx_response""",
    ["response"],
)
def _(fx):
    read = A.parse_answers(
        fx.response, most_chars=K.MAX_CORRECTION_CHARS, most_listed=K.MAX_LISTED_SENTENCE
    )
    return read.select(*KEYS, c("ed_pred").alias("ed"), c("se_pred").alias("se"), c("ec_pred").alias("ec"))


@query(
    "parse_and_score",
    f"""SELECT model, template, tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy,
               round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1
        FROM (SELECT model, template, count(*) FILTER (WHERE error_flag = 1 AND p = 1) AS tp,
                     count(*) FILTER (WHERE error_flag = 0 AND p <> 0) AS fp,
                     count(*) FILTER (WHERE error_flag = 0 AND p = 0) AS tn,
                     count(*) FILTER (WHERE error_flag = 1 AND p <> 1) AS fn, count(*)::DOUBLE AS n
              FROM (SELECT *, {DETECTION} AS p FROM fx_response) r GROUP BY model, template) s""",
    ["response"],
)
def _(fx):
    answers = fx.response.select(*KEYS, "error_flag", "content")
    return score.detection_metrics(A.parse_outcome(answers), ["model", "template"]).select(
        "model", "template", "tp", "fp", "tn", "fn", "accuracy", "f1"
    )


@query(
    "parse_error_type",
    """SELECT model, ord, CASE WHEN form > 1 THEN kind END AS error_type, CASE WHEN form > 1 THEN level END AS confidence,
              CASE WHEN form > 1 THEN lang END AS explanation, CAST(form < 2 AS INT) AS parse_error FROM fx_label""",
    ["label"],
)
def _(fx):
    return V.parse_error_types(fx.label).select("model", "ord", "label.*")


JUDGE_COLUMNS = """CASE WHEN unread = 1 THEN -1 ELSE c_ambiguous END AS ambiguous_error,
    CASE WHEN unread = 1 THEN -1 WHEN lang = 'de' THEN c_special ELSE 0 END AS extra_elements,
    CASE WHEN unread = 1 THEN -1 ELSE c_multiple END AS multiple_errors,
    CASE WHEN unread = 1 THEN -1 ELSE 0 END AS numerical_error,
    CASE WHEN unread = 1 THEN -1 ELSE 0 END AS synthesis_consistency_error,
    CASE WHEN unread = 1 THEN -1 WHEN lang <> 'de' THEN c_special ELSE 0 END AS unrealistic_scenario,
    CASE WHEN unread = 1 THEN -1 ELSE 0 END AS inconsistent_context,
    CASE WHEN unread = 1 THEN -1 ELSE c_ambiguous + c_multiple + c_special END AS total_issues"""
JUDGE_BIGINTS = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in [*K.CRITERIA, "total_issues"])


@query(
    "parse_judgment",
    f"""SELECT sample_id, template, {JUDGE_BIGINTS}, CAST(total_issues = 0 AS INT) AS is_valid,
               CASE WHEN unread = 1 THEN 'Parse error' ELSE concat('seen in ', lang) END AS explanation,
               CASE WHEN unread = 1 THEN 'unknown' WHEN lang = 'de' THEN 'ja' ELSE 'en' END AS detected_language,
               unread AS parse_error
        FROM (SELECT sample_id, template, unread, lang, {JUDGE_COLUMNS} FROM fx_judge) j""",
    ["judge"],
)
def _(fx):
    return V.parse_judgments(fx.judge).select("sample_id", "template", "judgment.*")


@query(
    "response_text",
    """SELECT model, template, run_ts, ord, CASE WHEN content <> '' THEN content END AS given,
              CASE WHEN content <> '' THEN content ELSE 'from choice' END AS either FROM fx_attempt""",
    ["attempt"],
)
def _(fx):
    missing = F.lit(None).cast("string")
    direct = V.response_text(c("content"), missing)
    # A service that wraps its answer has no top-level content.
    wrapped = V.response_text(T.null_if_empty(c("content")), F.lit("from choice"))
    return fx.attempt.select(*KEYS, "run_ts", direct.alias("given"), wrapped.alias("either"))


# --- synthesis --------------------------------------------------------------

_RECORDS = """SELECT question_id, 'a' AS choice, 'correct' AS record_type, 2 AS n, concat('first ', story, '|**bold** two') AS lines, 0 AS told FROM fx_synth
    UNION ALL SELECT question_id, 'b', 'error', 2, concat('first b|bad two ', story), 1 FROM fx_synth
    UNION ALL SELECT question_id, 'c', 'error', 1, 'only c', 0 FROM fx_synth
    UNION ALL SELECT question_id, 'd', 'correct', 1, 'only d', 0 FROM fx_synth
    UNION ALL SELECT question_id, 'e', 'correct', 1, 'only e', 0 FROM fx_synth WHERE lang <> 'en'"""


def _records(fx):
    return S.parse_synthesis(fx.synth.select("ord", "question_id", "model", "lang", "content"))


@query(
    "parse_synthesis",
    f"""SELECT r.question_id, choice, record_type, n AS sentences, lines, CASE WHEN told = 1 THEN concat('type', CAST(s.ord % 6 AS VARCHAR)) END AS error_type,
               CASE WHEN told = 1 AND s.ord % 5 <> 0 THEN 2 END AS error_number,
               CASE WHEN told = 1 THEN 'bad two' END AS error_sentence, CASE WHEN told = 1 THEN 'good two' END AS corrected_sentence
        FROM ({_RECORDS}) r JOIN fx_synth s ON r.question_id = s.question_id""",
    ["synth"],
)
def _(fx):
    return _records(fx).select(
        "question_id",
        "choice",
        "record_type",
        F.size("sentences").alias("sentences"),
        F.array_join("sentences", "|").alias("lines"),
        "error_type",
        "error_number",
        "error_sentence",
        "corrected_sentence",
    )


@query(
    "assemble_item",
    """SELECT concat(question_id, '_a') AS sample_id, concat('1. first ', story, chr(10), '2. bold two') AS sentences, concat('first ', story, ' bold two') AS full_text,
              0 AS error_flag, CAST(NULL AS INT) AS error_sentence_id, CAST(NULL AS VARCHAR) AS corrected_text FROM fx_synth
       UNION ALL SELECT concat(question_id, '_b'), concat('1. first b', chr(10), '2. bad two ', story), concat('first b bad two ', story), 1, 2,
              concat('first b good two ', replace(story, 'bad two', 'good two')) FROM fx_synth
       UNION ALL SELECT concat(question_id, '_d'), '1. only d', 'only d', 0, NULL, NULL FROM fx_synth
       UNION ALL SELECT concat(question_id, '_e'), '1. only e', 'only e', 0, NULL, NULL FROM fx_synth WHERE lang <> 'en'""",
    ["synth"],
)
def _(fx):
    return S.usable_items(S.assemble_items(_records(fx))).select(
        "sample_id", "sentences", "full_text", "error_flag", "error_sentence_id", "corrected_text"
    )


@query(
    "missing_choices",
    "SELECT question_id, CASE WHEN lang = 'en' THEN 'e' ELSE '' END AS missing FROM fx_synth",
    ["synth"],
)
def _(fx):
    found = _records(fx).groupBy("question_id").agg(F.collect_set("choice").alias("found"))
    missing = F.array_join(T.missing_choices(c("found")), ",")
    return found.select("question_id", missing.alias("missing"))


@query(
    "conversion_stats",
    r"""SELECT model, count(*) AS total_samples, count(*) FILTER (WHERE dropped) AS filtered,
               count(*) FILTER (WHERE NOT dropped) AS successful, count(*) FILTER (WHERE NOT dropped AND lang = 'en') AS partial,
               count(*) FILTER (WHERE NOT dropped) AS failed_records,
               CAST(coalesce(sum(CASE WHEN dropped THEN 0 WHEN lang = 'en' THEN 2 ELSE 3 END), 0) AS BIGINT) AS correct_records,
               count(*) FILTER (WHERE NOT dropped) AS error_records, 5 * count(*) FILTER (WHERE NOT dropped) AS theoretical,
               round(100.0 * sum(CASE WHEN dropped THEN 0 WHEN lang = 'en' THEN 3 ELSE 4 END) / (5 * count(*) FILTER (WHERE NOT dropped)), 6)::DOUBLE AS achievement_rate
        FROM (SELECT model, lang, regexp_matches(question, '下\s*線\s*部') OR (c_a = '1' AND c_e = '5') AS dropped FROM fx_synth) s GROUP BY model""",
    ["synth"],
)
def _(fx):
    pairs = [x for k in "abcde" for x in (F.lit(k), c(f"c_{k}"))]
    dropped = T.has_underlined_part(c("question")) | T.has_numeric_choices(F.create_map(*pairs))
    responses = fx.synth.select("ord", "question_id", "model", "content", dropped.alias("dropped"))
    return conversion_stats(responses)


def conversion_stats(responses):
    """Per model: responses, filtered, failed and partial ones, items, theoretical yield.

    `responses` hold model, question_id, content and dropped. Records shrink to
    one row per response before they meet the responses.
    """
    asked = responses.where(~c("dropped"))
    records = S.assemble_items(S.parse_synthesis(asked))
    usable = (c("error_flag") == 0) | c("error_sentence_id").isNotNull()
    per_response = records.groupBy("model", "question_id").agg(
        F.count(F.lit(1)).alias("_records"),
        count_where(~usable).alias("_lost"),
        count_where(usable & (c("error_flag") == 0)).alias("_correct"),
        count_where(usable & (c("error_flag") == 1)).alias("_error"),
    )
    joined = responses.select("model", "question_id", "dropped").join(
        per_response, ["model", "question_id"], "left"
    )

    def total(name):
        return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

    n = c("_records")
    stats = joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_samples"),
        count_where(c("dropped")).alias("filtered"),
        F.count(n).alias("successful"),
        count_where(n < K.RECORDS_PER_QUESTION).alias("partial"),
        (total("_lost") + count_where(~c("dropped") & n.isNull())).alias("failed_records"),
        total("_correct").alias("correct_records"),
        total("_error").alias("error_records"),
        (count_where(~c("dropped")) * K.RECORDS_PER_QUESTION).alias("theoretical"),
    )
    made = c("correct_records") + c("error_records")
    return stats.withColumn("achievement_rate", ratio(made * 100, c("theoretical")))


@query(
    "first_match_per_choice",
    "SELECT question_id, choice, lines FROM (SELECT question_id, choice, lines FROM (" + _RECORDS + ") r) s",
    ["synth"],
)
def _(fx):
    # A second copy of each response follows the first; its headings come too late.
    twice = fx.synth.select(
        "question_id", F.concat("content", F.replace("content", F.lit("1. "), F.lit("1. late "))).alias("content")
    )
    return S.parse_synthesis(twice).select(
        "question_id", "choice", F.array_join("sentences", "|").alias("lines")
    )


@query(
    "union_models",
    """SELECT concat(question_id, '_', ch, '_', model) AS sample_id, model AS source_model FROM fx_synth
       CROSS JOIN (SELECT unnest(['a', 'b', 'd', 'e']) AS ch) x WHERE ch <> 'e' OR lang <> 'en'""",
    ["synth"],
)
def _(fx):
    items = S.usable_items(S.assemble_items(_records(fx)))
    return curate.union_models(items, ["synth0", "synth1"]).select("sample_id", "source_model")
