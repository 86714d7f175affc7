"""Queries over the difficulty filter, duplicates, merging and judge verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import text as T
from textbench.functions import verdicts as V
from textbench.operators import curate, states
from textbench.plans.answer_queries import JUDGE_COLUMNS
from textbench.plans.registry import query
from textbench.plans.score_queries import R6, _n
from textbench.session import scratch_path

c = F.col
MODELS = 11

# Per item: models right under any template. An unreadable answer says "no error"
# for detection and is never a right complete answer.
_SOLVED = """SELECT sample_id, count(DISTINCT model) AS models,
    count(DISTINCT model) FILTER (WHERE CASE WHEN error_flag = 1 AND error_sentence_id IS NOT NULL
        THEN ed_pred = 1 AND CASE WHEN se_pred = 0 THEN 1 ELSE se_pred END = error_sentence_id
        ELSE ed_pred = 0 END) AS complete_models,
    count(DISTINCT model) FILTER (WHERE (ed_pred = 1) = (error_flag = 1)) AS detection_models
    FROM fx_pred GROUP BY sample_id"""
_ACCURACY = f"""acc AS (SELECT sample_id, models, complete_models, detection_models,
    complete_models::DOUBLE / models AS complete_accuracy, detection_models::DOUBLE / models AS detection_accuracy
    FROM ({_SOLVED}) s)"""
# The same with accuracies that are not known for some items.
_UNKNOWN = "lower(sample_id) LIKE '%_c_m1'"
_KNOWN = f"""{_ACCURACY.replace("acc AS", "every AS")}, acc AS (SELECT * REPLACE (
    CASE WHEN {_UNKNOWN} THEN NULL ELSE complete_accuracy END AS complete_accuracy,
    CASE WHEN {_UNKNOWN} THEN NULL ELSE detection_accuracy END AS detection_accuracy) FROM every)"""


def _accuracies(fx):
    return curate.item_accuracy(fx.pred)


def _known(fx):
    known = ~c("sample_id").like("%\\_c\\_m1")
    both = ("complete_accuracy", "detection_accuracy")
    return _accuracies(fx).withColumns({n: F.when(known, c(n)) for n in both})


@query(
    "item_accuracy",
    f"""WITH {_ACCURACY} SELECT sample_id, models, complete_models, detection_models,
        round(complete_accuracy, 6) AS complete_accuracy, round(detection_accuracy, 6) AS detection_accuracy FROM acc""",
    ["pred"],
)
def _(fx):
    return _accuracies(fx)


@query(
    "accuracy_states",
    f"""WITH {_ACCURACY} SELECT sample_id, models, complete_models, detection_models,
        round(complete_accuracy, 6) AS complete_accuracy, round(detection_accuracy, 6) AS detection_accuracy FROM acc""",
    ["pred"],
)
def _(fx):
    # Runs arrive one after the other and share models and items; the last one comes twice.
    path = scratch_path(fx.spark, "states")
    for turn in (0, 1, 2, 2):
        states.add_run(fx.pred.where(F.pmod(F.xxhash64("template", "ord"), 3) == turn), path, f"run{turn}")
    return states.current_accuracies(fx.spark, path)


@query(
    "accuracy_summary",
    f"""WITH {_ACCURACY}, m AS (SELECT 'complete' AS measure, complete_accuracy AS v FROM acc UNION ALL SELECT 'detection', detection_accuracy FROM acc
            UNION ALL SELECT 'difference', detection_accuracy - complete_accuracy FROM acc)
        SELECT measure, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS "min", round(max(v), 6) AS "max" FROM m GROUP BY measure""",
    ["pred"],
)
def _(fx):
    return curate.accuracy_summary(_accuracies(fx))


@query(
    "join_item_accuracy",
    f"""WITH {_ACCURACY} SELECT s.sample_id, round(complete_accuracy, 6) AS complete_accuracy, round(detection_accuracy, 6) AS detection_accuracy
        FROM fx_sample s LEFT JOIN acc ON s.sample_id = acc.sample_id""",
    ["pred", "sample"],
)
def _(fx):
    return curate.join_item_accuracy(fx.sample.select("sample_id"), _accuracies(fx))


_BIN = """CASE WHEN {0} = 0 THEN '0.0 (no models correct)' WHEN {0} < 0.25 THEN '0.0-0.25' WHEN {0} < 0.5 THEN '0.25-0.5'
    WHEN {0} < 0.75 THEN '0.5-0.75' WHEN {0} < 1 THEN '0.75-1.0' ELSE '1.0 (all models correct)' END"""
_DIFF_BIN = """CASE WHEN {0} < 0 THEN 'Negative (Complete > Detection)' WHEN {0} < 0.1 THEN '0-10%' WHEN {0} < 0.2 THEN '10-20%'
    WHEN {0} < 0.3 THEN '20-30%' WHEN {0} < 0.4 THEN '30-40%' ELSE '40%+ (may be filtered based on error type)' END"""


@query(
    "accuracy_bin",
    f"WITH {_ACCURACY} SELECT sample_id, {_BIN.format('complete_accuracy')} AS bin FROM acc",
    ["pred"],
)
def _(fx):
    return _accuracies(fx).select("sample_id", T.accuracy_bin(c("complete_accuracy")).alias("bin"))


@query(
    "difference_bin",
    f"WITH {_ACCURACY} SELECT sample_id, {_DIFF_BIN.format('(detection_accuracy - complete_accuracy)')} AS bin FROM acc",
    ["pred"],
)
def _(fx):
    difference = c("detection_accuracy") - c("complete_accuracy")
    return _accuracies(fx).select("sample_id", T.difference_bin(difference).alias("bin"))


# Limits by type; type2 has its own, every other one the default.
_STAGED = f"""WITH {_KNOWN}, staged AS (
    SELECT s.*, complete_accuracy, detection_accuracy, etype,
           CASE WHEN complete_accuracy IS NULL THEN NULL
                WHEN CAST(floor(complete_accuracy * {MODELS}) AS INT) < lo OR CAST(floor(complete_accuracy * {MODELS}) AS INT) > hi THEN 1
                WHEN detection_accuracy - complete_accuracy >= diff THEN 2
                WHEN error_flag = 1 AND error_sentence_id IS NULL THEN 3 END AS stage
    FROM (SELECT x.*, CASE WHEN etype = 'type2' THEN 3 ELSE 1 END AS lo, CASE WHEN etype = 'type2' THEN 9 ELSE 7 END AS hi,
                 CASE WHEN etype = 'type2' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS diff
          FROM (SELECT *, CASE WHEN error_flag = 0 THEN 'No Error' ELSE error_type END AS etype FROM fx_sample) x) s
    LEFT JOIN acc ON s.sample_id = acc.sample_id), filtered AS (
    SELECT *, CASE WHEN complete_accuracy IS NOT NULL AND stage IS NULL THEN 'adopted' ELSE 'rejected' END AS split FROM staged)"""


def _filtered(fx):
    limits = fx.spark.createDataFrame(
        [("default", 1, 7, 0.3), ("type2", 3, 9, 0.2)],
        "error_type string, stage1_min_models int, stage1_max_models int, stage2_max_diff double",
    )
    items = curate.join_item_accuracy(
        fx.sample.select(
            "ord", "sample_id", "error_flag", "error_type", "error_sentence_id", "corrected_sentence"
        ),
        _known(fx),
    )
    return curate.quality_filter(items, limits, MODELS)


@query(
    "quality_filter",
    rf"""{_STAGED} SELECT sample_id, split, stage AS rejection_stage,
            CASE WHEN stage = 3 THEN 'Data cleaning' WHEN stage = 2 THEN 'Accuracy difference' WHEN stage = 1 THEN
                 concat('Complete accuracy: ', CAST(CAST(floor(complete_accuracy * {MODELS}) AS INT) AS VARCHAR), '/{MODELS} models correct (allowed range for ', etype, ': ',
                        CASE WHEN etype = 'type2' THEN '3-9' ELSE '1-7' END, ')') END AS reason,
            CASE WHEN split = 'adopted' THEN regexp_replace(corrected_sentence, '\*\*(.*?)\*\*', '\1', 'g') ELSE corrected_sentence END AS corrected_sentence
        FROM filtered""",
    ["pred", "sample"],
)
def _(fx):
    reason = c("rejection_reason")
    # Only the first stage prints no rounded share.
    head = F.when(c("rejection_stage") == 1, reason).otherwise(F.substring_index(reason, ":", 1))
    return _filtered(fx).select(
        "sample_id", "split", "rejection_stage", head.alias("reason"), "corrected_sentence"
    )


@query(
    "complement",
    f"{_STAGED} SELECT sample_id FROM fx_sample EXCEPT SELECT sample_id FROM filtered WHERE split = 'adopted'",
    ["pred", "sample"],
)
def _(fx):
    return _filtered(fx).where(c("split") == "rejected").select("sample_id")


_STAT_COLUMNS = f"""count(*) AS total, {_n("split = 'adopted'")} AS adopted, {_n("split = 'rejected'")} AS rejected,
    {_n("stage = 1")} AS stage1_filtered, {_n("stage = 2")} AS stage2_filtered, {_n("stage = 3")} AS stage3_filtered"""


@query(
    "filter_stats",
    f"""{_STAGED} SELECT etype AS error_type_english, {_STAT_COLUMNS} FROM filtered WHERE complete_accuracy IS NOT NULL GROUP BY etype
        UNION ALL SELECT NULL, {_STAT_COLUMNS} FROM filtered WHERE complete_accuracy IS NOT NULL""",
    ["pred", "sample"],
)
def _(fx):
    return curate.filter_stats(_filtered(fx))


@query(
    "accuracy_distribution",
    f"""WITH {_KNOWN}, k AS (SELECT * FROM acc WHERE complete_accuracy IS NOT NULL) SELECT measure, bin, count(*) AS items FROM (
            SELECT 'complete' AS measure, {_BIN.format('complete_accuracy')} AS bin FROM k
            UNION ALL SELECT 'detection', {_BIN.format('detection_accuracy')} FROM k
            UNION ALL SELECT 'difference', {_DIFF_BIN.format('(detection_accuracy - complete_accuracy)')} FROM k) x GROUP BY measure, bin""",
    ["pred"],
)
def _(fx):
    return curate.accuracy_distribution(_filtered(fx))


@query(
    "error_breakdown",
    f"""{_STAGED} SELECT split, error_flag, count(*) AS items, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6)::DOUBLE AS "percent"
        FROM (SELECT 'original' AS split, error_flag FROM filtered UNION ALL SELECT split, error_flag FROM filtered) x GROUP BY split, error_flag""",
    ["pred", "sample"],
)
def _(fx):
    # Each row counts under its split and under the whole.
    splits = F.explode(F.array(F.lit("original"), c("split")))
    rows = _filtered(fx).select("error_flag", splits.alias("split"))
    return curate.error_breakdown(rows)


@query(
    "top_groups",
    """SELECT error_type, count(*) AS items FROM fx_sample WHERE error_flag = 1 GROUP BY error_type ORDER BY items DESC, error_type LIMIT 3""",
    ["sample"],
)
def _(fx):
    return curate.top_groups(fx.sample.where(c("error_flag") == 1), c("error_type"), "error_type", 3)


# --- duplicates -------------------------------------------------------------

_BASE = "concat('q', CAST(grp AS VARCHAR), '_', substr('abcde', CAST(grp % 5 + 1 AS INT), 1))"


@query(
    "dedup_first",
    f"SELECT ord, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY {_BASE} ORDER BY ord) AS k FROM fx_sample) x WHERE k = 1",
    ["sample"],
)
def _(fx):
    return curate.dedup_first(fx.sample.select("ord", "sample_id"))


@query(
    "dedup_best",
    f"""WITH {_ACCURACY} SELECT ord, sample_id FROM (
            SELECT s.ord, s.sample_id, row_number() OVER (PARTITION BY {_BASE} ORDER BY coalesce(complete_accuracy, 0) DESC, ord) AS k
            FROM fx_sample s LEFT JOIN acc ON s.sample_id = acc.sample_id) x WHERE k = 1""",
    ["pred", "sample"],
)
def _(fx):
    items = curate.join_item_accuracy(fx.sample.select("ord", "sample_id"), _accuracies(fx))
    return curate.dedup_best(items).select("ord", "sample_id")


# Ids of French items name no model, so each is a group of its own beside groups of one, two and three.
@query(
    "dedup_alternating",
    f"""WITH s AS (SELECT ord, CASE WHEN lang = 'fr' THEN concat('f', CAST(ord AS VARCHAR)) ELSE sample_id END AS sample_id,
                  CASE WHEN lang = 'fr' THEN concat('f', CAST(ord AS VARCHAR)) ELSE {_BASE} END AS base FROM fx_sample),
        g AS (SELECT base, min(ord) AS first, count(*) AS size FROM s GROUP BY base),
        k AS (SELECT base, size, row_number() OVER (ORDER BY first) - 1 AS k FROM g WHERE size > 1),
        r AS (SELECT s.*, row_number() OVER (PARTITION BY base ORDER BY ord) - 1 AS place FROM s)
        SELECT ord, sample_id FROM r LEFT JOIN k ON r.base = k.base WHERE k.base IS NULL OR place = k % size""",
    ["sample"],
)
def _(fx):
    own = F.concat(F.lit("f"), c("ord").cast("string"))
    named = F.when(c("lang") == "fr", own).otherwise(c("sample_id"))
    items = fx.sample.select("ord", named.alias("sample_id"))
    return curate.dedup_alternating(items)


# --- merging ----------------------------------------------------------------

# Spanish ids differ on the left, those of unlabelled items on the right, and German
# ones are blank on the right.
_SIDES = """l AS (SELECT CASE WHEN lang = 'es' THEN concat('left', sample_id) ELSE sample_id END AS sample_id, ord, error_flag FROM fx_sample),
    r AS (SELECT CASE WHEN lang = 'de' THEN '' WHEN quality IS NULL THEN concat('right', sample_id) ELSE sample_id END AS sample_id,
                 ord, 1 - error_flag AS error_flag FROM fx_sample)"""


def _sides(fx):
    s = fx.sample.select("sample_id", "ord", "error_flag", "lang", "quality")
    own = c("sample_id")
    named = F.when(c("lang") == "es", F.concat(F.lit("left"), own)).otherwise(own)
    left = s.select(named.alias("sample_id"), "ord", "error_flag")
    named = F.when(c("lang") == "de", "").when(c("quality").isNull(), F.concat(F.lit("right"), own)).otherwise(own)
    right = s.select(named.alias("sample_id"), "ord", (1 - c("error_flag")).alias("error_flag"))
    return left, right


@query(
    "merge_datasets",
    f"""WITH {_SIDES}, both_ids AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) % 2 AS odd FROM l WHERE sample_id IN (SELECT sample_id FROM r))
        SELECT concat(l.sample_id, '_m1') AS sample_id, ord, error_flag, 1 AS side FROM l LEFT JOIN both_ids b ON l.sample_id = b.sample_id WHERE b.odd IS NULL OR b.odd = 1
        UNION ALL SELECT concat(r.sample_id, '_m2'), ord, error_flag, 2 FROM r LEFT JOIN both_ids b ON r.sample_id = b.sample_id WHERE r.sample_id <> '' AND (b.odd IS NULL OR b.odd = 0)""",
    ["sample"],
)
def _(fx):
    return curate.merge_datasets(*_sides(fx))


@query(
    "alternate_sides",
    "SELECT sample_id, CAST((row_number() OVER (ORDER BY sample_id) + 1) % 2 + 1 AS INT) AS side FROM fx_sample",
    ["sample"],
)
def _(fx):
    return curate.alternate_sides(fx.sample.select("sample_id"))


@query(
    "id_union",
    f"WITH {_SIDES} SELECT sample_id FROM l UNION SELECT sample_id FROM r",
    ["sample"],
)
def _(fx):
    return curate.id_union(*_sides(fx))


# --- verdicts ---------------------------------------------------------------

# An unreadable judgment counts as valid with nothing found.
_JUDGED = f"(SELECT sample_id, template, unread, lang, {JUDGE_COLUMNS} FROM fx_judge) j"
_VERDICT = f"""v AS (SELECT sample_id, CAST(bool_and(unread = 1 OR total_issues = 0) AS INT) AS is_valid, count(*) AS judged_templates,
    {", ".join(f"CAST(greatest(0, max({x})) AS BIGINT) AS {x}" for x in ["total_issues", *K.CRITERIA])},
    min(CASE WHEN unread = 1 OR total_issues = 0 THEN 1 ELSE 0 END) AS lo, max(CASE WHEN unread = 1 OR total_issues = 0 THEN 1 ELSE 0 END) AS hi,
    string_agg(concat(template, '=', CASE WHEN unread = 1 THEN '' ELSE concat('seen in ', lang) END), ';' ORDER BY template) AS why
    FROM {_JUDGED} GROUP BY sample_id)"""


def _verdicts(fx):
    return curate.consolidate_judgments(V.parse_judgments(fx.judge))


@query(
    "consolidate_judgments",
    f"WITH {_VERDICT} SELECT sample_id, is_valid, judged_templates, total_issues, {', '.join(K.CRITERIA)}, why FROM v",
    ["judge"],
)
def _(fx):
    told = F.array_sort(
        F.transform(
            F.map_entries("explanations"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        )
    )
    return _verdicts(fx).select(
        "sample_id",
        "is_valid",
        "judged_templates",
        "total_issues",
        *K.CRITERIA,
        F.array_join(told, ";").alias("why"),
    )


def _judged_items(fx):
    items = fx.sample.select("sample_id", "error_flag")
    return curate.join_judgments(items, _verdicts(fx))


@query(
    "join_judgments",
    f"""WITH {_VERDICT} SELECT s.sample_id, is_valid, total_issues, CASE WHEN is_valid = 0 THEN 'rejected' ELSE 'accepted' END AS split
        FROM fx_sample s LEFT JOIN v ON s.sample_id = v.sample_id""",
    ["judge", "sample"],
)
def _(fx):
    return _judged_items(fx).select("sample_id", "is_valid", "total_issues", "split")


@query(
    "screening_stats",
    f"""WITH {_VERDICT} SELECT count(*) AS total, count(is_valid) AS screened, {_n("is_valid = 1")} AS valid, {_n("is_valid = 0")} AS invalid,
            {_n("is_valid IS NULL")} AS unscreened, round(coalesce(avg(total_issues) FILTER (WHERE is_valid = 0), 0), 6)::DOUBLE AS avg_issues_invalid
        FROM fx_sample s LEFT JOIN v ON s.sample_id = v.sample_id""",
    ["judge", "sample"],
)
def _(fx):
    return curate.screening_stats(_judged_items(fx))


@query(
    "criteria_counts",
    f"WITH {_VERDICT} " + " UNION ALL ".join(
        f"SELECT '{x}' AS criterion, {_n(x + ' > 0')} AS items FROM v WHERE is_valid = 0" for x in K.CRITERIA
    ),
    ["judge"],
)
def _(fx):
    return curate.criteria_counts(_judged_items(fx))


@query(
    "template_agreement",
    f"""WITH {_VERDICT} SELECT count(*) AS both_templates, {_n("lo = hi")} AS agreements, {_n("lo <> hi")} AS disagreements,
            {R6(_n("lo = hi"), "count(*)")} AS agreement_rate FROM v WHERE judged_templates = 2""",
    ["judge"],
)
def _(fx):
    return curate.template_agreement(_verdicts(fx))
