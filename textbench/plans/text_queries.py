"""Queries over predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.functions import reasoning as R
from textbench.functions import text as T
from textbench.operators import curate, prompts, report, score
from textbench.plans.registry import query

c = F.col
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def questions(fx):
    """Exam questions with their choices as a map and the answer as an array."""
    pairs = [x for k in "abcde" for x in (F.lit(k), c(f"c_{k}"))]
    return fx.question.withColumns({"choices": F.create_map(*pairs), "answers": F.array("answer")})


# --- predicates -------------------------------------------------------------


@query(
    "validate_items",
    """SELECT sample_id, CAST(ord % 3 < 2 AND lang <> 'es' AS INT) AS is_valid_item FROM fx_sample""",
    ["sample"],
)
def _(fx):
    items = fx.sample.select(
        "sample_id",
        (c("ord") % 3).cast("int").alias("error_flag"),
        F.when(c("lang") == "es", " \n\t").otherwise(c("sentences")).alias("sentences"),
    )
    return curate.split_valid_items(items).select("sample_id", "is_valid_item")


@query(
    "validate_questions",
    """SELECT question_id, CAST(answer <> 'f' AND length(trim(question)) > 0 AS INT) AS is_valid FROM fx_question""",
    ["question"],
)
def _(fx):
    valid = T.is_valid_question(c("question"), c("choices"), c("answers"))
    return questions(fx).select("question_id", valid.alias("is_valid"))


@query(
    "filter_underlined",
    r"""SELECT question_id FROM fx_question WHERE NOT regexp_matches(question, '下\s*線\s*部')""",
    ["question"],
)
def _(fx):
    return fx.question.where(~T.has_underlined_part(c("question"))).select("question_id")


@query(
    "filter_numeric_choices",
    """SELECT question_id FROM fx_question
       WHERE NOT (c_a = '1' AND c_b = '2' AND c_c = '3' AND c_d = '4' AND c_e = '5')""",
    ["question"],
)
def _(fx):
    return questions(fx).where(~T.has_numeric_choices(c("choices"))).select("question_id")


@query(
    "filter_inconsistent",
    "SELECT sample_id FROM fx_sample WHERE NOT (error_flag = 1 AND error_sentence_id IS NULL)",
    ["sample"],
)
def _(fx):
    broken = T.is_inconsistent(c("error_flag"), c("error_sentence_id"))
    return fx.sample.where(~broken).select("sample_id")


@query(
    "filter_items",
    """SELECT sample_id, error_type FROM fx_sample
       WHERE error_flag = 1 AND error_type IN ('type1', 'type2')""",
    ["sample"],
)
def _(fx):
    kept = report.filter_items(fx.sample, ["With Errors"], ["type1", "type2", "None"])
    return kept.select("sample_id", "error_type")


@query(
    "filter_judged_items",
    """SELECT sample_id, coalesce(error_type, 'None') AS error_type FROM fx_sample
       WHERE coalesce(quality, 1) <> 1""",
    ["sample"],
)
def _(fx):
    # A label of quality 1 stands for a valid item; unlabelled items count as valid.
    valid = F.coalesce(c("quality") == 1, F.lit(True))
    kept = report.filter_items(
        fx.sample, ["Invalid"], positive=valid, labels=("Valid", "Invalid")
    )
    return kept.select("sample_id", F.coalesce("error_type", F.lit("None")).alias("error_type"))


@query(
    "is_failed_response",
    """SELECT model, template, run_ts, ord,
              CAST(coalesce(error, '') <> '' OR trim(content) = '' AS INT) AS failed FROM fx_attempt""",
    ["attempt"],
)
def _(fx):
    bad = T.is_failed_response(c("content"), c("error"))
    return fx.attempt.select("model", "template", "run_ts", "ord", bad.alias("failed"))


@query(
    "filter_templates",
    "SELECT model, template, ord, ed_pred FROM fx_pred WHERE template IN ('t1', 't7')",
    ["pred"],
)
def _(fx):
    kept = fx.pred.where(c("template").isin("t1", "t7"))
    return kept.select("model", "template", "ord", "ed_pred")


# --- cleaning ---------------------------------------------------------------


@query(
    "strip_bold",
    r"""SELECT sample_id, regexp_replace(sentences, '\*\*(.*?)\*\*', '\1', 'g') AS sentences,
               regexp_replace(corrected_sentence, '\*\*(.*?)\*\*', '\1', 'g') AS corrected_sentence
        FROM fx_sample""",
    ["sample"],
)
def _(fx):
    items = fx.sample.select("sample_id", "sentences", "corrected_sentence")
    return curate.strip_bold_fields(items)


@query(
    "strip_decoration",
    """SELECT model, template, ord,
              CASE WHEN content LIKE '```text%' THEN '_CORRECT_' ELSE trim(replace(content, '`', '')) END AS plain
       FROM fx_response""",
    ["response"],
)
def _(fx):
    plain = T.strip_decoration(c("content"))
    return fx.response.select("model", "template", "ord", plain.alias("plain"))


@query(
    "clean_quotes",
    """SELECT doc_id, trim(text, '"') AS clean,
              CASE doc_id % 3 WHEN 0 THEN '"' WHEN 1 THEN '' ELSE 'a"b' END AS short
       FROM documents""",
)
def _(fx):
    quoted = F.concat(F.lit(' ""'), c("text"), F.lit('"\n'))
    short = F.when(c("doc_id") % 3 == 0, ' """ ').when(c("doc_id") % 3 == 2, 'a"b"')
    return fx.documents.select(
        "doc_id", T.clean_quotes(quoted).alias("clean"), T.clean_quotes(short).alias("short")
    )


@query(
    "truncate_middle",
    """SELECT doc_id, CASE WHEN length(text) <= 5000 THEN text
                      ELSE concat(substr(text, 1, 2490), chr(10), '...[TRUNCATED]...', chr(10),
                                  substr(text, length(text) - 2489, 2490)) END AS cut FROM documents""",
)
def _(fx):
    return fx.documents.select("doc_id", T.truncate_middle(c("text")).alias("cut"))


@query(
    "normalize_text",
    rf"""SELECT doc_id, lower(replace(replace(regexp_replace({STRIP.format("t")}, '\s+', ' ', 'g'), '、', ''), '。', '')) AS plain
         FROM (SELECT doc_id, replace(text, '. ', '。 ') AS t FROM documents) x""",
)
def _(fx):
    text = F.replace(c("text"), F.lit(". "), F.lit("。 "))
    return fx.documents.select("doc_id", T.normalize_text(text).alias("plain"))


# --- language and tokens ----------------------------------------------------

# Some texts get enough kana and kanji, some enough digits, to leave "en".
_MIXED = """(SELECT doc_id, source, lang,
    CASE lang WHEN 'es' THEN concat(text, repeat('かな漢字', CAST(floor(length(text) / 20) AS INT)))
              WHEN 'fr' THEN concat(text, repeat('1234567890', CAST(floor(length(text) / 10) AS INT)))
              WHEN 'de' THEN CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE text END ELSE text END AS mixed
    FROM documents) x"""
_LANG = r"""CASE WHEN trim(mixed) = '' THEN 'unknown'
    WHEN length(regexp_replace(mixed, '[^\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9faf}]', '', 'g'))
         > 0.1 * length(regexp_replace(mixed, '\s', '', 'g')) THEN 'ja'
    WHEN length(regexp_replace(mixed, '[^a-zA-Z]', '', 'g'))
         > 0.5 * length(regexp_replace(mixed, '\s', '', 'g')) THEN 'en' ELSE 'unknown' END"""


def _mixed(fx):
    size = F.length("text")

    def more(unit, per):
        times = F.floor(size / per).cast("int")
        return F.concat(c("text"), F.repeat(F.lit(unit), times))

    text = (
        F.when(c("lang") == "es", more("かな漢字", 20))
        .when(c("lang") == "fr", more("1234567890", 10))
        .when((c("lang") == "de") & (c("doc_id") % 2 == 0), " ")
        .otherwise(c("text"))
    )
    return fx.documents.select("doc_id", "source", "lang", text.alias("mixed"))


@query("detect_language", f"SELECT doc_id, {_LANG} AS language FROM {_MIXED}")
def _(fx):
    return _mixed(fx).select("doc_id", T.detect_language(c("mixed")).alias("language"))


_GROUP_LANGUAGE = f"""SELECT source, CASE WHEN ja >= en AND ja >= un THEN 'ja' WHEN en >= un THEN 'en' ELSE 'unknown' END AS language
        FROM (SELECT source, count(*) FILTER (WHERE l = 'ja') AS ja, count(*) FILTER (WHERE l = 'en') AS en,
                     count(*) FILTER (WHERE l = 'unknown') AS un
              FROM (SELECT source, CASE WHEN trim(mixed) <> '' THEN {_LANG} END AS l,
                           row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {_MIXED}) y
              WHERE k <= LIMIT_ GROUP BY source) z"""


@query("group_language", _GROUP_LANGUAGE.replace("k <= LIMIT_", "true"))
def _(fx):
    return score.group_language(_mixed(fx), "mixed", ["source"])


@query("group_language_votes", _GROUP_LANGUAGE.replace("LIMIT_", "5"))
def _(fx):
    # The published scoring asks the first five references only.
    return score.group_language(_mixed(fx), "mixed", ["source"], "doc_id", votes=5)


@query(
    "tokenize",
    rf"""SELECT doc_id, CAST(len(t) AS INT) AS tokens, md5(array_to_string(t, ' ')) AS digest
         FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_extract_all(lower(text), '[a-z0-9]+')
                                   ELSE string_split({STRIP.format("text")}, '') END AS t FROM documents) x""",
)
def _(fx):
    spoken = F.when(c("lang") == "en", "en").when(c("lang") == "fr", "ja").otherwise("unknown")
    tokens = fx.documents.withColumn("t", T.tokenize(c("text"), spoken))
    return tokens.select(
        "doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest")
    )


# --- no-answer handling -----------------------------------------------------


@query(
    "is_na_text",
    """SELECT ord, CAST(prediction IN ('"CORRECT"', '') AS INT) AS pred_na, CAST(reference = '' AS INT) AS ref_na FROM fx_pair""",
    ["pair"],
)
def _(fx):
    return fx.pair.select(
        "ord",
        T.is_na_text(c("prediction")).alias("pred_na"),
        T.is_na_text(c("reference")).alias("ref_na"),
    )


@query(
    "na_case",
    """SELECT ord, CASE WHEN prediction = 'PARSE_FAILED' THEN 1 WHEN prediction IN ('"CORRECT"', '') THEN 1
                        WHEN reference = '' THEN 1 ELSE 0 END AS is_na,
              CASE WHEN prediction IN ('"CORRECT"', '') AND reference = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
       FROM fx_pair""",
    ["pair"],
)
def _(fx):
    case = T.na_case(T.clean_quotes(c("prediction")), T.clean_quotes(c("reference")))
    return fx.pair.select("ord", case.alias("x")).select("ord", "x.is_na", "x.score")


# --- reasoning in raw responses ---------------------------------------------


@query(
    "split_reasoning",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {STRIP.format("b")} WHEN 1 THEN {STRIP.format("b")}
                                       WHEN 2 THEN 'pre post' ELSE raw_text END AS content,
               CASE doc_id % 4 WHEN 0 THEN {STRIP.format("a")} WHEN 1 THEN {STRIP.format("a")}
                               WHEN 2 THEN {STRIP.format("concat(a, '</think>', b)")} ELSE '' END AS reasoning
        FROM fx_think""",
    ["think"],
)
def _(fx):
    return fx.think.select("doc_id", R.split_reasoning(c("raw_text")).alias("x")).select(
        "doc_id", "x.*"
    )


@query(
    "extract_reasoning_chat",
    """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN '[Thinking content was present but redacted for safety]'
                                      WHEN 6 THEN '' ELSE text END AS reasoning FROM documents""",
)
def _(fx):
    return fx.chat.select("doc_id", R.extract_reasoning_chat(c("chat")).alias("reasoning"))


@query(
    "extract_reasoning_items",
    "SELECT doc_id, concat('first', chr(10), chr(10), text) AS reasoning FROM documents",
)
def _(fx):
    return fx.chat.select("doc_id", R.extract_reasoning_items(c("items")).alias("reasoning"))


@query(
    "redact_keys",
    """SELECT doc_id, CASE doc_id % 7
         WHEN 0 THEN '{"choices": [{"message": {"content": [{"type": "text", "text": "x"}, {"type": "thinking"}]}}]}'
         WHEN 1 THEN '{"choices": [{"message": {"content": [{"type": "redacted_thinking"}, {"type": "thinking"}]}}]}'
         WHEN 2 THEN '{"choices": [{"message": {"content": "x"}}]}'
         WHEN 3 THEN '{"choices": [{"message": {"content": "x"}}]}'
         WHEN 4 THEN '{"choices": [{"message": {"content": "x"}}]}'
         WHEN 5 THEN '{"choices": [{"message": {"content": "x"}}]}'
         ELSE '{"choices":[]}' END AS kept FROM documents""",
)
def _(fx):
    kept = R.redact_keys(c("chat"), ["thinking", "reasoning", "reasoning_content"])
    return fx.chat.select("doc_id", kept.alias("kept"))


# --- small helpers ----------------------------------------------------------


@query(
    "text_helpers",
    r"""SELECT t.doc_id, CASE WHEN t.doc_id % 4 IN (0, 2) THEN regexp_replace(a, '^\s+|\s+$', '', 'g') END AS between_tags,
               coalesce(TRY_CAST(nullif(regexp_extract(d.text, '\d+'), '') AS BIGINT),
                        CASE WHEN regexp_extract(d.text, '\d+') <> '' THEN 9223372036854775807 END) AS first_number,
               CASE WHEN contains(lower(d.text), 'yes') OR contains(lower(d.text), 'error') OR contains(d.text, '1') THEN 1
                    WHEN contains(lower(d.text), 'no') OR contains(d.text, '0') THEN 0 END AS yes_no
        FROM fx_think t JOIN documents d ON t.doc_id = d.doc_id""",
    ["think"],
)
def _(fx):
    between = T.text_between(c("raw_text"), "<think>", "</think>")
    joined = fx.think.join(fx.documents.select("doc_id", "text"), "doc_id")
    return joined.select(
        "doc_id",
        between.alias("between_tags"),
        T.first_number(c("text")).alias("first_number"),
        T.yes_no(c("text")).alias("yes_no"),
    )


@query(
    "map_error_type",
    """SELECT sample_id, CASE WHEN error_type IS NULL THEN 'No Error' WHEN error_type = 'type1' THEN 'Dose'
                              WHEN error_type = 'type4' THEN 'Test' ELSE error_type END AS english FROM fx_sample""",
    ["sample"],
)
def _(fx):
    english = T.map_error_type(c("error_type"), {"type1": "Dose", "type4": "Test"})
    return fx.sample.select("sample_id", english.alias("english"))


@query(
    "base_id",
    """SELECT sample_id, CASE WHEN ord % 2 = 0 THEN substr(sample_id, 1, length(sample_id) - 3)
                              ELSE concat('q', CAST(grp AS VARCHAR), '_x') END AS base FROM fx_sample""",
    ["sample"],
)
def _(fx):
    # Odd rows carry an id of two parts only.
    short = F.concat(F.lit("q"), c("grp").cast("string"), F.lit("_x"))
    given = F.when(c("ord") % 2 == 0, c("sample_id")).otherwise(short)
    return fx.sample.select("sample_id", T.base_id(given).alias("base"))


@query(
    "used_choice",
    """SELECT sample_id, CASE WHEN ch = 'e' THEN '情報なし' ELSE ch END AS choice,
              CASE ch WHEN 'a' THEN c_a WHEN 'b' THEN c_b WHEN 'c' THEN c_c WHEN 'd' THEN c_d ELSE '情報なし' END AS choice_text
       FROM (SELECT s.sample_id, string_split(s.sample_id, '_')[2] AS ch, q.* FROM fx_sample s JOIN fx_question q ON s.ord = q.ord) x""",
    ["sample", "question"],
)
def _(fx):
    pairs = [x for k in "abcd" for x in (F.lit(k), c(f"c_{k}"))]
    choices = fx.question.select("ord", F.create_map(*pairs).alias("choices"))
    joined = fx.sample.select("ord", "sample_id").join(choices, "ord")
    used = joined.withColumn("u", T.used_choice(c("sample_id"), c("choices")))
    return used.select("sample_id", "u.choice", c("u.text").alias("choice_text"))


@query(
    "nth_sentence",
    """SELECT sample_id, concat(CAST(focus_id AS VARCHAR), '. ', focus) AS pointed, '' AS before_first, '' AS past_last
       FROM fx_sample""",
    ["sample"],
)
def _(fx):
    def line(k):
        return T.nth_sentence(c("sentences"), k)

    return fx.sample.select(
        "sample_id",
        line(c("focus_id")).alias("pointed"),
        line(-c("focus_id")).alias("before_first"),
        line(c("n_sentences") + 1).alias("past_last"),
    )


_TEMPLATE = """concat('0_shot', CASE ord % 3 WHEN 0 THEN concat('_prior_', CAST(ord % 100 AS VARCHAR(10))) ELSE '' END,
    CASE WHEN lang = 'en' THEN '_en' ELSE '_ja' END, CASE WHEN ord % 2 = 0 THEN '_lark' ELSE '' END)"""


def _template_name():
    prior = F.when(c("ord") % 3 == 0, F.concat(F.lit("_prior_"), (c("ord") % 100).cast("string")))
    return F.concat(
        F.lit("0_shot"),
        F.coalesce(prior, F.lit("")),
        F.when(c("lang") == "en", "_en").otherwise("_ja"),
        F.when(c("ord") % 2 == 0, "_lark").otherwise(""),
    )


@query(
    "parse_template_name",
    f"""SELECT ord, {_TEMPLATE} AS template, CAST(ord % 2 = 0 AS INT) AS lark,
               CASE WHEN ord % 3 = 0 THEN CAST(ord % 100 AS INT) END AS prior,
               concat('0_shot', CASE WHEN ord % 3 = 0 THEN '_prior' ELSE '' END, CASE WHEN lang = 'en' THEN '_en' ELSE '_ja' END) AS base
        FROM fx_sample""",
    ["sample"],
)
def _(fx):
    named = fx.sample.select("ord", _template_name().alias("template"))
    t = c("template")
    return named.select(
        "ord",
        "template",
        T.template_is_lark(t).alias("lark"),
        T.template_prior(t).alias("prior"),
        T.base_template(t).alias("base"),
    )


@query(
    "wrong_choices",
    """SELECT question_id, array_to_string(list_filter(['a', 'b', 'c', 'd', 'e'], lambda x: x <> answer), ', ') AS wrong
       FROM fx_question""",
    ["question"],
)
def _(fx):
    wrong = F.array_join(T.wrong_choices(c("answers")), ", ")
    return questions(fx).select("question_id", wrong.alias("wrong"))


# --- prompts ----------------------------------------------------------------


_BASE_NAME = """concat('0_shot', CASE WHEN ord % 3 = 0 THEN '_prior' ELSE '' END, CASE WHEN lang = 'en' THEN '_en' ELSE '_ja' END)"""


def _exploded(df, *keys):
    return df.select(*keys, F.inline("messages"))


@query(
    "render_prompt",
    f"""WITH p AS (SELECT ord, sentences, {_BASE_NAME} AS template FROM fx_sample)
       SELECT ord, template, 'system' AS role, CASE WHEN template LIKE '%en' THEN 'Review {{text}}.' ELSE 'Pruefe.' END AS content FROM p
       UNION ALL
       SELECT ord, template, 'user', concat(CASE WHEN template LIKE '%en' THEN 'Text: ' ELSE 'Fall: ' END, sentences,
              CASE WHEN template LIKE '%prior%' THEN concat(' (', CAST(ord % 100 AS VARCHAR), '% wrong, ', CAST(100 - ord % 100 AS VARCHAR), '% right)') ELSE '' END)
       FROM p""",
    ["sample"],
)
def _(fx):
    named = fx.sample.withColumn("name", _template_name())
    named = named.withColumn("template", T.base_template(c("name")))
    odds = " ({error_probability}% wrong, {correct_probability}% right)"
    en, de = ("Review {{text}}.", "Text: {sentences}"), ("Pruefe.", "Fall: {sentences}")
    templates = {
        "0_shot_en": en,
        "0_shot_ja": de,
        "0_shot_prior_en": (en[0], en[1] + odds),
        "0_shot_prior_ja": (de[0], de[1] + odds),
    }
    values = prompts.detection_values(c("name"), {})
    return _exploded(prompts.render_templates(named, templates, values), "ord", "template")


@query(
    "render_hint_prompt",
    """SELECT ord, concat('Note: ', CASE WHEN lang = 'en' THEN '' ELSE '注 ' END,
              CASE WHEN error_flag = 1 THEN concat('wrong is ', error_sentence) ELSE 'nothing is wrong' END) AS content,
              CASE WHEN lang = 'en' THEN 'en' ELSE 'ja' END AS system_text
       FROM fx_sample""",
    ["sample"],
)
def _(fx):
    name = F.concat(F.lit("0_shot_cheat_"), F.when(c("lang") == "en", "en").otherwise("ja"))
    named = fx.sample.withColumn("template", name)
    hints = {
        "en": {"error_hint": ("wrong is {error_sentence}", "nothing is wrong")},
        "ja": {"error_hint": ("注 wrong is {error_sentence}", "注 nothing is wrong")},
    }
    values = prompts.detection_values(c("template"), hints)
    content = prompts.render("Note: {error_hint}", values)
    return named.select(
        "ord", content.alias("content"), prompts.system_kind(c("template")).alias("system_text")
    )


@query(
    "render_question_prompt",
    """SELECT question_id, concat('Q: ', question, chr(10), 'a: ', c_a, chr(10), 'b: ', c_b, chr(10), 'c: ', c_c, chr(10), 'd: ', c_d,
              chr(10), 'e: ', c_e, chr(10), 'right ', answer, ' wrong ',
              array_to_string(list_filter(['a', 'b', 'c', 'd', 'e'], lambda x: x <> answer), ', ')) AS content
       FROM fx_question""",
    ["question"],
)
def _(fx):
    values = prompts.question_values(c("question"), c("choices"), c("answers"))
    template = "Q: {question}\n{choices_text}\nright {correct_choices_list} wrong {wrong_choices_list}"
    return questions(fx).select("question_id", prompts.render(template, values).alias("content"))


@query(
    "render_judge_prompt",
    """SELECT s.sample_id, concat('Judge: ', s.sentences, ' made from ',
              CASE string_split(s.sample_id, '_')[2] WHEN 'a' THEN concat('a ', c_a) WHEN 'b' THEN concat('b ', c_b)
                   WHEN 'c' THEN concat('c ', c_c) WHEN 'd' THEN concat('d ', c_d) ELSE concat('e ', c_e) END, ' answer ', answer) AS content
       FROM fx_sample s JOIN fx_question q ON s.ord = q.ord""",
    ["sample", "question"],
)
def _(fx):
    asked = questions(fx).select("ord", "choices", "answers")
    joined = fx.sample.select("ord", "sample_id", "sentences").join(asked, "ord")
    values = {
        "sentences": c("sentences"),
        **prompts.judge_values(c("sample_id"), c("choices"), c("answers")),
    }
    template = "Judge: {sentences} made from {used_choice} {used_choice_text} answer {correct_choices_list}"
    return joined.select("sample_id", prompts.render(template, values).alias("content"))
