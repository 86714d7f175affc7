"""Queries over readers, writers, the run catalog and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.operators import curate
from textbench.plans.answer_queries import CORRECTION, DETECTION, SENTENCE
from textbench.plans.registry import query
from textbench.plans.score_queries import _n
from textbench.session import scratch_path
from textbench.sources import elements, readers, writers
from textbench.sources.commits import read_committed
from textbench.sources.schemas import EXPERIMENT
from textbench.streaming import scores

c = F.col

# One file per group of neighbouring items, which are three at most. Every odd
# group is wrapped in an object, the others are bare arrays.


def _files(rows, row, wrap="samples"):
    """(path, text): JSON files of the rows of each group, in their order."""
    sorted_rows = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))), lambda x: x["row"]
    )
    body = F.concat(F.lit("["), F.array_join(sorted_rows, ",\n"), F.lit("]"))
    groups = rows.groupBy("grp").agg(body.alias("body"))
    wrapped = F.concat(F.lit(f' {{"name": "x", "{wrap}": '), c("body"), F.lit("}"))
    return groups.select(
        F.concat(F.lit("g"), c("grp").cast("string")).alias("path"),
        F.when(c("grp") % 2 == 1, wrapped).otherwise(c("body")).alias("text"),
    )


ITEM_FIELDS = [
    "sample_id",
    "sentences",
    "error_flag",
    "error_type",
    "error_sentence_id",
    "error_sentence",
    "corrected_sentence",
]
_KEEP = {"ignoreNullFields": "false"}


def _item_files(fx):
    items = fx.sample.select("grp", "ord", "lang", *ITEM_FIELDS)
    # Spanish items lack a required key.
    full = F.to_json(F.struct(*ITEM_FIELDS), _KEEP)
    short = F.to_json(F.struct(*ITEM_FIELDS[:-1]), _KEEP)
    return _files(items, F.when(c("lang") == "es", short).otherwise(full))


@query(
    "read_items",
    """SELECT concat('g', CAST(grp AS VARCHAR)) AS path, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS BIGINT) AS ord, sample_id, sentences, error_flag,
              error_type, error_sentence_id, error_sentence, CASE WHEN lang <> 'es' THEN corrected_sentence END AS corrected_sentence,
              CAST(lang <> 'es' AS INT) AS is_complete FROM fx_sample""",
    ["sample"],
)
def _(fx):
    return readers.read_items(_item_files(fx)).select("path", "ord", *ITEM_FIELDS, "is_complete")


@query(
    "normalize_container",
    """SELECT CASE WHEN grp % 2 = 1 THEN 'samples' ELSE 'array' END AS layout, sample_id FROM fx_sample""",
    ["sample"],
)
def _(fx):
    rows = readers.normalize_container(_item_files(fx))
    return rows.select("layout", F.get_json_object("raw", "$.sample_id").alias("sample_id"))


@query(
    "read_questions",
    """SELECT CASE WHEN lang = 'de' THEN concat('jmle-', CAST(row_number() OVER (PARTITION BY CAST(floor(ord / 3) AS BIGINT) ORDER BY ord) - 1 AS VARCHAR)) ELSE question_id END AS question_id,
              question, c_e AS last_choice, answer FROM fx_question""",
    ["question"],
)
def _(fx):
    pairs = [x for k in "abcde" for x in (F.lit(k), c(f"c_{k}"))]
    named = F.when(c("lang") != "de", c("question_id"))
    body = F.struct(
        named.alias("id"),
        "question",
        F.create_map(*pairs).alias("choices"),
        F.array("answer").alias("answer"),
    )
    rows = fx.question.withColumn("grp", F.floor(c("ord") / 3))
    asked = readers.read_questions(_files(rows, F.to_json(body)))
    return asked.select(
        "question_id",
        "question",
        F.try_element_at("choices", F.lit("e")).alias("last_choice"),
        F.array_join("answer", ",").alias("answer"),
    )


@query(
    "read_responses",
    """SELECT sample_id, lpad(CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) AS VARCHAR), 3, '0') AS interaction_index, sentences AS prompt,
              CASE WHEN lang <> 'de' THEN focus END AS content, CASE WHEN lang = 'de' THEN 'timeout' END AS error,
              CASE WHEN lang <> 'de' THEN concat('served ', lang) END AS response_model FROM fx_sample""",
    ["sample"],
)
def _(fx):
    ok = c("lang") != "de"
    # Failed interactions hold no raw response besides the error.
    raw = F.struct(
        F.when(ok, c("focus")).alias("content"), F.when(~ok, "timeout").alias("error")
    )
    body = F.struct(
        F.struct("sample_id").alias("sample_data"),
        F.array(F.struct(F.lit("user").alias("role"), c("sentences").alias("content"))).alias("messages"),
        raw.alias("raw_response"),
        F.when(ok, F.struct(F.concat(F.lit("served "), c("lang")).alias("model"))).alias("response_metadata"),
    )
    read = readers.read_responses(_files(fx.sample, F.to_json(body), "interactions"))
    return read.select(
        "sample_id",
        "interaction_index",
        F.get("messages", F.lit(0))["content"].alias("prompt"),
        "content",
        "error",
        "response_model",
    )


@query(
    "read_predictions",
    """SELECT CASE WHEN lang = 'fr' THEN lpad(CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS VARCHAR), 3, '0') ELSE sample_id END AS sample_id,
              error_flag, error_flag AS ed_pred, CAST(focus_id AS BIGINT) AS se_pred, focus AS ec_pred FROM fx_sample""",
    ["sample"],
)
def _(fx):
    # English files spell the parsers with underscores, the others without; French rows have no id.
    en, named = c("lang") == "en", c("lang") != "fr"

    def spelled(a, b, value):
        return [F.when(en, value).alias(a), F.when(~en, value).alias(b)]

    predictions = F.struct(
        *spelled("error_detection", "errordetection", c("error_flag")),
        *spelled("sentence_extraction", "sentenceextraction", c("focus_id")),
        *spelled("error_correction", "errorcorrection", c("focus")),
    )
    body = F.struct(
        F.when(named, c("sample_id")).alias("sample_id"),
        "error_flag",
        predictions.alias("predictions"),
    )
    read = readers.read_predictions(_files(fx.sample, F.to_json(body)))
    return read.select("sample_id", "error_flag", "ed_pred", "se_pred", "ec_pred")


@query(
    "run_catalog",
    """SELECT 'find' AS task, event_type AS dataset, concat('u', CAST(user_id AS VARCHAR)) AS model, concat('t', CAST(event_id % 3 AS VARCHAR)) AS template,
              strftime(ts, '%Y%m%d_%H%M%S') AS run_ts FROM events""",
)
def _(fx):
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    path = F.concat_ws(
        "/",
        F.lit("out/find"),
        "event_type",
        F.concat(F.lit("u"), c("user_id").cast("string")),
        F.concat(F.lit("t"), (c("event_id") % 3).cast("string")),
        stamp,
        F.lit("raw_responses.json"),
    )
    return readers.run_catalog(fx.events.select(path.alias("path"))).select(*EXPERIMENT)


# --- sinks ------------------------------------------------------------------


def _experiment(df):
    return df.withColumns({"task": F.lit("find"), "run_ts": F.lit("20240101_000000")})


@query(
    "write_responses",
    """SELECT 'find' AS task, dataset, model, template, ord, content,
              concat('{"model": "', model, '", "nested": [{"x": 1}]}') AS config FROM fx_response""",
    ["response"],
)
def _(fx):
    config = F.concat(
        F.lit('{"model": "'), c("model"), F.lit('", "api_key": "k", "nested": [{"x": 1, "api_key": "k"}]}')
    )
    rows = _experiment(fx.response).select(*EXPERIMENT, "ord", "content", config.alias("config"))
    path = scratch_path(fx.spark, "sink")
    # A repetition under another name replaces the run, one under the same name does nothing.
    for name in ("first", "second", "second"):
        writers.write_responses(rows, path, secrets=["api_key"], config_columns=["config"], commit=name)
    return read_committed(fx.spark, path, "responses").select(
        "task", "dataset", "model", "template", "ord", "content", "config"
    )


@query(
    "write_predictions",
    f"""SELECT dataset, model, template, count(*) AS samples, {_n("ed_pred = error_flag")} AS right_samples FROM fx_pred GROUP BY dataset, model, template""",
    ["pred"],
)
def _(fx):
    from textbench.operators import report, score

    rows = _experiment(fx.pred)
    metrics = score.detection_metrics(rows, EXPERIMENT)
    metrics = metrics.withColumn("right_samples", c("tp") + c("tn"))
    long = report.metric_rows(metrics, EXPERIMENT, "error_detection", ["right_samples"])
    path = scratch_path(fx.spark, "sink")
    writers.write_predictions(rows.select(*EXPERIMENT, "ord", "ed_pred", "se_pred"), long, path)
    by = ["dataset", "model", "template"]
    samples = read_committed(fx.spark, path, "samples").groupBy(*by).agg(F.count(F.lit(1)).alias("samples"))
    kept = read_committed(fx.spark, path, "metrics").select(
        *by, c("value").cast("bigint").alias("right_samples")
    )
    return samples.join(kept, by)


@query(
    "split_write",
    """SELECT CASE WHEN error_flag = 1 THEN 'adopted' ELSE 'rejected' END AS split, ord, sentences FROM fx_sample""",
    ["sample"],
)
def _(fx):
    split = F.when(c("error_flag") == 1, "adopted").otherwise("rejected")
    path = scratch_path(fx.spark, "sink")
    rows = fx.sample.select("ord", "sentences", split.alias("split"))
    for _ in range(2):
        writers.split_write(rows, path)
    return fx.spark.read.parquet(path).select("split", "ord", "sentences")


def _array_files(fx, groups: int):
    """Folder of JSON arrays with the items of so many neighbouring groups each."""
    path = scratch_path(fx.spark, "files")
    rows = fx.sample.select(
        F.floor(c("grp") / groups).alias("file"), "ord", F.to_json(F.struct(*ITEM_FIELDS), _KEEP).alias("json")
    )
    writers.write_json_arrays(rows, path)
    return path


@query(
    "dedup_many_files",
    """SELECT sample_id FROM fx_sample WHERE ord % 3 = 0""",
    ["sample"],
)
def _(fx):
    # Every file starts at position 0, so positions run over all files first.
    read = elements.read_elements(fx.spark, _array_files(fx, 64))
    items = readers.number_files(readers.read_items(read).select("path", "ord", "sample_id"))
    # Items of a group lie in one file in their order, so the first of a base id is that of rest 0.
    return curate.dedup_first(items.select("sample_id", "ord")).select("sample_id")


@query(
    "read_large_files",
    """SELECT sample_id, row_number() OVER (PARTITION BY CAST(floor(grp / 4096) AS BIGINT) ORDER BY ord) - 1 AS ord, sentences, corrected_sentence,
              CAST(1 AS INT) AS is_complete FROM fx_sample""",
    ["sample"],
)
def _(fx):
    items = readers.read_items(elements.read_elements(fx.spark, _array_files(fx, 4096)))
    return items.select("sample_id", "ord", "sentences", "corrected_sentence", "is_complete")


# --- stream -----------------------------------------------------------------


@query(
    "score_stream",
    f"""SELECT model, template, ord, CAST(p1 AS INT) AS ed_pred, CAST(p2 AS BIGINT) AS se_pred, p3 AS ec_pred, CAST(p1 = error_flag AS INT) AS is_correct,
               CAST(p2 = coalesce(error_sentence_id, 0) AND p2 <> -1 AS INT) AS is_exact_match
        FROM (SELECT *, {DETECTION} AS p1, {SENTENCE} AS p2, {CORRECTION} AS p3 FROM fx_response) r""",
    ["response"],
)
def _(fx):
    rows = _experiment(fx.response).select(
        *EXPERIMENT, "ord", "sample_id", "error_flag", "error_sentence_id", "corrected_sentence", "content"
    )
    source, target, marks = (scratch_path(fx.spark, n) for n in ("arriving", "scored", "marks"))
    rows.write.parquet(source)
    # A second call finds nothing new and adds nothing.
    for _ in range(2):
        scores.score_stream(fx.spark, source, target, marks).awaitTermination()
    return fx.spark.read.parquet(target).select(
        "model", "template", "ord", "ed_pred", "se_pred", "ec_pred", "is_correct", "is_exact_match"
    )
