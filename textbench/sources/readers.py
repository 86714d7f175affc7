"""Readers of the JSON files a benchmark run leaves behind.

Each file holds one JSON value, an array or an object around one. Elements are kept
as raw JSON first: that gives their position in the file and lets a row with a
missing key be set aside instead of failing the job.

`elements.read_elements` reads files of any size with many tasks a file. Texts that
are kept in a table, or many small files (`read_containers`), are split row by
row by `normalize_container`. Every reader here takes the elements of the one or the
(path, text) rows of the other.

Positions restart in every file; `number_files` makes them run over all files,
which duplicate removal and merging need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import text as T
from textbench.session import stored
from textbench.sources import schemas as S
from textbench.sources.elements import LAYOUTS


def read_containers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text): whole files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def normalize_container(files: DataFrame) -> DataFrame:
    """(path, layout, ord, raw): the elements of bare arrays and of wrapped ones.

    The layout is array, samples or interactions. Other top-level values of a
    wrapped file are read with `container_fields`.
    """
    bare = F.ltrim(F.regexp_replace("text", r"\A\s+", "")).startswith("[")
    parts = [
        F.struct(
            F.lit("array").alias("layout"),
            F.when(bare, F.from_json("text", "array<string>")).alias("rows"),
        )
    ]
    # from_json gives the raw text of a nested value where a string is asked for.
    wrapped = F.when(~bare, F.from_json("text", "samples array<string>, interactions array<string>"))
    for name in LAYOUTS:
        parts.append(F.struct(F.lit(name).alias("layout"), wrapped[name].alias("rows")))
    kept = F.filter(F.array(*parts), lambda p: p["rows"].isNotNull())
    held = files.withColumn("_kept", F.get(kept, F.lit(0)))
    return held.select(
        "path",
        F.col("_kept.layout").alias("layout"),
        F.posexplode("_kept.rows").alias("ord", "raw"),
    ).withColumn("ord", F.col("ord").cast("bigint"))


def number_files(rows: DataFrame) -> DataFrame:
    """Let `ord` run over all files, in the order of their paths.

    A file's rows are counted (a row per file); the running sum over files has
    two levels, 4,096 hashed folders of paths and the paths inside them, so no
    task sees all paths. The order is that of the paths inside a folder group.

    The rows are written to the shared folder first: they are read for the counts and
    again by each use of the result, and files would be read and parsed as often. Leave out
    columns that are not needed.
    """
    rows = stored(rows, "numbered")
    sizes = rows.groupBy("path").agg((F.max("ord") + 1).alias("_rows"))
    sizes = sizes.withColumn("_group", F.pmod(F.xxhash64("path"), F.lit(4096)))
    inside = Window.partitionBy("_group").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_group").agg(F.sum("_rows").alias("_all"))
    # At most 4,096 rows.
    ahead = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_ahead"))
    offsets = sizes.withColumn("_in", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    offsets = offsets.join(groups, "_group").select(
        "path", (F.col("_ahead") + F.col("_in")).alias("_before")
    )
    return rows.join(offsets, "path").withColumn("ord", F.col("ord") + F.col("_before")).drop("_before")


def _elements(files: DataFrame) -> DataFrame:
    """Elements as they are, or those of whole files."""
    return files if {"ord", "raw"} <= set(files.columns) else normalize_container(files)


def container_fields(files: DataFrame, schema: str) -> DataFrame:
    """(path, fields…): chosen top-level values of wrapped files."""
    return files.select("path", F.from_json("text", schema).alias("_f")).select("path", "_f.*")


def _has_keys(raw: Column, keys: Sequence[str]) -> Column:
    asked = F.array(*[F.lit(k) for k in keys])
    return F.coalesce(F.size(F.array_except(asked, F.json_object_keys(raw))) == 0, F.lit(False))


def read_items(files: DataFrame) -> DataFrame:
    """Items with `ord` and `is_complete`: rows lacking a required key are kept
    apart by that flag for the caller to quarantine."""
    rows = _elements(files)
    read = rows.withColumn("_item", F.from_json("raw", S.ITEM))
    return read.select(
        "path",
        "ord",
        "_item.*",
        _has_keys(F.col("raw"), S.ITEM_KEYS).alias("is_complete"),
        "raw",
    )


def read_questions(files: DataFrame, prefix: str = K.QUESTION_ID_PREFIX) -> DataFrame:
    """Exam questions; an id that is missing is made from the position."""
    rows = _elements(files).withColumn("_q", F.from_json("raw", S.QUESTION))
    made = F.concat(F.lit(prefix), F.col("ord").cast("string"))
    return rows.select(
        "path",
        "ord",
        F.coalesce("_q.id", made).alias("question_id"),
        "_q.question",
        "_q.choices",
        "_q.answer",
    )


def read_responses(files: DataFrame) -> DataFrame:
    """Run files → one row per interaction.

    The sample id is taken from the interaction or from its sample.
    """
    rows = _elements(files).withColumn("_i", F.from_json("raw", S.INTERACTION))
    r, m = F.col("_i.raw_response"), F.col("_i.response_metadata")
    return rows.select(
        "path",
        "ord",
        F.coalesce("_i.interaction_index", T.interaction_index(F.col("ord"))).alias(
            "interaction_index"
        ),
        F.coalesce("_i.sample_id", "_i.sample_data.sample_id").alias("sample_id"),
        F.col("_i.messages").alias("messages"),
        r["content"].alias("content"),
        r["reasoning"].alias("reasoning"),
        r["error"].alias("error"),
        r["raw_response"].alias("raw_response"),
        m["model"].alias("response_model"),
        m["template"].alias("response_template"),
    )


def read_predictions(files: DataFrame) -> DataFrame:
    """Predictions files → one row per sample; both spellings of the parsers are read."""
    rows = _elements(files).withColumn("_s", F.from_json("raw", S.PREDICTED_SAMPLE))
    p = F.col("_s.predictions")
    index = F.lpad(
        F.col("ord").cast("string"), F.greatest(F.length(F.col("ord").cast("string")), F.lit(3)), F.lit("0")
    )
    return rows.select(
        "path",
        "ord",
        F.coalesce("_s.sample_id", index).alias("sample_id"),
        "_s.sentences",
        "_s.error_flag",
        "_s.error_type",
        "_s.error_sentence_id",
        "_s.error_sentence",
        "_s.corrected_sentence",
        F.coalesce(p["error_detection"], p["errordetection"]).alias("ed_pred"),
        F.coalesce(p["sentence_extraction"], p["sentenceextraction"]).alias("se_pred"),
        F.coalesce(p["error_correction"], p["errorcorrection"]).alias("ec_pred"),
    )


def run_key(path: Column) -> Column:
    """struct(task, dataset, model, template, run_ts) of …/task/dataset/model/template/run/file."""
    names = ["task", "dataset", "model", "template", "run_ts"]
    parts = F.split(path, "/")
    return F.struct(
        *[F.try_element_at(parts, F.lit(i - len(names) - 1)).alias(n) for i, n in enumerate(names)]
    )


def run_catalog(files: DataFrame) -> DataFrame:
    """Add the five experiment keys that a path spells out."""
    return files.withColumn("_key", run_key(F.col("path"))).select("*", "_key.*").drop("_key")
