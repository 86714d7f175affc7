"""Benchmark curation: difficulty filter, duplicates, merging, judge verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import text as T
from textbench.operators.ordinal import (
    piece_of,
    piece_offsets,
    with_position,
    with_sorted_position,
)
from textbench.operators.score import count_where, ratio

#: Error types that may have limits of their own.
MOST_LIMITS = 1000
TEXT_FIELDS = ["sentences", "corrected_text", "error_sentence", "corrected_sentence"]

# --- validation -------------------------------------------------------------


def split_valid_items(items: DataFrame) -> DataFrame:
    """Add `is_valid_item`; the caller keeps or sets aside by it."""
    return items.withColumn(
        "is_valid_item", T.is_valid_item(F.col("error_flag"), F.col("sentences"))
    )


def strip_bold_fields(items: DataFrame) -> DataFrame:
    """Remove bold marks from the text fields an item has, strings or arrays."""
    kinds = {f.name: f.dataType.typeName() for f in items.schema}
    changed = {
        name: T.strip_bold_all(F.col(name)) if kinds[name] == "array" else T.strip_bold(F.col(name))
        for name in TEXT_FIELDS
        if kinds.get(name) in ("string", "array")
    }
    return items.withColumns(changed) if changed else items


# --- difficulty -------------------------------------------------------------


def answer_correctness(preds: DataFrame) -> DataFrame:
    """Add `complete` and `detected`: the rules of the difficulty filter, under
    which an unreadable answer counts as "no error" for detection."""
    flag, truth = F.col("error_flag"), F.col("error_sentence_id")
    ed, se = F.col("ed_pred"), F.col("se_pred")
    expected = F.when((flag == 1) & truth.isNotNull(), truth.cast("string")).otherwise("CORRECT")
    told = (
        F.when(ed == 0, "CORRECT")
        .when(ed == 1, F.coalesce(F.nullif(se, F.lit(0)), F.lit(1)).cast("string"))
        .otherwise(ed.cast("string"))
    )
    return preds.withColumns(
        {
            "complete": F.coalesce(told == expected, F.lit(False)),
            "detected": F.coalesce(ed == 1, F.lit(False)) == F.coalesce(flag == 1, F.lit(False)),
        }
    )


def item_accuracy(preds: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Share of models that solve each item under any template.

    Rows shrink to one per item and model inside the tasks, so neither a
    distinct count nor a hot item weighs on one reducer.
    """
    per_model = (
        answer_correctness(preds)
        .groupBy(*by, "model")
        .agg(F.bool_or("complete").alias("complete"), F.bool_or("detected").alias("detected"))
    )
    counts = per_model.groupBy(*by).agg(
        F.count(F.lit(1)).alias("models"),
        count_where(F.col("complete")).alias("complete_models"),
        count_where(F.col("detected")).alias("detection_models"),
    )
    return accuracy_rates(counts)


def accuracy_rates(counts: DataFrame) -> DataFrame:
    """Add both accuracies to counts of models."""
    return counts.withColumns(
        {
            "complete_accuracy": ratio(F.col("complete_models"), F.col("models")),
            "detection_accuracy": ratio(F.col("detection_models"), F.col("models")),
        }
    )


def accuracy_summary(accuracies: DataFrame) -> DataFrame:
    """(measure, mean, std, min, max) of both accuracies and their difference."""
    measures = {
        "complete": F.col("complete_accuracy"),
        "detection": F.col("detection_accuracy"),
        "difference": F.col("detection_accuracy") - F.col("complete_accuracy"),
    }
    ways = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    wide = accuracies.agg(
        *[way(c).alias(f"{m}_{w}") for m, c in measures.items() for w, way in ways.items()]
    )
    rows = [
        F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}_{w}").alias(w) for w in ways])
        for m in measures
    ]
    return wide.select(F.inline(F.array(*rows)))


def join_item_accuracy(items: DataFrame, accuracies: DataFrame) -> DataFrame:
    """Left join; items nobody answered keep null accuracies."""
    chosen = accuracies.select("sample_id", "complete_accuracy", "detection_accuracy")
    return items.join(chosen, "sample_id", "left")


def quality_filter(
    items: DataFrame,
    limits: DataFrame,
    total_models: int,
    mapping: dict[str, str] | None = None,
) -> DataFrame:
    """Add `split` (adopted, rejected), `rejection_stage` and `rejection_reason`.

    `items` carry the accuracies. `limits` holds error_type (with a `default`
    row), stage1_min_models, stage1_max_models and stage2_max_diff; a type with
    neither own nor default limits is an error. Adopted texts lose bold marks.
    """
    flag = F.coalesce(F.col("error_flag"), F.lit(0))
    typed = items.withColumn(
        "error_type_english",
        F.when(flag == 0, K.NO_ERROR_TYPE).otherwise(T.map_error_type(F.col("error_type"), mapping)),
    )
    names = ["stage1_min_models", "stage1_max_models", "stage2_max_diff"]
    rows = limits.select("error_type", *names).limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"limits for more than {MOST_LIMITS} error types")
    # The few limits become literals: items, with their texts, are not shuffled by their type.
    own = {r.error_type: r for r in rows}
    known = F.col("complete_accuracy").isNotNull() & F.col("detection_accuracy").isNotNull()
    lost = F.raise_error(F.concat(F.lit("no limits for "), F.col("error_type_english")))

    def limit(name):
        kind = limits.schema[name].dataType
        default = F.lit(own["default"][name]).cast(kind) if "default" in own else lost.cast(kind)
        named = [x for t, r in own.items() if t is not None and r[name] is not None for x in (F.lit(t), F.lit(r[name]).cast(kind))]
        listed = F.try_element_at(F.create_map(*named), F.col("error_type_english")) if named else F.lit(None)
        return F.when(known, F.coalesce(listed, default))

    ready = typed.withColumns({n: limit(n) for n in names})
    difference = F.col("detection_accuracy") - F.col("complete_accuracy")
    right = (F.col("complete_accuracy") * total_models).cast("int")
    staged = ready.withColumns({"accuracy_difference": difference, "models_correct": right})
    n = F.col("models_correct")
    outside = (n < F.col("stage1_min_models")) | (n > F.col("stage1_max_models"))
    wide = F.col("accuracy_difference") >= F.col("stage2_max_diff")
    broken = T.is_inconsistent(F.col("error_flag"), F.col("error_sentence_id"))
    staged = staged.withColumn(
        "rejection_stage", F.when(known & outside, 1).when(known & wide, 2).when(known & broken, 3)
    )
    stage = F.col("rejection_stage")

    def percent(c):
        return F.format_string("%.1f%%", c * 100)

    reason = (
        F.when(
            stage == 1,
            F.format_string(
                K.REASON_MODELS.format(total=total_models),
                n,
                "error_type_english",
                "stage1_min_models",
                "stage1_max_models",
            ),
        )
        .when(
            stage == 2,
            F.format_string(
                K.REASON_DIFFERENCE,
                percent(F.col("accuracy_difference")),
                percent(F.col("stage2_max_diff")),
                "error_type_english",
            ),
        )
        .when(stage == 3, K.REASON_INCONSISTENT)
    )
    adopted = known & stage.isNull()
    judged = staged.withColumns(
        {"split": F.when(adopted, "adopted").otherwise("rejected"), "rejection_reason": reason}
    ).drop(*names)
    kinds = {f.name: f.dataType.typeName() for f in items.schema}
    cleaned = {
        name: F.when(F.col("split") == "adopted", T.strip_bold(F.col(name))).otherwise(F.col(name))
        for name in TEXT_FIELDS
        if kinds.get(name) == "string"
    }
    return judged.withColumns(cleaned) if cleaned else judged


def filter_stats(filtered: DataFrame) -> DataFrame:
    """Per error type and in total (null type): counts by outcome and stage.

    Items without accuracies are rejected but belong to no type.
    """
    known = F.col("complete_accuracy").isNotNull() & F.col("detection_accuracy").isNotNull()
    stage = F.col("rejection_stage")
    typed = filtered.where(known)
    return typed.rollup("error_type_english").agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col("split") == "adopted").alias("adopted"),
        count_where(F.col("split") == "rejected").alias("rejected"),
        *[count_where(stage == i).alias(f"stage{i}_filtered") for i in (1, 2, 3)],
    )


def accuracy_distribution(filtered: DataFrame) -> DataFrame:
    """(measure, bin, items) for both accuracies and their difference."""
    known = filtered.where(
        F.col("complete_accuracy").isNotNull() & F.col("detection_accuracy").isNotNull()
    )
    bins = {
        "complete": T.accuracy_bin(F.col("complete_accuracy")),
        "detection": T.accuracy_bin(F.col("detection_accuracy")),
        "difference": T.difference_bin(F.col("detection_accuracy") - F.col("complete_accuracy")),
    }
    rows = [F.struct(F.lit(m).alias("measure"), b.alias("bin")) for m, b in bins.items()]
    return known.select(F.inline(F.array(*rows))).groupBy("measure", "bin").agg(
        F.count(F.lit(1)).alias("items")
    )


def error_breakdown(items: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """(by…, error_flag, items, percent)."""
    counts = items.groupBy(*by, "error_flag").agg(F.count(F.lit(1)).alias("items"))
    # One row per split and flag.
    whole = F.sum("items").over(Window.partitionBy(*by))
    return counts.withColumn("percent", ratio(F.col("items") * 100, whole))


# --- duplicates -------------------------------------------------------------


def _with_base(items: DataFrame) -> DataFrame:
    return items.withColumn("_base", T.base_id(F.coalesce(F.col("sample_id"), F.lit(""))))


def _keep(items: DataFrame, orders: DataFrame, keys: Sequence[str] = ("ord",)) -> DataFrame:
    """Rows whose unique `ord` was chosen; only then are the texts read.

    An `ord` that two rows share is an error: it would keep both. Readers number
    rows over all files, `record_position` numbers records, and `union_models`
    keeps models apart.
    """
    kept = items.join(orders.select(*keys), list(keys), "left_semi")
    # The join has dealt the rows by their keys already.
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    twice = F.raise_error(F.concat(F.lit("position used twice: "), F.col("ord").cast("string")))
    return kept.withColumn("_times", times).withColumn(
        "ord", F.when(F.col("_times") == 1, F.col("ord")).otherwise(twice.cast("bigint"))
    ).drop("_times")


def dedup_first(items: DataFrame) -> DataFrame:
    """First item of each base id."""
    first = _with_base(items.select("sample_id", "ord")).groupBy("_base")
    return _keep(items, first.agg(F.min("ord").alias("ord")))


def dedup_best(items: DataFrame, accuracy: str = "complete_accuracy") -> DataFrame:
    """Item of each base id that most models solve; the first wins a tie."""
    narrow = _with_base(items.select("sample_id", "ord", accuracy))
    score = F.struct(F.coalesce(F.col(accuracy), F.lit(0.0)), -F.col("ord"))
    return _keep(items, narrow.groupBy("_base").agg(F.max_by("ord", score).alias("ord")))


def dedup_alternating(items: DataFrame) -> DataFrame:
    """The k-th duplicate group, in order of first sight, keeps its member k mod size.

    Groups are numbered by their first `ord`. The wanted member is then looked
    up piece by piece, so a group with a third of all rows is spread over as
    many tasks as it has pieces.
    """
    narrow = _with_base(items.select("sample_id", "ord"))
    groups = narrow.groupBy("_base").agg(
        F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    several = with_position(groups.where(F.col("_size") > 1), "_first", "_k")
    picks = several.select("_base", (F.col("_k") % F.col("_size")).alias("_pick"))
    holds = (F.col("_pick") >= F.col("_before")) & (
        F.col("_pick") < F.col("_before") + F.col("_rows")
    )
    # One piece per group: (group, piece, place inside the piece).
    wanted = (
        piece_offsets(narrow, "ord", ["_base"])
        .join(picks, "_base")
        .where(holds)
        .select("_base", "_piece", (F.col("_pick") - F.col("_before") + 1).alias("_place"))
    )
    inside = Window.partitionBy("_base", "_piece").orderBy("ord")
    members = (
        narrow.withColumn("_piece", piece_of(F.col("ord")))
        .join(wanted, ["_base", "_piece"])
        .withColumn("_at", F.row_number().over(inside))
        .where(F.col("_at") == F.col("_place"))
    )
    single = groups.where(F.col("_size") == 1).select(F.col("_first").alias("ord"))
    return _keep(items, members.select("ord").unionByName(single))


# --- merging ----------------------------------------------------------------


def id_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("sample_id").union(right.select("sample_id")).distinct()


def alternate_sides(ids: DataFrame) -> DataFrame:
    """Add `side`: 1 and 2 in turn over the sorted ids."""
    placed = with_sorted_position(ids, [F.col("sample_id")], "_place")
    return placed.withColumn("side", (F.col("_place") % 2 + 1).cast("int")).drop("_place")


def merge_datasets(
    left: DataFrame, right: DataFrame, left_suffix: str = "_m1", right_suffix: str = "_m2"
) -> DataFrame:
    """Union by id. Ids on both sides take turns in sorted order, left first;
    every id gets the suffix of the side it came from."""
    def named(items: DataFrame, side: int) -> DataFrame:
        return items.where(F.col("sample_id") != "").withColumn("side", F.lit(side))

    both = named(left, 1).unionByName(named(right, 2), allowMissingColumns=True)
    side, ord_ = F.col("side"), F.col("ord")
    # Sides and rows are chosen on ids and positions; texts are read once, at the end.
    last = both.groupBy("sample_id").agg(
        F.max(F.when(side == 1, ord_)).alias("_one"), F.max(F.when(side == 2, ord_)).alias("_two")
    )
    shared = F.col("_one").isNotNull() & F.col("_two").isNotNull()
    turns = alternate_sides(last.where(shared))
    alone = last.where(~shared).withColumn("side", F.when(F.col("_one").isNotNull(), 1).otherwise(2))
    chosen = turns.unionByName(alone).select(
        "side", F.when(side == 1, F.col("_one")).otherwise(F.col("_two")).alias("ord")
    )
    kept = _keep(both, chosen, ("side", "ord"))
    suffix = F.when(F.col("side") == 1, left_suffix).otherwise(right_suffix)
    return kept.withColumn("sample_id", F.concat("sample_id", suffix))


def record_position(records: DataFrame, choice: str = "choice") -> DataFrame:
    """Make `ord` of responses unique over their records: five times it plus the choice.

    A choice that is none of the five is an error, as it would take another's position.
    """
    found = F.array_position(F.array(*[F.lit(x) for x in K.CHOICES]), F.col(choice))
    unknown = F.raise_error(F.concat(F.lit("unknown choice: "), F.coalesce(F.col(choice), F.lit("null"))))
    place = F.when(found > 0, found - 1).otherwise(unknown.cast("long"))
    return records.withColumn("ord", F.col("ord") * len(K.CHOICES) + place)


def union_models(
    items: DataFrame,
    models: Sequence[str],
    suffixes: dict[str, str] | None = None,
    model: str = "model",
) -> DataFrame:
    """Items of the listed models, one table with a model column.

    Ids end in the model and `source_model` names it. `ord` numbers the union:
    all items of the first model come first, each model in its own order (which
    must stay below 2**48).
    """
    listed = {m: (suffixes or {}).get(m, m) for m in models}
    ends = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])
    turn = F.array_position(F.array(*[F.lit(m) for m in models]), F.col(model)) - 1
    out = items.where(F.col(model).isin(*models)).withColumns(
        {
            "sample_id": F.concat("sample_id", F.lit("_"), F.element_at(ends, F.col(model))),
            "source_model": F.col(model),
        }
    )
    return out.withColumn("ord", F.shiftleft(turn.cast("bigint"), 48) + F.col("ord")) if "ord" in items.columns else out


# --- verdicts ---------------------------------------------------------------


def consolidate_judgments(
    judgments: DataFrame, parse_error_is_invalid: bool = False
) -> DataFrame:
    """One verdict per item over templates: valid only if all say so, the highest
    count of every criterion, and the explanations by template.

    An unreadable judgment has no verdict and counts as valid without issues
    unless `parse_error_is_invalid`.
    """
    j = F.col("judgment")
    unread = j["parse_error"]
    valid = F.when(unread, F.lit(not parse_error_is_invalid)).otherwise(j["is_valid"])
    numbers = ["total_issues", *K.CRITERIA]
    why = F.when(unread, "").otherwise(F.coalesce(j["explanation"], F.lit("")))
    # A template appears once per item afterwards, so the map is as long as the template list.
    per_template = judgments.groupBy("sample_id", "template").agg(
        F.bool_and(valid).alias("is_valid"),
        *[F.max(j[n]).alias(n) for n in numbers],
        F.max(why).alias("why"),
    )
    return per_template.groupBy("sample_id").agg(
        F.bool_and("is_valid").alias("is_valid"),
        *[F.greatest(F.lit(0).cast("bigint"), F.max(n)).alias(n) for n in numbers],
        F.count(F.lit(1)).alias("judged_templates"),
        F.min("is_valid").alias("_least"),
        F.max("is_valid").alias("_most"),
        F.map_from_entries(F.collect_list(F.struct("template", "why"))).alias("explanations"),
    )


def join_judgments(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add the verdict and `split`: rejected only where a verdict says invalid."""
    joined = items.join(verdicts.drop("_least", "_most"), "sample_id", "left")
    rejected = F.coalesce(~F.col("is_valid"), F.lit(False))
    return joined.withColumn("split", F.when(rejected, "rejected").otherwise("accepted"))


def screening_stats(judged_items: DataFrame) -> DataFrame:
    """One row: screened, valid, invalid and unscreened items and average issues of the invalid."""
    valid = F.col("is_valid")
    return judged_items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(valid).alias("screened"),
        count_where(valid).alias("valid"),
        count_where(~valid).alias("invalid"),
        count_where(valid.isNull()).alias("unscreened"),
        F.coalesce(F.avg(F.when(~valid, F.col("total_issues"))), F.lit(0.0)).alias(
            "avg_issues_invalid"
        ),
    )


def criteria_counts(judged_items: DataFrame) -> DataFrame:
    """(criterion, items) of invalid items, most common first."""
    invalid = judged_items.where(~F.col("is_valid"))
    wide = invalid.agg(*[count_where(F.col(c) > 0).alias(c) for c in K.CRITERIA])
    rows = [F.struct(F.lit(c).alias("criterion"), F.col(c).alias("items")) for c in K.CRITERIA]
    return wide.select(F.inline(F.array(*rows))).orderBy(F.desc("items"), "criterion")


def template_agreement(verdicts: DataFrame) -> DataFrame:
    """One row over items judged under exactly two templates."""
    both = verdicts.where(F.col("judged_templates") == 2)
    same = F.col("_least") == F.col("_most")
    counts = both.agg(
        F.count(F.lit(1)).alias("both_templates"),
        count_where(same).alias("agreements"),
        count_where(~same).alias("disagreements"),
    )
    return counts.withColumn(
        "agreement_rate", ratio(F.col("agreements"), F.col("both_templates"))
    )


def top_groups(df: DataFrame, key: Column, name: str, k: int) -> DataFrame:
    """The k most common values of a column with their counts."""
    return (
        df.groupBy(key.alias(name))
        .agg(F.count(F.lit(1)).alias("items"))
        .orderBy(F.desc("items"), name)
        .limit(k)
    )
