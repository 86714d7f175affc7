"""JSON verdicts inside free text: quality judgments and error-type labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions.text import UNICODE, null_if_empty, strip

_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def _json_map(text: Column) -> Column:
    """JSON object as a map; null when it is none."""
    return F.from_json(text, "map<string,string>", _JSON_OPTIONS)


def _last(entries: Column, key: str) -> Column:
    """struct(key, value) of the last entry of that name, null if there is none."""
    return F.try_element_at(F.filter(F.map_entries(entries), lambda e: e["key"] == key), F.lit(-1))


def response_text(content: Column, first_choice: Column) -> Column:
    """Text of a response whichever way the service wraps it; null when it failed."""
    return null_if_empty(F.coalesce(content, first_choice))


def parse_judgments(
    df: DataFrame, output: str = "output", into: str = "judgment", language: str = "auto"
) -> DataFrame:
    """Add a struct of seven criteria, total_issues, is_valid, explanation,
    detected_language and parse_error; -1 everywhere when unreadable."""
    # One projection per step: what a later one reads more than once is computed once.
    found = df.withColumn("_raw", null_if_empty(F.regexp_extract(output, r"(?s)\{.*?\}", 0)))
    fields = ", ".join(f"{name} string" for name in [*K.CRITERIA, "explanation"])
    read = found.withColumns(
        {
            "_keys": F.coalesce(F.map_keys(_json_map(F.col("_raw"))), F.array().cast("array<string>")),
            # The last of several entries of a name counts.
            "_value": F.from_json("_raw", fields, _JSON_OPTIONS),
        }
    )

    def has(name):
        return F.array_contains("_keys", name)

    if language == "auto":
        en = has("unrealistic_scenario") | has("inconsistent_context")
        ja = has("extra_elements") | has("synthesis_consistency_error")
        is_en = en & ~ja
    else:
        is_en = F.lit(language == "en")

    def number(name):
        value = F.col("_value")[name]
        # A JSON true counts one; the text "true" does not.
        yes = (value == "true") & F.col("_raw").rlike(rf'"{name}"\s*:\s*true')
        real = value.try_cast("double")
        whole = F.when(F.isnan(real), 0).otherwise(real.try_cast("bigint"))
        return F.when(yes, 1).otherwise(F.coalesce(whole, F.lit(0))).cast("bigint")

    def infinite(name):
        # The reader puts quotes around numbers beyond a double.
        value = F.trim(F.col("_value")[name], F.lit('"'))
        return F.coalesce(F.abs(value.try_cast("double")) == float("inf"), F.lit(False))

    def all_of(names):
        asked = F.array(*[F.lit(n) for n in [*names, "explanation"]])
        good = F.size(F.array_except(asked, F.col("_keys"))) == 0
        for name in names:
            good = good & ~infinite(name)
        return good

    judged = read.withColumns(
        {
            "_en": is_en,
            "_good": F.when(is_en, all_of(K.CRITERIA_EN)).otherwise(all_of(K.CRITERIA_JA)),
            "_number": F.struct(*[number(name).alias(name) for name in K.CRITERIA]),
        }
    )
    zero, lost = (F.lit(x).cast("bigint") for x in (0, -1))

    def score(name):
        value = F.col("_number")[name]
        if not (name in K.CRITERIA_JA and name in K.CRITERIA_EN):
            value = F.when(F.col("_en") == (name in K.CRITERIA_EN), value).otherwise(zero)
        return F.when(F.col("_good"), value).otherwise(lost)

    scored = judged.withColumn("_score", F.struct(*[score(name).alias(name) for name in K.CRITERIA]))
    total = sum((F.col("_score")[name] for name in K.CRITERIA[1:]), F.col("_score")[K.CRITERIA[0]])
    scored = scored.withColumn("_total", F.when(F.col("_good"), total).otherwise(lost))
    good = F.col("_good")
    judgment = F.struct(
        *[F.col("_score")[name].alias(name) for name in K.CRITERIA],
        F.col("_total").alias("total_issues"),
        (F.col("_total") == 0).alias("is_valid"),
        F.when(good, F.col("_value.explanation")).otherwise("Parse error").alias("explanation"),
        F.when(good, F.when(F.col("_en"), "en").otherwise("ja"))
        .otherwise("unknown")
        .alias("detected_language"),
        (~good).alias("parse_error"),
    )
    steps = ["_raw", "_keys", "_value", "_en", "_good", "_number", "_score", "_total"]
    return scored.withColumn(into, judgment).drop(*steps)


def extract_json(output: Column) -> Column:
    """The fenced JSON object, else the first brace pair, else the whole text."""
    text = strip(output)
    fenced = F.regexp_extract(text, UNICODE + r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    whole = F.when(text.startswith("{") & text.endswith("}"), text)
    return F.coalesce(
        null_if_empty(fenced), null_if_empty(F.regexp_extract(text, r"(?s)\{.*?\}", 0)), whole
    )


def parse_error_types(df: DataFrame, output: str = "output", into: str = "label") -> DataFrame:
    """Add struct(error_type, confidence, explanation, parse_error)."""
    found = df.withColumn("_raw", extract_json(F.col(output)))
    parsed = found.withColumn("_read", _json_map(F.col("_raw")))
    return parsed.withColumn(into, _label(F.col("_raw"), F.col("_read"))).drop("_raw", "_read")


def _label(raw: Column, read: Column) -> Column:

    def text(name):
        return strip(_last(read, name)["value"])

    # `reasoning` stands in only when `explanation` is absent, and both must be texts.
    def text_if_string(name):
        return F.when(raw.rlike(rf'"{name}"\s*:\s*"'), text(name))

    kind, level = F.lower(text("error_type")), F.lower(text("confidence"))
    why = F.when(F.map_contains_key(read, "explanation"), text_if_string("explanation")).otherwise(
        text_if_string("reasoning")
    )
    good = F.coalesce(
        kind.isin(*K.ERROR_TYPES) & level.isin(*K.CONFIDENCE_LEVELS) & (why != ""), F.lit(False)
    )
    return F.struct(
        F.when(good, kind).alias("error_type"),
        F.when(good, level).alias("confidence"),
        F.when(good, why).alias("explanation"),
        (~good).alias("parse_error"),
    )
