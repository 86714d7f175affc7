"""Free-text answers to "find and fix the error" as columns.

An answer is looked at in three stages: the asked-for `number: text` after
decorations are taken off, then common variants, then rarer ones. The first
stage that yields something wins. Whole answers are read and any sentence
number counts; the limits of the published scoring (`MAX_CORRECTION_CHARS`,
`MAX_LISTED_SENTENCE`) are options. `coalesce` stops at the first hit, so an
answer in the asked-for form costs one pattern only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions.text import (
    UNICODE,
    fold_digits,
    null_if_empty,
    strip,
    strip_decoration,
    truncate_middle,
)

# The answer forms. Each row holds a text that the form cannot do
# without, the pattern of the sentence number, whether the number may be
# limited, and the pattern of the corrected text.
PRIMARY_FORMS = [
    (":", r"(?m)^\s*(\d+)\s*:\s*.+", False, r"(?ms)^\s*\d+\s*:\s*(.+?)(?:\n\n|\n[A-Z]|\n\*|\n-|$)"),
]
SECONDARY_FORMS = [
    ("文", r"文(\d+)\s*:\s*.+", False, r"文\d+\s*:\s*(.+?)(?:\n|$)"),
    (".", r"(?m)^\s*(\d+)\.\s*.+", True, r"(?m)^\s*\d+\.\s*(.+?)(?:\n|$)"),
    ("文番号", r"文番号\s*:\s*(\d+)\s*:\s*.+", False, r"文番号\s*:\s*\d+\s*:\s*(.+?)(?:\n|$)"),
    ("文番号", r"(?m)文番号\s*:\s*(\d+)\s*\n\s*\d+\.\s*.+", False, r"(?m)文番号\s*:\s*\d+\s*\n\s*\d+\.\s*(.+?)(?:\n|$)"),
]
TERTIARY_FORMS = [
    ("文番号", r"文番号\s*:\s*(\d+)\.", False, r"文番号\s*:\s*\d+\.\s*(.+?)(?:\n|$)"),
    ("文目", r"(\d+)文目\s*:", False, r"\d+文目\s*:\s*(.+?)(?:\n|$)"),
    ("文番号", r"文番号(\d+)\s*:", False, r"文番号\d+\s*:\s*(.+?)(?:\n|$)"),
    ("-", r"-\s*(\d+)\s*:", True, r"-\s*\d+\s*:\s*(.+?)(?:\n|$)"),
    ("文番号", r"(?m)文番号\s*:\s*(\d+)\s*\n\s*.+", False, r"(?m)文番号\s*:\s*\d+\s*\n\s*(.+?)(?:\n|$)"),
    ("文番号", r"文番号\s*:\s*(\d+)\s+.+", False, r"文番号\s*:\s*\d+\s+(.+?)(?:\n|$)"),
]
# Words that say there is no error, each with a text it cannot do without.
CORRECT_WORD = ("CORRECT", r"(?i)\bCORRECT\b|_CORRECT_")
NO_ERROR_WORD = ("なし", r"(?i)\b(?:エラーなし|誤りなし|間違いなし|問題なし)\b")

NO_ERROR = -2  # inner mark: the answer says that nothing is wrong


def _found(c: Column, need: str, pattern: str) -> Column:
    """Group 1 of the first match, null without one. A byte search for the text
    that the form needs comes first, so most answers skip most patterns."""
    return F.when(
        F.contains(c, F.lit(need)), null_if_empty(F.regexp_extract(c, UNICODE + pattern, 1))
    )


def _number(c: Column, need: str, pattern: str, limited: bool, most: int | None) -> Column:
    digits = _found(c, need, pattern)
    # A number too long for a bigint is still a number.
    numbers = F.transform(
        F.array_compact(F.array(digits)),
        lambda d: F.coalesce(fold_digits(d).try_cast("bigint"), F.lit(2**63 - 1)),
    )
    if limited:
        numbers = F.filter(numbers, lambda n: (n >= 1) if most is None else n.between(1, most))
    return F.get(numbers, F.lit(0))


def _numbers(c: Column, forms, most: int | None) -> Column:
    return F.coalesce(
        *[_number(c, need, number, limited, most) for need, number, limited, _ in forms]
    )


def _texts(c: Column, forms) -> Column:
    return F.coalesce(*[null_if_empty(strip(_found(c, need, text))) for need, _, _, text in forms])


def _says(c: Column, word: tuple[str, str]) -> Column:
    need, pattern = word
    return F.contains(F.upper(c), F.lit(need)) & c.rlike(UNICODE + pattern)


def answer_outcome(text: Column, plain: Column, most_listed: int | None = None) -> Column:
    """Sentence number, -2 when the answer sees no error, -1 when it cannot be read.

    `text` is the stripped answer, `plain` the same without decorations. With
    `most_listed` the forms `N.` and `- N:` take no higher number.
    """
    return F.coalesce(
        F.when(_says(plain, CORRECT_WORD), F.lit(NO_ERROR).cast("bigint")),
        _numbers(plain, PRIMARY_FORMS, most_listed),
        _numbers(text, SECONDARY_FORMS, most_listed),
        F.when(_says(text, NO_ERROR_WORD), F.lit(NO_ERROR).cast("bigint")),
        _numbers(text, TERTIARY_FORMS, most_listed),
        F.lit(K.NO_ANSWER).cast("bigint"),
    )


def outcome_detection(outcome: Column) -> Column:
    return F.when(outcome == NO_ERROR, 0).when(outcome == K.NO_ANSWER, K.NO_ANSWER).otherwise(1)


def outcome_sentence_id(outcome: Column) -> Column:
    return F.when(outcome == NO_ERROR, F.lit(0).cast("bigint")).otherwise(outcome)


def correction_text(text: Column, plain: Column) -> Column:
    """Corrected text, '' no error, PARSE_FAILED unreadable.

    A CORRECT answer only ends the first stage: the later ones still look for
    a text in the undecorated answer.
    """
    return F.coalesce(
        F.when(~_says(plain, CORRECT_WORD), _texts(plain, PRIMARY_FORMS)),
        _texts(text, SECONDARY_FORMS),
        F.when(~_says(text, NO_ERROR_WORD), _texts(text, TERTIARY_FORMS)),
        F.when(_says(text, CORRECT_WORD), F.lit("")),
        F.lit(K.PARSE_FAILED),
    )


def _prepared(df: DataFrame, content: str, most_chars: int | None = None) -> DataFrame:
    """Add `_text` and `_plain`, each computed once however many patterns read it."""
    c = F.coalesce(F.col(content), F.lit(""))
    text = strip(c if most_chars is None else truncate_middle(c, most_chars))
    return df.withColumn("_text", text).withColumn("_plain", strip_decoration(F.col("_text")))


def parse_outcome(
    df: DataFrame, content: str = "content", most_listed: int | None = None
) -> DataFrame:
    """Add `ed_pred` (1 error, 0 none, -1 unreadable) and `se_pred`, the number of
    the wrong sentence (0 none, -1 unreadable)."""
    read = _prepared(df, content).withColumn(
        "_outcome", answer_outcome(F.col("_text"), F.col("_plain"), most_listed)
    )
    both = {
        "ed_pred": outcome_detection(F.col("_outcome")),
        "se_pred": outcome_sentence_id(F.col("_outcome")),
    }
    return read.withColumns(both).drop("_outcome", "_text", "_plain")


def parse_correction(
    df: DataFrame, content: str = "content", most_chars: int | None = None
) -> DataFrame:
    """Add `ec_pred`: corrected text, '' no error, PARSE_FAILED unreadable.

    With `most_chars` a longer answer is read as its two ends.
    """
    read = _prepared(df, content, most_chars)
    return read.withColumn("ec_pred", correction_text(F.col("_text"), F.col("_plain"))).drop(
        "_text", "_plain"
    )


def parse_answers(
    df: DataFrame,
    content: str = "content",
    most_chars: int | None = None,
    most_listed: int | None = None,
) -> DataFrame:
    """Add `ed_pred`, `se_pred` and `ec_pred`."""
    return parse_correction(parse_outcome(df, content, most_listed), content, most_chars)
