"""Reasoning: taken out of raw responses, and cleaned of remarks about the task."""

from __future__ import annotations

from collections.abc import Sequence

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions.text import null_if_empty, strip


def split_reasoning(
    text: Column, start: str = K.THINK_START, end: str = K.THINK_END
) -> Column:
    """struct(content, reasoning) around the first start tag and the last end tag."""
    first = F.instr(text, start)
    # Position of the last end tag: what follows it is the part after the last split.
    tail = F.substring_index(text, end, -1)
    has_end = F.contains(text, F.lit(end))
    last = F.when(has_end, F.length(text) - F.length(tail) - len(end) + 1).otherwise(F.lit(0))
    both = (first > 0) & (last > first)
    only_end = (first == 0) & (last > 0)
    begin = first + len(start)
    reasoning = (
        F.when(both, strip(F.substr(text, begin, F.greatest(last - begin, F.lit(0)))))
        .when(only_end, strip(F.substr(text, F.lit(1), last - 1)))
        .otherwise("")
    )
    before = null_if_empty(strip(F.substr(text, F.lit(1), first - 1)))
    after = null_if_empty(strip(tail))
    content = (
        F.when(both, F.concat_ws(" ", before, after)).when(only_end, strip(tail)).otherwise(text)
    )
    return F.struct(content.alias("content"), reasoning.alias("reasoning"))


_CHAT = """struct<choices: array<struct<
    message: struct<content: string, reasoning: string, reasoning_content: string>,
    reasoning: string, reasoning_content: string>>>"""
_BLOCKS = "array<struct<type: string, thinking: string>>"


def extract_reasoning_chat(raw: Column) -> Column:
    """First non-empty reasoning of a chat response in JSON; '' when there is none."""
    choice = F.get(F.from_json(raw, _CHAT)["choices"], F.lit(0))
    message = choice["message"]
    content = message["content"]
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, _BLOCKS))
    thought = F.filter(
        blocks,
        lambda b: ((b["type"] == "thinking") & (b["thinking"] != ""))
        | (b["type"] == "redacted_thinking"),
    )
    met = F.get(thought, F.lit(0))
    note = F.when(met["type"] == "redacted_thinking", K.REDACTED_NOTE).otherwise(met["thinking"])
    return F.coalesce(
        null_if_empty(note),
        null_if_empty(message["reasoning"]),
        null_if_empty(message["reasoning_content"]),
        null_if_empty(choice["reasoning"]),
        null_if_empty(choice["reasoning_content"]),
        F.lit(""),
    )


_ITEMS = """struct<output: array<struct<
    type: string, summary: array<struct<type: string, text: string>>>>>"""


def extract_reasoning_items(raw: Column) -> Column:
    """Summary texts of the reasoning items of a response, joined by blank lines."""
    items = F.filter(F.from_json(raw, _ITEMS)["output"], lambda i: i["type"] == "reasoning")
    parts = F.flatten(F.transform(items, lambda i: F.coalesce(i["summary"], F.array())))
    texts = F.transform(
        F.filter(parts, lambda p: (p["type"] == "summary_text") & (p["text"] != "")),
        lambda p: p["text"],
    )
    return F.coalesce(F.array_join(texts, "\n\n"), F.lit(""))


def redact_keys(raw: Column, keys: Sequence[str]) -> Column:
    """Drop the named keys at every depth of a free JSON text.

    Texts that are no JSON stay as they are, whatever they mention.
    """
    secret = frozenset(keys)

    def without(value):
        if isinstance(value, dict):
            return {k: without(v) for k, v in value.items() if k not in secret}
        if isinstance(value, list):
            return [without(v) for v in value]
        return value

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        import json

        def clean(text):
            if text is None:
                return None
            try:
                return json.dumps(without(json.loads(text)), ensure_ascii=False)
            except ValueError:
                return text

        return texts.map(clean)

    # A function of Python runs on every row, so texts that name no key go in as nulls.
    names = "|".join(re.escape(k) for k in keys)
    named = F.when(raw.rlike(f'"(?:{names})"'), raw)
    return F.coalesce(redact(named), raw) if keys else raw


# --- cleaning ---------------------------------------------------------------


def _quoted(phrase: str) -> str:
    return r"\Q" + phrase + r"\E"


def _by_first_letters(rows: Sequence[tuple[str, str]]) -> str:
    """Pattern of (text, what follows) rows that shares common beginnings, so that
    most positions of a text are settled by one look at their letter."""
    branches: dict[str, list[tuple[str, str]]] = {}
    ends = []
    for text, rest in rows:
        if text:
            branches.setdefault(text[0].lower(), []).append((text[1:], rest))
        else:
            ends.append(rest)
    if "" in ends:  # a phrase ends here, so whatever is longer matches too
        return ""
    parts = []
    for letter, tails in branches.items():
        if len(tails) == 1:
            text, rest = tails[0]
            parts.append(_quoted(letter + text) + rest)
        else:
            parts.append(_quoted(letter) + _by_first_letters(tails))
    return "(?:" + "|".join(parts + ends) + ")"


def removal_pattern(
    phrases: Sequence[str], sequences: Sequence[Sequence[str]] = (), period: str = "."
) -> str:
    """One pattern for a whole sentence that holds a phrase, or phrases in a row on one line.

    It can start only where a sentence starts and gives up at once on a text
    without a closing period, so every sentence is read once. After each phrase
    of a sequence the nearest next one is taken for good: if a later one would
    do, so does the nearest.
    """
    line, sentence = f"[^{period}\n]", f"[^{period}]"
    rows = [(p, "") for p in phrases]
    for first, *rest in sequences:
        rows.append((first, "".join(f"(?>{line}*?{_quoted(p)})" for p in rest)))
    hit = _by_first_letters(rows)
    close = re.escape(period)
    return f"(?iu)(?<!{sentence})(?={sentence}*+{close}){sentence}*?{hit}{sentence}*+{close}"


PATTERN_EN = removal_pattern(K.PHRASES_EN, K.SEQUENCES_EN, ".")
PATTERN_JA = removal_pattern(K.PHRASES_JA, K.SEQUENCES_JA, "。")


# Stands for a removed sentence until it is counted; a private character.
_MARK = "\ue0ff"


def clean_reasoning(text: Column, pattern: str) -> Column:
    """struct(text, removed): the text without the matching sentences and their number."""

    def result(kept, removed):
        return F.struct(kept.alias("text"), removed.cast("int").alias("removed"))

    # One pass puts a mark for each sentence; marks are then counted and taken out.
    marked = F.transform(
        F.array(F.regexp_replace(text, pattern, _MARK)),
        lambda m: result(
            F.replace(m, F.lit(_MARK), F.lit("")),
            F.length(m) - F.length(F.replace(m, F.lit(_MARK), F.lit(""))),
        ),
    )
    # A text that holds the mark itself takes two passes.
    twice = result(F.regexp_replace(text, pattern, ""), F.regexp_count(text, F.lit(pattern)))
    return F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(F.get(marked, F.lit(0)))


def clean_reasoning_en(text: Column) -> Column:
    return clean_reasoning(text, PATTERN_EN)


def clean_reasoning_ja(text: Column) -> Column:
    return clean_reasoning(text, PATTERN_JA)
