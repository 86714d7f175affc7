"""Prompts: a template text and the columns of an item become chat messages."""

from __future__ import annotations

from collections.abc import Mapping

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import text as T

_FIELD = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill `{name}` fields in one pass; braces in the values stay as they are.

    `{{` and `}}` stand for braces. A field without a value is an error; a null
    value prints as None.
    """
    parts: list[Column] = []
    end = 0
    for field in _FIELD.finditer(template):
        if field.start() > end:
            parts.append(F.lit(template[end : field.start()]))
        name = field.group(1)
        if name is None:
            parts.append(F.lit(field.group()[0]))
        elif name not in values:
            raise KeyError(f"template variable {name!r} has no value")
        else:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
        end = field.end()
    parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def messages(system: Column, user: Column) -> Column:
    rows = [(F.lit("system"), system), (F.lit("user"), user)]
    return F.array(*[F.struct(r.alias("role"), c.alias("content")) for r, c in rows])


def render_templates(
    df: DataFrame,
    templates: Mapping[str, tuple[str, str]],
    values: Mapping[str, Column],
    template: str = "template",
) -> DataFrame:
    """Add `messages` by the row's template name; an unknown name is an error.

    `templates` maps a name to its (system, user) texts. They are a parameter of
    the job, so they become literals of the plan and need no join.
    """
    name = F.col(template)
    system = user = None
    for key, (system_text, user_text) in templates.items():
        filled = render(system_text, values), render(user_text, values)
        system = F.when(name == key, filled[0]) if system is None else system.when(name == key, filled[0])
        user = F.when(name == key, filled[1]) if user is None else user.when(name == key, filled[1])
    lost = F.raise_error(F.concat(F.lit("no template "), name)).cast("string")
    return df.withColumn("messages", messages(system.otherwise(lost), user.otherwise(lost)))


def choices_text(choices: Column) -> Column:
    """`a: text` lines in the order of the map."""
    rows = F.transform(
        F.map_entries(choices), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return F.array_join(rows, "\n")


def question_values(question: Column, choices: Column, answer: Column) -> dict[str, Column]:
    """Values of the synthesis prompt."""
    return {
        "question": question,
        "choices_text": choices_text(choices),
        "correct_choices_list": F.array_join(answer, ", "),
        "wrong_choices_list": F.array_join(T.wrong_choices(answer), ", "),
    }


def detection_values(template: Column, hints: Mapping[str, Mapping[str, tuple[str, str]]]) -> dict[str, Column]:
    """Values of the detection prompt from the item columns and the template name.

    Prior templates get both percentages. `hints` maps a language to its hint
    texts, each as (with error, without error) with item fields in braces; they
    are filled in for templates whose name contains "cheat".
    """
    item = {
        n: F.col(n)
        for n in (
            "sentences",
            "error_flag",
            "error_sentence_id",
            "error_sentence",
            "corrected_sentence",
        )
    }
    prior = T.template_prior(template)
    values = {**item, "error_probability": prior, "correct_probability": 100 - prior}
    plain = F.regexp_replace(template, r"_lark\z", "")
    wanted = F.contains(plain, F.lit("cheat"))
    names = {n for texts in hints.values() for n in texts}
    for n in sorted(names):
        by_language = {
            lang: F.when(F.col("error_flag") == 1, render(texts[n][0], item)).otherwise(
                render(texts[n][1], item)
            )
            for lang, texts in hints.items()
        }
        text = F.when(plain.endswith("_ja"), by_language["ja"]).otherwise(by_language["en"])
        values[n] = F.when(wanted, text)
    return values


def system_kind(template: Column) -> Column:
    """Which system text a detection template uses: reasoning_ja, reasoning_en, ja or en."""
    plain = F.regexp_replace(template, r"_lark\z", "")
    return (
        F.when(plain.rlike(r"_reasoning(_cheat)?_ja\z"), "reasoning_ja")
        .when(plain.rlike(r"_reasoning(_cheat)?_en\z"), "reasoning_en")
        .when(plain.endswith("_ja"), "ja")
        .otherwise("en")
    )


def judge_values(sample_id: Column, choices: Column, answer: Column) -> dict[str, Column]:
    """Values that the judge prompt adds to the item columns."""
    used = T.used_choice(sample_id, choices)
    return {
        "choices_text": choices_text(choices),
        "correct_choices_list": F.array_join(answer, ", "),
        "used_choice": used["choice"],
        "used_choice_text": used["text"],
    }
