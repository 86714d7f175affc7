"""Text predicates and projections: every function takes and returns columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench import constants as K

# (?U): \w \d \s know all scripts; (?d): only \n ends a line.
UNICODE = "(?Ud)"


# All characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(UNICODE + r"\A\s*\z")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- predicates -------------------------------------------------------------


def is_valid_item(error_flag: Column, sentences: Column) -> Column:
    """The flag is 0 or 1 and the text is not blank."""
    return F.coalesce(error_flag.isin(0, 1), F.lit(False)) & ~is_blank(sentences)


def is_valid_question(question: Column, choices: Column, answer: Column) -> Column:
    """Question, choices and answer are given and each answer is one of the choices."""
    known = F.forall(answer, lambda a: F.map_contains_key(choices, a))
    return (
        ~is_blank(question)
        & F.coalesce((F.size(choices) > 0) & (F.size(answer) > 0) & known, F.lit(False))
    )


def has_underlined_part(question: Column) -> Column:
    return F.coalesce(question.rlike(UNICODE + r"下\s*線\s*部"), F.lit(False))


def has_numeric_choices(choices: Column) -> Column:
    """The choices are exactly a=1 … e=5, no more and no fewer."""
    same = [
        F.try_element_at(choices, F.lit(k)) == F.lit(v) for k, v in K.NUMERIC_CHOICES.items()
    ]
    exact = reduce(lambda x, y: x & y, same, F.size(choices) == len(same))
    return F.coalesce(exact, F.lit(False))


def is_inconsistent(error_flag: Column, error_sentence_id: Column) -> Column:
    """An item with an error but without the number of the wrong sentence."""
    number = error_sentence_id.cast("string")
    missing = number.isNull() | (F.lower(number) == "nan")
    return F.coalesce(error_flag == 1, F.lit(False)) & missing


def is_failed_response(content: Column, error: Column) -> Column:
    return F.coalesce(error != "", F.lit(False)) | is_blank(content)


# --- cleaning ---------------------------------------------------------------


def strip_bold(c: Column) -> Column:
    return F.regexp_replace(c, r"(?d)\*\*(.*?)\*\*", "$1")


def strip_bold_all(c: Column) -> Column:
    return F.transform(c, strip_bold)


def strip_decoration(c: Column) -> Column:
    """Take off code fences, back-ticks and the quotes around an answer."""
    fence = F.regexp_replace(c, UNICODE + r"```\w*\s*\n", "")
    fence = F.regexp_replace(fence, UNICODE + r"```\w*", "")
    ticks = F.regexp_replace(fence, r"`([^`]*)`", "$1")
    ticks = F.replace(ticks, F.lit("```"), F.lit(""))
    # Most answers hold no back-tick; a byte search settles that without a pattern.
    plain = F.when(F.contains(c, F.lit("`")), ticks).otherwise(c)
    return strip(F.trim(strip(plain), F.lit("\"'")))


def clean_quotes(c: Column) -> Column:
    """Strip, then peel double quotes from both ends; one quote always stays."""
    text = strip(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r'(?s)\A"+(?=.)', "")
    return F.regexp_replace(text, r'(?s)(?<=[^"])"+\z', "")


def truncate_middle(c: Column, limit: int = K.MAX_CORRECTION_CHARS) -> Column:
    """Keep both ends of an over-long answer, as the published scoring does."""
    half = (limit - len(K.TRUNCATION_MARK)) // 2
    cut = F.concat(F.left(c, F.lit(half)), F.lit(K.TRUNCATION_MARK), F.right(c, F.lit(half)))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def normalize_text(c: Column) -> Column:
    spaced = F.regexp_replace(strip(c), UNICODE + r"\s+", " ")
    return F.lower(F.regexp_replace(spaced, "[。、！？，．]", ""))


# --- language and tokens ----------------------------------------------------


def _count(c: Column, others: str) -> Column:
    return F.length(F.regexp_replace(c, others, ""))


def detect_language(c: Column) -> Column:
    """ja, en or unknown by the share of kana and kanji or of ASCII letters."""
    visible = _count(c, UNICODE + r"\s+")
    ja = _count(c, r"[^぀-ゟ゠-ヿ一-龯]+") / visible
    en = _count(c, "[^a-zA-Z]+") / visible
    return (
        F.when(is_blank(c), "unknown").when(ja > 0.1, "ja").when(en > 0.5, "en").otherwise("unknown")
    )


def word_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def char_tokens(c: Column) -> Column:
    return F.regexp_extract_all(strip(c), F.lit("(?s)."), F.lit(0))


def tokenize(c: Column, language: Column, method: str = "auto", japanese=char_tokens) -> Column:
    """Tokens by language. `japanese` maps a text column to tokens, such as a
    `pandas_udf` around a morphological analyser; characters are the default."""
    ways = {"mecab": japanese, "char": char_tokens, "none": word_tokens}
    if method != "auto":
        tokens = ways[method](c)
    else:
        tokens = (
            F.when(language == "ja", japanese(c))
            .when(language == "en", word_tokens(c))
            .otherwise(char_tokens(c))
        )
    return F.coalesce(tokens, F.array().cast("array<string>"))


# --- no-answer handling of corrections --------------------------------------


def _is_parse_failed(c: Column) -> Column:
    return strip(F.upper(c)) == K.PARSE_FAILED


def is_na_text(c: Column) -> Column:
    """The text says that there is nothing to correct."""
    text = strip(F.upper(c))
    says_so = text.isin("NA", "CORRECT", "_CORRECT_", "") | text.rlike(r"(?U)\bCORRECT\b")
    return ~_is_parse_failed(c) & says_so


def na_case(prediction: Column, reference: Column) -> Column:
    """struct(is_na, score): decided without comparing words when either side has none."""
    pred, ref = is_na_text(prediction), is_na_text(reference)
    either = _is_parse_failed(prediction) | pred | ref
    both = ~_is_parse_failed(prediction) & pred & ref
    return F.struct(either.alias("is_na"), F.when(both, 1.0).otherwise(0.0).alias("score"))


# --- small helpers ----------------------------------------------------------


def text_between(c: Column, start: str, end: str) -> Column:
    """Stripped text between two patterns, null where they do not occur."""
    pattern = f"(?is){start}(.*?){end}"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def first_number(c: Column) -> Column:
    """The first number; one beyond a bigint counts as the largest bigint."""
    digits = F.regexp_extract(c, UNICODE + r"\d+", 0)
    most = F.when(digits != "", F.lit(2**63 - 1))
    return F.coalesce(fold_digits(digits).try_cast("bigint"), most)


def fold_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def yes_no(c: Column) -> Column:
    """1 for any yes word, else 0 for any no word, else null."""

    def any_of(words):
        return reduce(lambda x, y: x | y, [F.contains(F.lower(c), F.lit(w)) for w in words])

    return F.when(any_of(K.YES_WORDS), 1).when(any_of(K.NO_WORDS), 0)


def _bin(c: Column, zero: Column, limits: list[float], labels: list[str]) -> Column:
    out = F.when(zero, labels[0])
    for limit, label in zip(limits, labels[1:]):
        out = out.when(c < limit, label)
    return out.otherwise(labels[-1])


def accuracy_bin(c: Column) -> Column:
    return _bin(c, c == 0.0, [0.25, 0.5, 0.75, 1.0], K.ACCURACY_BINS)


def difference_bin(c: Column) -> Column:
    return _bin(c, c < 0, [0.1, 0.2, 0.3, 0.4], K.DIFFERENCE_BINS)


def map_error_type(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """English name of an error type; names outside the mapping pass through."""
    named = c
    if mapping:
        pairs = [F.lit(x) for pair in mapping.items() for x in pair]
        named = F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
    return F.when(c.isNull() | c.isin("", "None"), K.NO_ERROR_TYPE).otherwise(named)


def base_id(c: Column) -> Column:
    """Drop the last `_` part of an id of three or more parts."""
    parts = F.split(c, "_")
    kept = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_")
    return F.when(F.size(parts) >= 3, kept).otherwise(c)


def used_choice(sample_id: Column, choices: Column) -> Column:
    """struct(choice, text) named by the second part of the id, if it is a choice."""
    key = F.get(F.split(sample_id, "_"), F.lit(1))
    known = F.coalesce(F.map_contains_key(choices, F.coalesce(key, F.lit(""))), F.lit(False))
    return F.struct(
        F.when(known, key).otherwise(K.UNKNOWN_CHOICE).alias("choice"),
        F.when(known, F.try_element_at(choices, key)).otherwise(K.UNKNOWN_CHOICE).alias("text"),
    )


def nth_sentence(sentences: Column, k: Column) -> Column:
    """Line k of a numbered text, counted from 1; '' outside of it."""
    line = F.get(F.split(sentences, "\n"), k.cast("int") - 1)
    return F.coalesce(line, F.lit(""))


def template_is_lark(name: Column) -> Column:
    return name.endswith("_lark")


def _plain_template(name: Column) -> Column:
    return F.regexp_replace(name, r"_lark\z", "")


def template_prior(name: Column) -> Column:
    """Prior probability in percent that a template name carries."""
    digits = F.regexp_extract(_plain_template(name), r"(?U)\A.*_prior_(\d+)_(?:en|ja)\z", 1)
    return fold_digits(digits).try_cast("int")


def base_template(name: Column) -> Column:
    plain = _plain_template(name)
    general = F.regexp_replace(plain, r"(?U)_prior_\d+_", "_prior_")
    return F.when(plain.rlike(r"(?U)\A.*_prior_\d+_(?:en|ja)\z"), general).otherwise(plain)


def wrong_choices(answer: Column) -> Column:
    letters = F.array(*[F.lit(x) for x in K.CHOICES])
    return F.filter(letters, lambda x: ~F.array_contains(answer, x))


def missing_choices(found: Column) -> Column:
    """Choices of a question for which no record was read."""
    return F.array_except(F.array(*[F.lit(x) for x in K.CHOICES]), found)


def interaction_index(position: Column) -> Column:
    """1-based position padded to three digits; longer numbers stay whole."""
    number = (position + 1).cast("string")
    return F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))
