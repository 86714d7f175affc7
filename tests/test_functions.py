"""Functions on hand-made rows and against small plain-Python models."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textbench import constants as K
from textbench.functions import answers as A
from textbench.functions import reasoning as R
from textbench.functions import rouge as G
from textbench.functions import synthesis as S
from textbench.functions import text as T
from textbench.functions import verdicts as V
from textbench.operators import prompts

# content, detection, sentence id, correction
ANSWERS = [
    ("CORRECT", 0, 0, ""),
    ("the text is correct.", 0, 0, ""),
    ("```text\n_CORRECT_\n```", 0, 0, ""),
    ("3: fix it", 1, 3, "fix it"),
    ("`3: fix it`", 1, 3, "fix it"),
    ('"3: fix it"', 1, 3, "fix it"),
    ("```plaintext\n4: fixed\n```", 1, 4, "fixed"),
    ("12 : first line\nsecond line", 1, 12, "first line"),
    ("0: zero", 1, 0, "zero"),
    ("99999999999999999999: big", 1, 2**63 - 1, "big"),
    ("文17: abc", 1, 17, "abc"),
    ("7. abc", 1, 7, "abc"),
    ("50. abc", 1, 50, "abc"),
    ("51. abc", 1, 51, "abc"),
    ("文番号: 3: abc", 1, 3, "abc"),
    ("文番号: 5\n5. abc", 1, 5, "abc"),
    ("文番号 : 3. abc", 1, 3, "abc"),
    ("5文目: abc", 1, 5, "abc"),
    ("文番号6: abc", 1, 6, "abc"),
    ("x - 8: abc", 1, 8, "abc"),
    ("x - 51: abc", 1, 51, "abc"),
    ("文番号: 4\nabc", 1, 4, "abc"),
    ("文番号: ９ abc", 1, 9, "abc"),
    ("エラーなし", 0, 0, K.PARSE_FAILED),
    ("問題なし", 0, 0, K.PARSE_FAILED),
    ("CORRECT\n5. x", 0, 0, "x"),
    ("no idea", -1, -1, K.PARSE_FAILED),
    ("", -1, -1, K.PARSE_FAILED),
    (None, -1, -1, K.PARSE_FAILED),
]


def test_answers(spark):
    rows = [(i, a[0]) for i, a in enumerate(ANSWERS)]
    df = A.parse_answers(spark.createDataFrame(rows, "i int, content string"))
    got = {r.i: (r.ed_pred, r.se_pred, r.ec_pred) for r in df.collect()}
    assert got == {i: a[1:] for i, a in enumerate(ANSWERS)}


def test_long_answer_is_cut_in_the_middle(spark):
    rows = [(n, "5: " + "a" * (n - 4) + "z") for n in (5000, 5001)]
    df = spark.createDataFrame(rows, "n int, content string")
    got = {r.n: r.ec_pred for r in A.parse_answers(df, most_chars=5000).collect()}
    assert got[5000] == "a" * 4996 + "z"
    assert got[5001] == "a" * 2487
    assert A.parse_answers(df).where("n = 5001").first().ec_pred == "a" * 4997 + "z"


def test_listed_numbers_may_be_limited(spark):
    df = spark.createDataFrame([("x - 51: abc",)], "content string")
    assert A.parse_answers(df, most_listed=50).first().se_pred == -1


def one(spark, value, kind, build):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, clean",
    [('""a""', "a"), ('"""', '"'), (' "x" ', "x"), ('a"b"', 'a"b'), (None, ""), ("　t\x1c", "t")],
)
def test_clean_quotes(spark, raw, clean):
    assert one(spark, raw, "string", T.clean_quotes) == clean


@pytest.mark.parametrize(
    "pred, ref, na, score",
    [
        ("", "", True, 1.0),
        ("NA", "CORRECT", True, 1.0),
        ("PARSE_FAILED", "text", True, 0.0),
        ("PARSE_FAILED", "", True, 0.0),
        ("text", "", True, 0.0),
        ("it is correct now", "text", True, 0.0),
        ("INCORRECT", "text", False, 0.0),
    ],
)
def test_na_case(spark, pred, ref, na, score):
    df = spark.createDataFrame([(pred, ref)], "p string, r string")
    got = df.select(T.na_case(F.col("p"), F.col("r")).alias("x")).first().x
    assert (got.is_na, got.score) == (na, score)


def test_small_text_functions(spark):
    assert one(spark, "q1", "string", T.base_id) == "q1"
    assert one(spark, "q1_a", "string", T.base_id) == "q1_a"
    assert one(spark, "q1_a_m", "string", T.base_id) == "q1_a"
    assert one(spark, "これは日本語", "string", T.detect_language) == "ja"
    assert one(spark, "plain text", "string", T.detect_language) == "en"
    assert one(spark, "12345 a", "string", T.detect_language) == "unknown"
    assert one(spark, " \n", "string", T.detect_language) == "unknown"
    assert one(spark, "no error", "string", T.yes_no) == 1
    assert one(spark, 998, "bigint", T.interaction_index) == "999"
    assert one(spark, 1000, "bigint", T.interaction_index) == "1001"
    assert one(spark, "0_shot_prior_50_ja_lark", "string", T.template_prior) == 50
    assert one(spark, "0_shot_prior_50_ja_lark", "string", T.base_template) == "0_shot_prior_ja"


def _plain_rouge(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new

    def f(hits, n, m):
        return 2 * hits / (n + m) if hits else 0.0

    out = []
    for k in (1, 2):
        p, r = (Counter(zip(*[t[i:] for i in range(k)])) for t in (a, b))
        out.append(f((p & r).total(), p.total(), r.total()))
    return [*out, f(row[-1], len(a), len(b))]


@pytest.mark.parametrize("dense", [-1, 50, 10**9])
def test_rouge_of_a_batch_equals_the_plain_recurrence(monkeypatch, dense):
    """Rows of all lengths side by side, from match points and from bit vectors."""
    monkeypatch.setattr(G, "DENSE", dense)
    monkeypatch.setattr(G, "MASK_BYTES", 20)
    rng = random.Random(1)
    rows = [
        [[rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 90))] for _ in "ab"] for _ in range(150)
    ]
    rows += [[None, ["a"]], [["a"], None], [[], []], [["a", None, "a"], [None, "a"]]]
    sides = [pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)]
    for (a, b), got in zip(rows, G.score_arrays(*sides).to_pylist()):
        want = [None] * 3 if a is None or b is None else _plain_rouge(a, b)
        assert list(got.values()) == pytest.approx(want)
    parts = [pa.chunked_array([x]).slice(3, 40).combine_chunks() for x in sides]
    assert G.score_arrays(*parts).to_pylist() == G.score_arrays(*sides).to_pylist()[3:43]
    assert G.score_arrays(*[x.slice(0, 0) for x in sides]).to_pylist() == []


@pytest.mark.parametrize("kinds", [100, 50_000])
def test_rouge_of_very_long_texts(kinds):
    a = np.random.default_rng(0).zipf(1.3, 200_000) % kinds
    b = np.where(np.arange(len(a)) % 7 == 0, kinds + 1, a)
    sides = [pa.array([[str(x) for x in t]]) for t in (a, b)]
    (got,) = G.score_arrays(*sides).to_pylist()
    assert got["rouge_l_f"] == pytest.approx(1 - (len(a) + 6) // 7 / len(a))


def test_synthesis_tokens_equal_a_scan_per_form(spark):
    """All heading forms decided on one pass of tokens, as each form would find them in the whole text."""
    rng = random.Random(3)

    def text():
        out = []
        for _ in range(rng.randint(0, 7)):
            out += [rng.choice(["###", "####", "##", "#####", "#", "### ", "####\n", "######"]), "選択肢"]
            out += [rng.choice(["", " ", "　"]), rng.choice("abcdeAB"), rng.choice(["", " "])]
            out.append(rng.choice(["", "", "（正答）", "(正答)", "(x", "（a#b）", "（x)y）", "（p） q）", "(#)", "（）"]))
            out.append(rng.choice(["から合成した", "から合成した ", "から合成", ""]))
            out.append(rng.choice(["Correct record", "Error record", "正しい記録", "エラー記録", "correct RECORD", ""]))
            out.append(rng.choice(["", "", "（z）", "(z#)", "（q"]))
            out.append(rng.choice(["\n1. one\n2. two\n", "\nエラータイプ: t\n", "\n", "x # y\n1. k", ""]))
        return "".join(out)

    rows = spark.createDataFrame([(i, text()) for i in range(1500)] + [(-1, ""), (-2, None)], "id long, content string")
    scanned = S._form_by_form(F.coalesce("content", F.lit("")))
    # No choice is looked for one by one where any record was found.
    got = S.with_sections(rows, "content", 1).select("id", "_sections", scanned.alias("scanned")).collect()
    told = lambda found: [(x.choice, x.body, x.whole.lstrip("#").split("\n")[0]) for x in found if not x.loose]
    assert sum(bool(r.scanned) for r in got) > 500
    assert [r.id for r in got if told(r._sections) != told(r.scanned)] == []


def test_cleaning_equals_sentence_by_sentence_removal(spark):
    rng = random.Random(2)
    words = ["told that", "fine", "We Must", "ignore", "reference", "x\ny", ".", ". ", "\n", "", "error example", "ok"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = [re.escape(p) for p in K.PHRASES_EN] + [".*".join(map(re.escape, s)) for s in K.SEQUENCES_EN]
    bad = re.compile("|".join(rows), re.IGNORECASE)

    def model(text):
        gone = [m for m in re.finditer(r"[^.]*\.", text) if bad.search(m.group())]
        kept, end = "", 0
        for m in gone:
            kept, end = kept + text[end : m.start()], m.end()
        return kept + text[end:], len(gone)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", R.clean_reasoning_en(F.col("t")).alias("x")).collect()
    assert {r.i: (r.x.text, r.x.removed) for r in got} == {i: model(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "raw, content, why",
    [
        ("<think>a</think>b", "b", "a"),
        ("a</think>b</think> c", "c", "a</think>b"),
        ("x <think>a</think>b</think> y", "x y", "a</think>b"),
        ("</think> a <think>", "</think> a <think>", ""),
        ("plain ", "plain ", ""),
    ],
)
def test_split_reasoning(spark, raw, content, why):
    got = one(spark, raw, "string", R.split_reasoning)
    assert (got.content, got.reasoning) == (content, why)


EN = '"multiple_errors": 0, "numerical_error": 0, "unrealistic_scenario": 0, "inconsistent_context": 0, "explanation": "n"}'


@pytest.mark.parametrize(
    "output, total, language",
    [
        ('{"ambiguous_error": 2.9, ' + EN, 2, "en"),
        ('{"ambiguous_error": "3.7", ' + EN, 3, "en"),
        ('{"ambiguous_error": true, ' + EN, 1, "en"),
        ('{"ambiguous_error": "true", ' + EN, 0, "en"),
        ('{"ambiguous_error": null, ' + EN, 0, "en"),
        ('{"ambiguous_error": NaN, ' + EN, 0, "en"),
        ('{"ambiguous_error": 1e999, ' + EN, -1, "unknown"),
        ('{"ambiguous_error": 1, "ambiguous_error": 5, ' + EN, 5, "en"),
        ("{'ambiguous_error': 1}", -1, "unknown"),
        ('{"ambiguous_error": {"a": 1}, ' + EN, -1, "unknown"),
        ('{"ambiguous_error": 1, "extra_elements": 0, ' + EN, -1, "unknown"),
        ("none", -1, "unknown"),
    ],
)
def test_judgment(spark, output, total, language):
    df = V.parse_judgments(spark.createDataFrame([(output,)], "output string"))
    got = df.first().judgment
    assert (got.total_issues, got.detected_language) == (total, language)
    assert got.parse_error == (total == -1) and got.is_valid == (total == 0)


def records(spark, text):
    df = S.parse_synthesis(spark.createDataFrame([(text,)], "content string"))
    return {r.choice: (r.record_type, list(r.sentences)) for r in df.collect()}


def test_synthesis_forms(spark):
    four = "".join(f"#### 選択肢{x}(正答)から合成したCorrect record\n1. s {x}\nmore\n2. t\n" for x in "abcd")
    assert records(spark, four)["c"] == ("correct", ["s c\nmore", "t"])
    named = "".join(f"### 選択肢{x}から合成した{k}\n1. s\n" for x, k in zip("abcd", ["正しい記録", "エラー記録"] * 2))
    assert [records(spark, named)[x][0] for x in "abcd"] == ["correct", "error"] * 2
    bare = "### 選択肢a から合成した Correct record\nfirst\n\nsecond\n"
    assert records(spark, bare) == {"a": ("correct", ["first", "second"])}
    loose = "選択肢a からの記録\n1. one\n選択肢b からの記録\n1. two"
    assert records(spark, loose) == {"a": ("error", ["one"]), "b": ("error", ["two"])}
    assert records(spark, "nothing here") == {}


def test_render_is_one_pass(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    values = {"a": F.col("a"), "b": F.col("b")}
    text = df.select(prompts.render("{a} {{b}} {b}", values).alias("t")).first().t
    assert text == "{b} {b} x"
    with pytest.raises(KeyError):
        prompts.render("{c}", values)


def test_redact_keys_at_every_depth(spark):
    raw = '{"a": {"key": 1, "b": [{"key": 2, "c": 3}]}, "key": 4}'
    assert one(spark, raw, "string", lambda c: R.redact_keys(c, ["key"])) == '{"a": {"b": [{"c": 3}]}}'
