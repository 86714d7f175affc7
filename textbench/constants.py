"""Fixed values that decide results: sentinels, names, limits and word lists."""

from __future__ import annotations

# Marks kept instead of null when an answer cannot be read.
PARSE_FAILED = "PARSE_FAILED"
NO_ANSWER = -1

# Ids and texts.
QUESTION_ID_PREFIX = "jmle-"
CHOICES = ["a", "b", "c", "d", "e"]
RECORDS_PER_QUESTION = 5
NUMERIC_CHOICES = {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}
UNKNOWN_CHOICE = "情報なし"
REDACTED_NOTE = "[Thinking content was present but redacted for safety]"
NO_ERROR_TYPE = "No Error"
THINK_START, THINK_END = "<think>", "</think>"

# Limits of the published scoring, all of them options: characters of an answer
# that are read, the mark put in the cut, and the highest number of a listed sentence.
MAX_CORRECTION_CHARS = 5000
TRUNCATION_MARK = "\n...[TRUNCATED]...\n"
MAX_LISTED_SENTENCE = 50

# Criteria of the two judge languages.
CRITERIA_JA = [
    "ambiguous_error",
    "extra_elements",
    "multiple_errors",
    "numerical_error",
    "synthesis_consistency_error",
]
CRITERIA_EN = [
    "ambiguous_error",
    "multiple_errors",
    "numerical_error",
    "unrealistic_scenario",
    "inconsistent_context",
]
CRITERIA = CRITERIA_JA + ["unrealistic_scenario", "inconsistent_context"]

# Error types and confidence levels a classifier may answer.
ERROR_TYPES = [
    "history_taking",
    "physical_findings",
    "test_interpretation",
    "diagnosis",
    "medication_selection",
    "medication_dosage",
    "procedure_intervention",
    "monitoring_management",
    "none",
]
CONFIDENCE_LEVELS = ["high", "medium", "low"]

# Labels of the accuracy bins and of the difference bins, in order.
ACCURACY_BINS = [
    "0.0 (no models correct)",
    "0.0-0.25",
    "0.25-0.5",
    "0.5-0.75",
    "0.75-1.0",
    "1.0 (all models correct)",
]
DIFFERENCE_BINS = [
    "Negative (Complete > Detection)",
    "0-10%",
    "10-20%",
    "20-30%",
    "30-40%",
    "40%+ (may be filtered based on error type)",
]

# Metric names in order of preference and the endings of mere counts.
METRIC_PRIORITY = {
    "error_detection": [
        "error_detection_f1",
        "error_detection_precision",
        "error_detection_recall",
        "error_detection_accuracy",
    ],
    "sentence_extraction": [
        "sentence_extraction_error_accuracy",
        "sentence_extraction_accuracy",
    ],
    "error_correction": [
        "error_correction_average_score",
        "error_correction_composite_avg",
        "error_correction_rouge_1_f",
        "error_correction_bleurt",
        "error_correction_bertscore_f1",
    ],
}
PRIMARY_METRICS = [m for names in METRIC_PRIORITY.values() for m in names]
COUNT_SUFFIXES = {
    "error_detection": ["_tp", "_fp", "_tn", "_fn"],
    "sentence_extraction": ["_samples", "_matches"],
    "error_correction": ["_pairs", "_samples"],
}
JUDGE_PRIMARY_METRICS = [
    "screening_metrics_overall_valid_rate",
    "screening_metrics_parse_error_rate",
    "screening_metrics_avg_issues_per_sample",
]

# Words that mark a yes or a no in a free answer (yes is looked for first).
YES_WORDS = ["yes", "はい", "あり", "エラー", "error", "1"]
NO_WORDS = ["no", "いいえ", "なし", "エラーなし", "no error", "0"]

# English phrases whose sentences are removed from reasoning.
PHRASES_EN = [
    "told that",
    "are told",
    "we are told",
    "being told",
    "pre-verified",
    "pre-determined",
    "pre-confirmed",
    "text claims",
    "external instructions",
    "prior knowledge",
    "prior informationreference information",
    "reference correction",
    "reference says",
    "sample correction",
    "provided correction",
    "given correction",
    "instruction states",
    "problem states",
    "task states",
    "instructions say",
    "problem says",
    "task says",
    "do not mention",
    "not supposed to",
    "should not mention",
    "ignore the reference",
    "independently",
    "from scratch",
    "this time, you are",
    "error example",
    "no-error example",
    "expected outcome",
    "instruction content",
    "which we are not supposed",
    "but it's the sample correction",
    "the reference solution",
    "meta-references",
    "meta-reference",
    'reviewing an "error example"',
    'reviewing a "no-error example"',
    "expected result",
    "known outcome",
    "follow the medical reasoning independently",
    "purely medical evaluation",
    "reaching your conclusion through pure medical evaluation",
    "as if you are analyzing it from scratch",
    "do NOT make any reference",
]
# The same list with the run-together phrase as the two phrases it may stand for; an option.
RUN_TOGETHER_EN = {"prior informationreference information": ["prior information", "reference information"]}
PHRASES_EN_SPLIT = [q for p in PHRASES_EN for q in RUN_TOGETHER_EN.get(p, [p])]
# English phrase sequences, all on one line.
SEQUENCES_EN = [
    ["This time", "reviewing", "error", "example"],
    ["do not mention", "reasoning"],
    ["reference", "not supposed"],
    ["approach", "as if", "analyzing", "scratch"],
    ["pure medical evaluation"],
    ["independently", "reference"],
    ["medical reasoning", "independently"],
    ["we must", "ignore", "reference"],
    ["problem", "states", "do not"],
    ["instruction", "do not", "reference"],
]
# Japanese phrases.
PHRASES_JA = [
    "エラーなし例",
    "エラーなしの例",
    "エラーなし問題",
    "エラーあり例",
    "エラーありの例",
    "エラーあり問題",
    "事前に",
    "事前確認",
    "事前情報",
    "事前に知",
    "事前に分",
    "事前に言",
    "事前に確認",
    "reasoning",
    "Reasoning",
    "REASONING",
    "指示通り",
    "指示に従",
    "指示では",
    "指示された",
    "ゼロから分析",
    "ゼロから検討",
    "ゼロから考",
    "確認されている",
    "分かっている",
    "言われている",
    "設定されている",
    "問題設定",
    "タスク設定",
    "課題設定",
    "メタ的",
    "メタ情報",
    "メタレベル",
    "実際には",
    "実際は",
    "前提として",
    "前提条件",
    "参考までに",
    "念のため",
    "言及はせず",
    "言及しない",
    "言及しません",
    "純粋に医学的",
    "医学的観点のみ",
    "医学的に純粋",
]
# Japanese phrase sequences, all on one line.
SEQUENCES_JA = [
    ["今回は", "エラー", "例"],
    ["その言及はせず"],
    ["reasoning", "言及"],
    ["事前", "確認", "問題なさそう"],
    ["既に", "分かっている"],
    ["設定上"],
    ["課題として"],
]

# Wording of the reasons for which the difficulty filter rejects an item.
REASON_MODELS = "Complete accuracy: %d/{total} models correct (allowed range for %s: %d-%d)"
REASON_DIFFERENCE = "Accuracy difference: %s (>= %s threshold for %s)"
REASON_INCONSISTENT = "Data cleaning: inconsistent data (error_flag=1 but error_sentence_id=None/nan)"
