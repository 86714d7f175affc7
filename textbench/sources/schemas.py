"""Schemas of the JSON rows, as DDL."""

from __future__ import annotations

ITEM_KEYS = [
    "sample_id",
    "sentences",
    "error_flag",
    "error_type",
    "error_sentence_id",
    "error_sentence",
    "corrected_sentence",
]
_ITEM_FIELDS = """sample_id string, sentences string, error_flag int, error_type string,
    error_sentence_id int, error_sentence string, corrected_sentence string,
    corrected_text string"""
# Open metadata stays JSON text.
ITEM = f"{_ITEM_FIELDS}, metadata string"

QUESTION = "id string, question string, choices map<string,string>, answer array<string>"

INTERACTION = """interaction_index string, sample_id string,
    sample_data struct<sample_id: string>,
    messages array<struct<role: string, content: string>>,
    raw_response struct<content: string, reasoning: string, error: string, raw_response: string>,
    response_metadata struct<model: string, template: string, timestamp: string>"""

PREDICTED_SAMPLE = f"""{_ITEM_FIELDS}, predictions struct<
    error_detection: int, errordetection: int,
    sentence_extraction: bigint, sentenceextraction: bigint,
    error_correction: string, errorcorrection: string>"""

EXPERIMENT = ["task", "dataset", "model", "template", "run_ts"]

RESPONSE_ROW = """task string, dataset string, model string, template string, run_ts string,
    ord bigint, sample_id string, error_flag int, error_sentence_id int,
    corrected_sentence string, content string"""
