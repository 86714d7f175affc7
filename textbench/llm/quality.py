"""Text quality: a generalised additive model with pairwise interactions.

Features are figures of the whole text (characters, words, lines, repeats). The
model is fitted on the driver to a bounded sample of labelled documents
(`SAMPLE`); scoring adds up table entries, vectorised per Arrow batch, without
a shuffle of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.gam import Gam
from textbench.llm.wordbytes import NOT_SPACE, byte_chunks, mix, words

#: Labelled documents the model is fitted to, at most; chosen by a hash of the id.
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = """words mean_word upper digit space stop comma bang bar symbol distinct top_word
same_as_before distinct_triples symbol_ends lines distinct_lines longest_word""".split()

_LEAD, _LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _COMMA, _BANG, _BAR, _SYMBOL, _REST = range(12)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    table[97:123], table[65:91], table[48:58] = _LOWER, _UPPER, _DIGIT
    table[[32, 9, 11, 12, 13]] = _BLANK
    table[10], table[46], table[44], table[33], table[124] = _LINE, _STOP, _COMMA, _BANG, _BAR
    table[128:192], table[192:] = _REST, _LEAD
    return table


CLASSES = _classes()
NOT_LINE = np.ones(256, bool)
NOT_LINE[[10, 13]] = False


def _distinct(doc: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest one, per text."""
    keys = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    keys, count = np.unique(keys, return_counts=True)
    owner = (keys >> np.uint64(40)).astype(np.int64)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=texts), top


def features(texts: pa.Array) -> np.ndarray:
    """Figures (rows x FEATURES) of whole texts; of an empty or null text all are zero."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, data, places in byte_chunks(texts):
        n = len(places) - 1
        size = np.diff(places)
        owner = np.repeat(np.arange(n), size)
        kinds = np.bincount(owner * 12 + CLASSES[data], minlength=n * 12).reshape(n, 12)
        chars = kinds.sum(axis=1) - kinds[:, _REST]
        solid = np.maximum(chars - kinds[:, _BLANK] - kinds[:, _LINE], 1)
        letters = np.maximum(kinds[:, _LEAD] + kinds[:, _LOWER] + kinds[:, _UPPER], 1)
        found = words(data, places, NOT_SPACE)
        h, doc = found.hash(), found.doc
        many = np.bincount(doc, minlength=n)
        some = np.maximum(many, 1)
        distinct, top = _distinct(doc, h, n)
        same = doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
        inside = doc[2:] == doc[:-2]
        triple = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[inside]
        triples, _ = _distinct(doc[2:][inside], triple, n)
        last = CLASSES[data[found.end - 1]] if len(doc) else np.zeros(0, np.uint8)
        odd = (last == _SYMBOL) | (last == _BANG) | (last == _BAR)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc, found.end - found.start)
        line = words(data, places, NOT_LINE)
        lines = np.bincount(line.doc, minlength=n)
        other, _ = _distinct(line.doc, line.hash(), n)
        out[first : first + n] = np.stack(
            [
                np.log1p(many),
                solid / some,
                kinds[:, _UPPER] / letters,
                kinds[:, _DIGIT] / solid,
                kinds[:, _BLANK] / np.maximum(chars, 1),
                kinds[:, _STOP] / some,
                kinds[:, _COMMA] / some,
                kinds[:, _BANG] / some,
                kinds[:, _BAR] / some,
                kinds[:, _SYMBOL] / solid,
                distinct / some,
                top / some,
                np.bincount(same, minlength=n) / some,
                triples / np.maximum(many - 2, 1),
                np.bincount(doc[odd], minlength=n) / some,
                lines / some,
                other / np.maximum(lines, 1),
                np.log1p(longest),
            ],
            axis=1,
        ) * (many > 0)[:, None]
    return out


def held_out(id_: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(text, label) of at most `sample` labelled documents, the same ones in every run.

    Labels other than 0 and 1 and null ids are ignored; of contradicting labels
    of one id the smaller holds; of rows that repeat an id one text is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & usable)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` rows of two numbers: small by construction.
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), "_id"
    )
    return found.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fit to labels whose id's crc32 leaves a remainder other than 0 by five."""
    rows = labelled_sample(
        docs, labels, "quality", ~held_out(F.col(id_col), 5, 0), sample, id_col, text_col
    )
    figures = F.arrow_udf(lambda t: pa.array(list(features(t)), pa.list_(pa.float64())), "array<double>")
    got = rows.select("_id", figures("_text").alias("x"), "_label").collect()
    got.sort(key=lambda r: r._id)
    x = np.array([r.x for r in got], float).reshape(len(got), len(FEATURES))
    return Gam().fit(x, np.array([r._label for r in got], int))


def score(text: Column, model: Gam) -> Column:
    """Probability that a text is of good quality; empty and null texts are scored too."""
    return F.arrow_udf(lambda t: pa.array(model.score(features(t))), "double")(text)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, held_out, score, predicted) per row of `docs`, repeated rows included.

    Without usable labels every score is one half. Other columns are ignored.
    """
    model = fit(docs, labels, sample, id_col, text_col)
    scored = docs.select(
        F.col(id_col),
        held_out(F.col(id_col), 5, 0).alias("held_out"),
        score(F.col(text_col), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`docs` without the rows that the model rejects."""
    model = fit(docs, labels, sample, id_col, text_col)
    return docs.where(score(F.col(text_col), model) >= threshold)
