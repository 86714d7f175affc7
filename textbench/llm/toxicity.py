"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; unlabelled text, which holds toxic
documents at the class prior, stands in for the rest. The risk of calling
unlabelled text toxic is corrected by the prior times the same risk on
positives and never let below zero (non-negative estimator), so that the model
does not learn that the unlabelled toxic ones are harmless.

The model is linear over the presence and the density of words and word starts
(4 and 6 bytes) in a text, so that a long text is not called toxic for one
chance word. It is trained with numpy on the driver on bounded samples; features that
set positives apart from unlabelled text are chosen first. Scoring reads whole
texts, vectorised per Arrow batch, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.quality import held_out, labelled_sample
from textbench.llm.wordbytes import byte_chunks, mix, words

#: Positives and unlabelled documents used for fitting, at most each; chosen by a hash of the id.
POSITIVES = 4000
UNLABELLED = 8000
#: Features kept: those that most favour positives.
FEATURES = 192
LEAST_DOCUMENTS = 5
#: A word is dense in a text when it occurs twice or more and once in so many words.
DENSE = 128
THRESHOLD = 0.3
STARTS = (4, 6)


def _codes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code) of every word and word start of a chunk of lower-case texts, and words per text.

    Codes are even; the next odd number stands for the same word being dense.
    """
    found = words(data, places)
    parts = [found.hash()]
    owner = [found.doc]
    length = found.end - found.start
    for k, size in enumerate(STARTS):
        longer = length > size
        parts.append(mix(found.hash(size)[longer] + np.uint64(k + 1)))
        owner.append(found.doc[longer])
    many = np.bincount(found.doc, minlength=found.texts)
    return np.concatenate(owner), np.concatenate(parts) & ~np.uint64(1), many


def _dense(count: np.ndarray, words_: np.ndarray | int) -> np.ndarray:
    return (count >= 2) & (count * DENSE >= words_)


def feature_sets(texts: pa.Array) -> list[np.ndarray]:
    """Distinct features of each text, as 64-bit hashes."""
    out = []
    for _, data, places in byte_chunks(texts):
        owner, code, many = _codes(data, places)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(many) + 1))
        code = code[order]
        for a, b, size in zip(cuts[:-1], cuts[1:], many):
            own, count = np.unique(code[a:b], return_counts=True)
            out.append(np.sort(np.concatenate([own, own[_dense(count, size)] | np.uint64(1)])))
    return out


@dataclass
class PuModel:
    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        order = np.argsort(self.features)
        self.features, self.weights = self.features[order], self.weights[order]
        self._words = np.unique(self.features & ~np.uint64(1))
        self._screen = np.zeros(1 << 20, bool)
        self._screen[self._words >> np.uint64(44)] = True
        # Weight of a word's presence, and the more where it is dense.
        known = dict(zip(self.features.tolist(), self.weights))
        self._present = np.array([known.get(w, 0.0) for w in self._words.tolist()])
        self._more = np.array([known.get(w | 1, 0.0) for w in self._words.tolist()])

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of toxic per text; a text without known features has that of the intercept."""
        total = np.full(len(texts), self.intercept)
        many_words = len(self._words)
        for first, data, places in byte_chunks(texts):
            owner, code, many = _codes(data, places)
            maybe = self._screen[code >> np.uint64(44)]
            owner, code = owner[maybe], code[maybe]
            if not len(code):
                continue
            place = np.minimum(np.searchsorted(self._words, code), many_words - 1)
            true = self._words[place] == code
            both, count = np.unique(owner[true] * many_words + place[true], return_counts=True)
            owner, place = both // many_words, both % many_words
            value = self._present[place] + self._more[place] * _dense(count, many[owner])
            total[first : first + len(many)] += np.bincount(owner, value, len(many))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _choose(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features whose share among positives most exceeds that among unlabelled texts."""
    code, share = np.unique(np.concatenate(positive), return_counts=True)
    code, share = code[share >= LEAST_DOCUMENTS], share[share >= LEAST_DOCUMENTS]
    if not len(code):
        return code
    other = np.concatenate(unlabelled)
    place = np.minimum(np.searchsorted(code, other), len(code) - 1)
    rest = np.bincount(place[code[place] == other], minlength=len(code))
    p, u = share / len(positive), rest / max(len(unlabelled), 1)
    # How sure it is that the feature is commoner among positives.
    edge = (p - u) / np.sqrt(p * (1 - p) / len(positive) + (u * (1 - u) + 1e-6) / max(len(unlabelled), 1) + 1e-9)
    order = np.argsort(-edge, kind="stable")[:FEATURES]
    return np.sort(code[order[edge[order] > 0]])


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
    rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4,
) -> PuModel:
    """Fit by gradient steps (Adam) on the non-negative risk with the logistic loss.

    Without positives or unlabelled texts every score is the prior.
    """
    prior = float(np.clip(prior, 0.001, 0.999))
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return PuModel(np.zeros(0, np.uint64), np.zeros(0), start)
    chosen = _choose(positive, unlabelled)
    if not len(chosen):
        return PuModel(chosen, np.zeros(0), start)

    def sparse(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        code = np.concatenate(sets)
        place = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
        true = chosen[place] == code
        return rows[true], place[true], len(sets)

    p_rows, p_cols, p_n = sparse(positive)
    u_rows, u_cols, u_n = sparse(unlabelled)
    w, b = np.zeros(len(chosen)), start
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def forward(rows, cols, n):
        return b + np.bincount(rows, w[cols], n)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    for t in range(1, rounds + 1):
        f_p, f_u = forward(p_rows, p_cols, p_n), forward(u_rows, u_cols, u_n)
        # Losses of calling a text harmless (as positive) and toxic (as negative).
        negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        d_p_pos = -prior * sigmoid(-f_p) / p_n
        d_u, d_p_neg = sigmoid(f_u) / u_n, -prior * sigmoid(f_p) / p_n
        # Below zero the step goes back: it raises the negative risk instead of lowering it.
        sign = 1.0 if negative >= 0 else -1.0
        d_p = d_p_pos + sign * d_p_neg if sign > 0 else -d_p_neg
        d_u = sign * d_u
        g = np.bincount(p_cols, d_p[p_rows], len(w)) + np.bincount(u_cols, d_u[u_rows], len(w)) + ridge * w
        g = np.append(g, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return PuModel(chosen, w, float(b))


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
    prior: float | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> PuModel:
    """Fit to toxic labels whose id's crc32 leaves a remainder other than 2 by four.

    Only confirmed toxic labels are read as labels; the unlabelled sample is
    drawn from all documents, whatever their label, so that it holds toxic ones
    at the class prior. That prior is a parameter; by default it is the toxic
    share of the usable labels.
    """
    usable = ~held_out(F.col(id_col), 4, 2)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & usable)
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0] or 0.01
    toxic = known.groupBy(id_col).agg(F.min("toxic").alias("toxic")).where("toxic = 1")

    def collect(rows: DataFrame, known: np.ndarray | None = None) -> list[np.ndarray]:
        """Features per document, as bytes on the way; only `known` ones where given."""

        def run(texts: pa.Array) -> pa.Array:
            found = feature_sets(texts)
            if known is not None:
                found = [s[np.isin(s, known)] for s in found]
            return pa.array([s.tobytes() for s in found], pa.binary())

        got = rows.select("_id", F.arrow_udf(run, "binary")(F.lower("_text")).alias("s")).collect()
        got.sort(key=lambda r: r._id)
        return [np.frombuffer(bytes(r.s), np.uint64) for r in got]

    found = labelled_sample(docs, toxic, "toxic", F.lit(True), positives, id_col, text_col)
    positive = collect(found)
    if not positive:
        return train(positive, [], prior)
    # What fewer positives hold is never chosen, so it need not come from the unlabelled ones.
    code, share = np.unique(np.concatenate(positive), return_counts=True)
    others = docs.where(F.col(id_col).isNotNull()).select(id_col, F.lit(0).alias("other"))
    drawn = labelled_sample(docs, others, "other", F.lit(True), unlabelled, id_col, text_col)
    return train(positive, collect(drawn, code[share >= LEAST_DOCUMENTS]), prior)


def score(text: Column, model: PuModel) -> Column:
    """Probability that a text is toxic; empty and null texts are scored too."""
    return F.arrow_udf(lambda t: pa.array(model.score(t)), "double")(F.lower(text))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """(id, held_out, score, predicted) per row of `docs`, repeated rows included."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = docs.select(
        F.col(id_col),
        held_out(F.col(id_col), 4, 2).alias("held_out"),
        score(F.col(text_col), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
