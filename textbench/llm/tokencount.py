"""Counting the tokens of a unigram tokenizer without making them.

Method: an Aho-Corasick automaton enumerates the vocabulary's matches in a
word, and dynamic programming over their ends carries the best score and the
piece count of the best path. Ties follow the tokenizer's rule: paths are tried
by rising start of their last piece and a later one must score strictly more.
A character that no single-character piece covers is an unknown of the worst
score less a penalty; neighbouring unknowns are one token.

Words are tokenized on their own, each with the word mark in front, so each
distinct word is counted once per worker; the memory for known words is
bounded. There is no shuffle and texts never leave their row.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words a worker remembers before it starts afresh.
REMEMBERED = 500_000
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"


def read_vocabulary(path: str = f"{FOLDER}/{MODEL}") -> list[tuple[str, float]]:
    """Pieces with their stored scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(k), float(model.get_score(k)))
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))
    ]


class Counter(dict):
    """Token counts of words; a missing word is counted when it is asked for."""

    def __init__(self, vocabulary: Iterable[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        scores = dict(vocabulary)
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.single = {piece for piece in scores if len(piece) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = count = self.count(MARK + word)
        return count

    def count(self, text: str) -> int:
        """Tokens of one piece of text by the best path."""
        if not self.single.issuperset(text):
            return self._count_with_unknown(text)
        best, pieces, last = [0.0], [0], -1
        # Matches come by rising end and, at one end, longest first: by rising start.
        for end, (length, score) in self.automaton.iter(text):
            start = end + 1 - length
            total = best[start] + score
            if end != last:
                best.append(total)
                pieces.append(pieces[start] + 1)
                last = end
            elif total > best[-1]:
                best[-1], pieces[-1] = total, pieces[start] + 1
        return pieces[-1]

    def _count_with_unknown(self, text: str) -> int:
        size = len(text)
        best: list[float | None] = [0.0] + [None] * size
        pieces, unknown = [0] * (size + 1), [False] * (size + 1)
        matches: list[list] = [[] for _ in range(size)]
        if len(self.automaton):
            for end, match in self.automaton.iter(text):
                matches[end].append(match)
        for end in range(size):
            for length, score in matches[end]:
                start = end + 1 - length
                total = best[start] + score
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], pieces[end + 1], unknown[end + 1] = total, pieces[start] + 1, False
            if text[end] not in self.single:
                total = best[end] + self.unknown
                if best[end + 1] is None or total > best[end + 1]:
                    more = 0 if unknown[end] else 1
                    best[end + 1], pieces[end + 1], unknown[end + 1] = total, pieces[end] + more, True
        return pieces[size]


def token_count(text: Column, vocabulary: list[tuple[str, float]]) -> Column:
    """Tokens of a text: those of its words between white space; null and blank have none."""
    kept: list[Counter] = []

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Counter(vocabulary))
        known = kept[0].__getitem__
        return pa.array([sum(map(known, (t.as_py() or "").split())) for t in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)


def count_tokens(
    docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens) per row of `docs`; repeated rows stay, other columns are ignored.

    The vocabulary (piece, score) is a parameter of a tokenizer's size and is
    sent to every worker. An empty one makes each word one unknown token.
    """
    return docs.select(F.col(id_col), token_count(F.col(text_col), vocabulary).alias("n_tokens"))
