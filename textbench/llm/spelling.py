"""Grouping spelling variants of the words of a corpus.

Method: finite-state composition. The minimised acceptor of the vocabulary is composed
with a transducer that makes exactly one edit and with the acceptor again; the
pairs that the composition accepts are the near words.

The composition is enumerated by initial states. Two words within one edit, the
shorter of m code points, share their first (m - 1) // 2 code points or as many at
their ends. So a word is dealt out under m = its length and its length less one, by its
beginning and, read backwards, by its end. A partition holds the acceptors of what
its words have left: those of m code points on one side, those of m and m + 1 on the
other. Before the edit both acceptors are in the states of one common beginning;
after it the composition is the intersection of two states' languages, which is kept by
pair of states; minimal states share it. Pairs of a common beginning come
from forward partitions only, so that each pair is found once.

A partition of many words is cut into pieces by hash, which compose piece by piece;
no partition goes to one task whole. All links are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.scratch import cut

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
SLIP = 97
PIECE = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINKS = "a string, b string, n_a long, n_b long"


# --- automata -------------------------------------------------------------


class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct words.

    `arcs[q]` maps a character to the next state; `final` holds accepting states.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: set[int] = set()
        self._register: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._settle(path, last, same)
            for c in word[same:]:
                self.arcs.append({})
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final.add(path[-1])
            last = word
        self._settle(path, last, 0)

    def _settle(self, path: list[int], word: str, depth: int) -> None:
        """Replace the states below `depth` of the last word by equal ones that are known."""
        while len(path) > depth + 1:
            q = path.pop()
            form = (q in self.final, *self.arcs[q].items())
            known = self._register.setdefault(form, q)
            if known != q:
                self.arcs[path[-1]][word[len(path) - 1]] = known
                self.final.discard(q)
                self.arcs[q] = {}


class Composition:
    """Accepted pairs of acceptor, one edit, acceptor.

    States after the edit are pairs of states; `_live` keeps for each whether both
    accept there and the arcs to states from which both can accept.
    """

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self._live: dict[tuple[int, int], tuple[bool, list[tuple[str, tuple[int, int]]]]] = {}

    def live(self, start: tuple[int, int]) -> tuple[bool, list[tuple[str, tuple[int, int]]]]:
        known = self._live
        if start in known:
            return known[start]
        arcs, other = self.left.arcs, self.right.arcs
        todo = [start]
        while todo:
            u, v = at = todo[-1]
            there = other[v]
            onward = [(c, (p, there[c])) for c, p in arcs[u].items() if c in there]
            ahead = [to for _, to in onward if to not in known]
            if ahead:
                todo += ahead
                continue
            todo.pop()
            both = u in self.left.final and v in self.right.final
            known[at] = both, [(c, to) for c, to in onward if known[to][0] or known[to][1]]
        return known[start]

    def endings(self, u: int, v: int, but: str = "") -> Iterator[str]:
        """What both accept from u on the left and v on the right, unless it begins with `but`."""
        both, arcs = self.live((u, v))
        if both:
            yield ""
        path, todo = [], [iter([arc for arc in arcs if arc[0] != but])]
        while todo:
            arc = next(todo[-1], None)
            if arc is None:
                todo.pop()
                if path:
                    path.pop()
                continue
            path.append(arc[0])
            both, arcs = self._live[arc[1]]
            if both:
                yield "".join(path)
            todo.append(iter(arcs))

    def pairs(self) -> Iterator[tuple[str, str]]:
        """(left, right): the right word has one character replaced or inserted."""
        todo = [("", 0, 0)]
        while todo:
            head, u, v = todo.pop()
            ours, theirs = self.left.arcs[u], self.right.arcs[v]
            for y, q in theirs.items():
                # An insertion is the last one of a run of its character, so it has one place.
                for rest in self.endings(u, q, y):
                    yield head + rest, head + y + rest
                for x, p in ours.items():
                    if x != y:
                        for rest in self.endings(p, q):
                            yield head + x + rest, head + y + rest
                    else:
                        todo.append((head + x, p, q))


def compose(words: list[str], others: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of a word and another with one character replaced or inserted."""
    return Composition(Acceptor(sorted(set(words))), Acceptor(sorted(set(others)))).pairs()


# --- vocabulary -----------------------------------------------------------


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def slipped(doc_id: Column, run: Column, every: int = SLIP) -> Column:
    """The run, with one code point deleted where `every` divides its crc32 in the document."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    rest = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, rest).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of whole texts and their occurrences, summed in each task first."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), lowered(F.col("run"))).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- links ----------------------------------------------------------------


def dealt(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """Words under the initial states of their partitions, and pairs of pieces.

    Columns: word, n, _m, _back, _key, _i, _j and _left, _right: whether the word
    stands on that side of the pair of pieces. Partitions with nothing on a side are gone.
    """
    length = F.length("word")
    side = F.explode(
        F.array(
            *[
                F.struct(m.alias("m"), F.lit(back).alias("back"))
                for m in (length, length - 1)
                for back in (False, True)
            ]
        )
    )
    shared = F.shiftright(F.col("_m") - 1, 1)
    rows = words.withColumn("_side", side).select("word", "n", F.col("_side.m").alias("_m"), F.col("_side.back").alias("_back"))
    key = F.when(F.col("_back"), F.substring(F.col("word"), -shared, shared)).otherwise(
        F.substring(F.col("word"), F.lit(1), shared)
    )
    rows = rows.withColumn("_key", key)
    by = ["_m", "_back", "_key"]
    short = F.count(F.when(F.length("word") == F.col("_m"), 1))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), short.alias("_short"))
    sizes = sizes.where("_all > 1 and _short > 0").select(*by, F.ceil(F.col("_all") / piece).cast("int").alias("_pieces"))
    mine = F.pmod(F.xxhash64("word"), F.col("_pieces")).cast("int")
    met = rows.join(sizes, by).withColumn("_mine", mine)
    each = F.sequence(F.lit(0), F.col("_pieces") - 1)
    # A word is on the left with every piece, if it is short, and on the right of every piece.
    left = F.transform(
        each, lambda j: F.struct(F.col("_mine").alias("i"), j.alias("j"), F.lit(True).alias("l"), (j == F.col("_mine")).alias("r"))
    )
    right = F.transform(
        F.filter(each, lambda i: (i != F.col("_mine")) | (F.length("word") > F.col("_m"))),
        lambda i: F.struct(i.alias("i"), F.col("_mine").alias("j"), F.lit(False).alias("l"), F.lit(True).alias("r")),
    )
    empty = F.array().cast("array<struct<i:int,j:int,l:boolean,r:boolean>>")
    places = F.concat(F.when(F.length("word") == F.col("_m"), left).otherwise(empty), right)
    return met.withColumn("_place", F.explode(places)).select(
        "word",
        "n",
        *by,
        F.col("_place.i").alias("_i"),
        F.col("_place.j").alias("_j"),
        F.col("_place.l").alias("_left"),
        F.col("_place.r").alias("_right"),
    )


def solve(m: int, back: bool, rows: list[tuple[str, int, bool, bool]]) -> Iterator[tuple[str, str]]:
    """Near pairs (a, b) of one partition: a has m code points, b has m or m + 1."""
    shared = (m - 1) // 2
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    words = [turn(w)[shared:] for w, _, left, _ in rows if left]
    others = [turn(w)[shared:] for w, _, _, right in rows if right]
    if not words or not others:
        return
    head = turn(rows[0][0])[:shared]
    for x, y in compose(words, others):
        a, b = turn(head + x), turn(head + y)
        # Both orders of a replacement are accepted; a common beginning is left to forward partitions.
        if (len(a) < len(b) or a < b) and not (back and a[:shared] == b[:shared]):
            yield a, b


_BY = ("_m", "_back", "_key", "_i", "_j")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the partitions of a stream that is sorted by them."""
    found: list[tuple] = []
    now, rows = None, []

    def close():
        if len(rows) > 1:
            counts = {r[0]: r[1] for r in rows}
            found.extend((a, b, counts[a], counts[b]) for a, b in solve(now[0], now[1], rows))

    def batch():
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "n_a", "n_b"])

    for part in batches:
        values = [part.column(c).to_pylist() for c in (*_BY, "word", "n", "_left", "_right")]
        for *key, word, n, left, right in zip(*values):
            if key != now:
                close()
                now, rows = key, []
            rows.append((word, n, left, right))
        if len(found) > 20_000:
            yield batch()
            found.clear()
    close()
    yield batch()


def links(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(a, b, n_a, n_b): pairs of near words, once each, of a table (word, n) of distinct words."""
    placed = dealt(words, piece)
    return placed.repartition(*_BY).sortWithinPartitions(*_BY).mapInArrow(_linked, _LINKS)


# --- groups ---------------------------------------------------------------


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) from (word, form) without cycles: each word with the last of its forms.

    Every round doubles the distance that is covered, so rounds are about the
    logarithm of the longest chain; each is written to the shared folder.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        onward = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        ahead = now.join(onward, F.col("root") == F.col("_at"), "left")
        if ahead.where("_at is not null").limit(1).count() == 0:
            return now
        now = cut(ahead.select("word", F.coalesce("_next", "root").alias("root")))
    raise RuntimeError("forms did not settle")


def variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = 2,
    piece: int = PIECE,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of the whole vocabulary of `docs` (doc_id, text).

    Null and empty texts have no words; in a row without id no run loses a code
    point. A row that is given twice counts twice. Words are compared by code points.
    """
    if least_length < 3:
        raise ValueError("words of fewer than three code points share no beginning or end")
    words = cut(vocabulary(docs, least_length, least_count))
    pairs = links(words, piece)
    both = pairs.withColumn(
        "_way",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
                F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
            )
        ),
    ).select("_way.*")
    # Largest count first, then the smallest word.
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"), F.max("n").alias("_n"))
    taken = -F.col("_best.less") >= factor * F.col("_n")
    near = cut(
        near.select(
            "word",
            "n_near",
            F.when(taken, F.col("_best.other")).alias("form"),
            F.when(taken, -F.col("_best.less")).alias("form_n"),
        )
    )
    last = roots(near.where("form is not null"))
    return (
        words.join(near, "word", "left")
        .join(last, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form",
            "form_n",
            F.coalesce("root", "word").alias("root"),
        )
    )
