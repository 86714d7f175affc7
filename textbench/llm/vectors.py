"""Near duplicates among embeddings by a pivot-permutation index.

Method: a vector is described by the `DESCRIBED` reference points nearest to it,
in order. It is posted under the first `POSTED` of them; in an inverted pivot
list the reference points that two entries share are counted, pairs with at
least `SHARED` are kept and their cosine is computed in double precision.

Exact copies are one entry with a count. The number of reference points grows
with the square root of the entries of a length (up to `MOST_PIVOTS`), so lists stay short;
lengths of few vectors are one list without them. They are spread out, as points from inside one dense group would order its
members at random. A long list is compared in pairs of pieces. A pair that
meets in several lists is counted in the one of their smallest common posting.
Lists give counts per entry and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.blocks import paired_pieces, runs_of
from textbench.llm.graph import components
from textbench.llm.scratch import cut

COSINE = 0.98
DESCRIBED = 12
POSTED = 5
SHARED = 3
#: Reference points, at most: a bounded sample that every task holds.
MOST_PIVOTS = 4096
LEAST_PIVOTS = 32
#: Cosine above which two reference points would be too close to order anything.
CLOSEST_PIVOTS = 0.95
LIST = 1024
#: Vectors of one length that are compared without an index.
DIRECT = 256


def usable(vector: Column) -> Column:
    """Whether a vector is not null, finite in every component and not zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all vectors must be of one length."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = values.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def describe(vector: Column, pivots: dict[int, np.ndarray]) -> Column:
    """The nearest reference points of a vector in order; ties by their number.

    `pivots` holds unit rows per length of vector.
    """

    def run(vectors: pa.Array) -> pa.Array:
        length = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
        out: list = [None] * len(vectors)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            own = pivots.get(int(size))
            if own is None:
                # A length of few vectors is one list, whose entries are all compared.
                for row in at:
                    out[row] = np.zeros(1, np.int32)
                continue
            k = min(DESCRIBED, len(own))
            for part in np.array_split(at, max(1, len(at) * len(own) // 2_000_000)):
                near = -(_matrix(vectors.take(pa.array(part))) @ own.T)
                order = np.argpartition(near, k - 1, axis=1)[:, :k]
                rank = np.lexsort((order, np.take_along_axis(near, order, 1)), axis=1)
                for row, found in zip(part, np.take_along_axis(order, rank, 1)):
                    out[row] = found
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(vector)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that each row of `a` shares with each row of `b` (negative ones are none)."""
    values, place = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    place = place.reshape(-1)

    def marks(x, where):
        out = np.zeros((len(x), len(values)), np.float32)
        rows = np.repeat(np.arange(len(x)), x.shape[1])
        out[rows, where] = x.ravel() >= 0
        return out

    return marks(a, place[: a.size]) @ marks(b, place[a.size :]).T


def _links(pivot: int, x: np.ndarray, near: np.ndarray, mine: np.ndarray, cosine: float) -> np.ndarray:
    """Symmetric link matrix of one pair of pieces of the list of `pivot`."""
    linked = np.zeros((len(x), len(x)), bool)
    first = mine == mine.min()
    a = np.flatnonzero(first)
    b = a if first.all() else np.flatnonzero(~first)
    shared = _shared(near[a], near[b]) >= min(SHARED, near.shape[1])
    posted = near[:, :POSTED]
    # Met already in the list of a smaller posting that both have.
    shared &= _shared(np.where(posted[a] < pivot, posted[a], -1), np.where(posted[b] < pivot, posted[b], -1)) == 0
    shared &= x[a] @ x[b].T >= cosine
    linked[np.ix_(a, b)] = shared
    linked |= linked.T
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> np.ndarray:
    """A neighbour of each node in a spanning forest, or -1."""
    parent = np.full(len(linked), -1)
    open_ = np.ones(len(linked), bool)
    for seed in np.flatnonzero(linked.any(axis=1)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        for u in queue:
            near = np.flatnonzero(linked[u] & open_)
            open_[near] = False
            parent[near] = u
            queue.extend(near.tolist())
    return parent


def _solve(cosine: float):
    kind = pa.schema([("_id", pa.int64()), ("_links", pa.int64()), ("_to", pa.int64())])

    def solve(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ids, count = batch.column("_id").to_numpy(), batch.column("_count").to_numpy()
        pivot, mine = batch.column("_pivot").to_numpy(), batch.column("_mine").to_numpy()
        i, j = batch.column("_i").to_numpy(), batch.column("_j").to_numpy()
        out = []
        for a, b in zip(starts[:-1], starts[1:]):
            own = mine[a:b]
            # Of two pieces one may have no entry.
            if b - a < 2 or (i[a] != j[a] and own.min() == own.max()):
                continue
            run = slice(int(a), int(b))
            x = _matrix(batch.column("_vector").slice(a, b - a))
            near = batch.column("_near").slice(a, b - a)
            near = near.flatten().to_numpy().reshape(b - a, -1)
            linked = _links(int(pivot[a]), x, near, own, cosine)
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            linked = linked[np.ix_(some, some)]
            node, size = ids[run][some], count[run][some]
            parent = _forest(linked)
            to = pa.array(np.where(parent >= 0, node[parent], 0), mask=parent < 0)
            out.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array((linked * size[None, :]).sum(axis=1)), to], schema=kind
                )
            )
        table = pa.Table.from_batches(out, kind).combine_chunks().to_batches()
        return table[0] if table else pa.RecordBatch.from_pylist([], kind)

    return solve


def _spread_out(x: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first choice of up to `many` rows, from row 0 on, none too close to another."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < many:
        at = int(nearest.argmin())
        if nearest[at] > CLOSEST_PIVOTS:
            break
        chosen.append(at)
        np.maximum(nearest, x @ x[at], out=nearest)
    return x[chosen]


def fit_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Reference points per length of vector, for lengths of more than DIRECT vectors.

    Four candidates each are drawn from the vectors of a length by a hash, and of those the
    ones that lie farthest apart are taken. Lengths are the dimensions of a few models.
    """
    counts = {r._length: r.n for r in classes.groupBy(F.size("_vector").alias("_length")).agg(F.count("*").alias("n")).collect()}
    wanted = {
        length: min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(2 * math.sqrt(n))))
        for length, n in counts.items()
        if n > DIRECT
    }
    if not wanted:
        return {}
    order = Window.partitionBy("_length").orderBy(F.xxhash64("_vector"), "_id")
    drawn = classes.select("_id", "_vector", F.size("_vector").alias("_length")).withColumn("_rank", F.row_number().over(order))
    # A constant bound is applied in every task before rows of a length come together.
    drawn = drawn.where(F.col("_rank") <= 4 * max(wanted.values()))
    each = F.create_map(*[F.lit(x) for length, n in wanted.items() for x in (length, 4 * n)])
    rows = drawn.where(F.col("_rank") <= F.try_element_at(each, F.col("_length"))).orderBy("_length", "_rank").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(r._length, []).append(r._vector)
    return {
        n: _spread_out(_matrix(pa.array(v, pa.list_(pa.float64()))), wanted[n])
        for n, v in by_size.items()
    }


def near_duplicates(
    table: DataFrame, cosine: float = COSINE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Rows are compared only when their labels are equal and not null and their
    vectors are of one length. Vectors that are null, zero or hold null or
    non-finite components link with nothing, and so do rows with a null id
    (their component is null, they are kept). Repeated rows are vectors of
    their own, linked with each other. An empty table gives an empty result.
    """
    rows = table.select(
        F.col(id_col).alias("_row"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector")
    )
    fit = F.col("_row").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_vector"))
    # Two 64-bit hashes name a class of equal vectors of one label.
    rows = rows.withColumn("_fit", fit).withColumns(
        {
            "_h1": F.when(F.col("_fit"), F.xxhash64("_label", "_vector")),
            "_h2": F.when(F.col("_fit"), F.xxhash64(F.lit("second"), "_vector", "_label")),
        }
    )
    classes = cut(
        rows.where("_fit")
        .groupBy("_h1", "_h2")
        .agg(
            F.min("_row").alias("_id"),
            F.count(F.lit(1)).alias("_count"),
            F.first("_label").alias("_label"),
            F.first("_vector").alias("_vector"),
        )
    )
    described = classes.withColumn("_near", describe(F.col("_vector"), fit_pivots(classes)))
    postings = described.select(
        "_id", "_count", "_label", "_vector", "_near",
        F.size("_vector").alias("_length"),
        F.explode(F.slice("_near", 1, POSTED)).alias("_pivot"),
    )
    keys = ["_label", "_length", "_pivot"]
    lists = paired_pieces(postings, keys, F.xxhash64("_id"), LIST)
    solve = _solve(cosine)
    found = cut(
        lists.mapInArrow(
            lambda batches: runs_of(batches, [*keys, "_i", "_j"], solve), "_id long, _links long, _to long"
        )
    )
    links = found.groupBy("_id").agg(F.sum("_links").alias("_links"))
    joined = components(found.where("_to is not null"), "_id", "_to")
    known = (
        classes.select("_h1", "_h2", "_id", "_count")
        .join(links, "_id", "left")
        .join(joined, F.col("_id") == F.col("node"), "left")
        .select(
            "_h1",
            "_h2",
            (F.col("_count") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "_id").alias("component_id"),
        )
    )
    # Rows without a usable vector have null hashes and find no class.
    return rows.join(known, ["_h1", "_h2"], "left").select(
        F.col("_row").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_row").alias("component_id"),
        F.coalesce(F.col("_row") == F.coalesce("component_id", "_row"), F.lit(True)).alias("kept"),
    )
