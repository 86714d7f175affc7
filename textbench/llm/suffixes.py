"""Removing byte strings that occur more than once in a corpus.

Method: depth-limited radix sort of suffixes. Suffixes are told apart by most-significant-digit
passes through `depth` bytes and no further. A suffix that is alone in its group
leaves; the groups that are equal after the last pass are exactly the repeated
windows of `depth` bytes.

The first pass runs over all of Spark, and its digit stands for many suffixes at
once: the least hashed gram within the window (leftmost of equal ones). Equal windows
have the same gram at the same place. Successive suffixes mostly share their
gram's place, so a text becomes stretches of suffixes (about one in 65 bytes at depth 200),
and a shuffle carries stretches. Where a gram occurs once in the corpus its
whole stretch leaves. Where a gram's stretches are all equal, all their windows are
repeated. Only the other stretches are sorted on: their distinct bytes are dealt by
gram, and passes over eight bytes at a time split the groups until they are single
or the depth is reached.

A gram of more than `most` stretches is not sorted in one task: digests of
its windows are counted by Spark instead (with sums in each task first), which gives the same
result. Nothing is capped, and texts are cut anywhere without effect on the result.

Texts are told apart by MD5 and stretches of one gram by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm import wordbytes
from textbench.llm.scratch import discard, stored

DEPTH = 200
MOST = 16_384
PIECE_BYTES = 1 << 20
PART = 1 << 15
SALTS = 32
#: Stretches whose windows are sorted together, or those of one gram.
SORTED_AT_ONCE = 2048
_LOW = np.uint64(0xFFFFFFFF)


def gram_of(depth: int) -> int:
    """Length of grams: longer ones rarely repeat by chance, shorter ones make fewer stretches."""
    return depth * 3 // 8


# --- first pass: stretches of suffixes with one gram ----------------------


def stretches(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(first, last, at, gram): runs of windows with one least gram, `at` its place.

    `data` holds texts whose bounds are `places`; windows stay inside a text.
    """
    gram, n = gram_of(depth), len(data)
    wide = depth - gram + 1
    starts, ends = places[:-1], places[1:] - depth
    long = ends >= starts
    if not long.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    starts, ends = starts[long], ends[long]
    up, down = wordbytes._powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(up[:n] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        grams = wordbytes.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: size - wide], least[wide - size :])
    at = (least & _LOW).astype(np.int64)
    steps = np.zeros(len(at) + 1, np.int8)
    steps[starts] += 1
    steps[ends + 1] -= 1
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[starts] = True
    new &= np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    last = np.minimum(last, ends[np.searchsorted(starts, first, "right") - 1])
    return first, last, at[first], grams[at[first]].view(np.int64)


def packed(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (first << 32) | ((last - first) << 16) | (at - first)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 32
    return first, first + ((place >> 16) & 0xFFFF), first + (place & 0xFFFF)


def _whole(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """Keys of a batch, and for each row the number of rows that it stands for (0: an earlier one does)."""
    keys = batch.column("key").to_pylist()
    copies, seen = np.zeros(len(keys), np.int64), {}
    for i, key in enumerate(keys):
        copies[seen.setdefault(key, i)] += 1
    return keys, copies


def _described(depth: int):
    """Texts to rows of at most PART stretches; copies within a batch are one row."""
    names = ["uid", "key", "part", "copies", "gram", "hash", "place"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * 3

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies = _whole(batch)
            uids = batch.column("uid").to_numpy()
            chosen = np.flatnonzero(copies)
            texts = batch.column("text").take(pa.array(chosen))
            for top, data, places in wordbytes.byte_chunks(texts, PIECE_BYTES):
                rows: list[list] = [[] for _ in names]
                step = max(PIECE_BYTES, 1)
                found: dict[int, list[tuple]] = {}
                # A single long text is taken in pieces; a window belongs to the piece it starts in.
                whole = len(data) <= 2 * PIECE_BYTES
                for a in [0] if whole else range(0, len(data), step):
                    part = data if whole else data[a : a + step + depth - 1]
                    bounds = places if whole else np.array([0, len(part)])
                    first, last, at, gram = stretches(part, bounds, depth)
                    buffer = memoryview(np.ascontiguousarray(part))
                    ends = last + depth
                    digest = np.array(
                        [xxhash.xxh3_64_intdigest(buffer[x:y]) for x, y in zip(first.tolist(), ends.tolist())], np.uint64
                    ).view(np.int64)
                    text = np.searchsorted(bounds, first, "right") - 1
                    edges = np.searchsorted(text, np.arange(len(bounds)))
                    for t in np.unique(text).tolist():
                        o = slice(edges[t], edges[t + 1])
                        begin = bounds[t] - a
                        found.setdefault(t, []).append(
                            (gram[o], digest[o], packed(first[o] - begin, last[o] - begin, at[o] - begin))
                        )
                for t, parts in found.items():
                    row = int(chosen[top + t])
                    gram, digest, place = (np.concatenate(x) for x in zip(*parts))
                    for k in range(0, len(place), PART):
                        values = (
                            int(uids[row]) * 65536 + k // PART,
                            keys[row],
                            k // PART,
                            int(copies[row]),
                            gram[k : k + PART],
                            digest[k : k + PART],
                            place[k : k + PART],
                        )
                        for column, value in zip(rows, values):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return describe


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): texts with their MD5, nulls as empty ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), "doc_id", text.alias("text"))


def repeated_grams(docs: DataFrame, depth: int = DEPTH, most: int = MOST) -> tuple[DataFrame, int]:
    """(key, gram, hash, place, kind) of stretches whose gram occurs again, and the largest kind.

    Kind 0: all windows are repeated; 1: the rest has to be sorted; 2: the gram has too many
    stretches for one task. Each different text comes once.
    """
    texts = keyed(docs).select(F.monotonically_increasing_id().alias("uid"), "key", "text")
    schema = "uid long, key binary, part int, copies long, gram array<long>, hash array<long>, place array<long>"
    told, path = stored(texts.mapInArrow(_described(depth), schema), "stretches")
    each = told.select("uid", "copies", F.explode(F.arrays_zip("gram", "hash", "place")).alias("s"))
    twice = each.groupBy(F.col("s.gram").alias("gram")).agg(F.sum("copies").alias("n")).where("n > 1").select("gram")
    # As tables of their own, small sides leave Spark free to split a join at a very common gram.
    twice, twice_path = stored(twice, "twice")
    one = told.groupBy("key", "part").agg(F.min("uid").alias("uid")).select("key", "uid")
    hits = each.select("uid", "s.gram", "s.hash", "s.place").join(twice, "gram").join(one, "uid").drop("uid")
    hits, hit_path = stored(hits, "repeated")
    kinds = hits.groupBy("gram").agg(
        F.when(F.min("hash") == F.max("hash"), 0).when(F.count(F.lit(1)) <= most, 1).otherwise(2).alias("kind")
    )
    kinds, kind_path = stored(kinds, "kind")
    out, _ = stored(hits.join(kinds, "gram").select("key", "gram", "hash", "place", "kind"), "kinds")
    for done in (path, twice_path, hit_path, kind_path):
        discard(docs.sparkSession, done)
    return out, out.agg(F.max("kind")).first()[0] or 0


# --- further passes -------------------------------------------------------


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, times: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes occur again within their group, by their first `depth` bytes.

    `times` says how often each occurs. Every pass sorts what is left by the next eight
    bytes, the last one by the last eight.
    """
    again = times > 1
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    left = np.arange(len(start))
    for digit in [*range(0, depth - 8, 8), depth - 8]:
        value = word[start[left] + digit]
        order = np.lexsort((value, group))
        left, group, value = left[order], group[order], value[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new) - 1
        shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        left, group = left[shared], group[shared]
    again[left] = True
    return again


def _runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked places inside `bounds`: first and last place, number of the bound."""
    mark = np.zeros(len(flags) + 1, np.int8)
    mark[:-1] = flags
    new = mark[:-1].astype(bool)
    before = np.append(False, flags[:-1])
    before[bounds[:-1][bounds[:-1] < len(flags)]] = False
    first = np.flatnonzero(new & ~before)
    stop = ~flags
    stop = np.append(stop, True)
    stop[bounds] = True
    stops = np.flatnonzero(stop)
    last = stops[np.searchsorted(stops, first, "right")] - 1
    return first, last, np.searchsorted(bounds, first, "right") - 1


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_PIECES = ["gram", "hash", "ahead", "times", "bytes"]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct stretches of a batch's texts with their bytes and number."""
    kinds = [pa.int64()] * 4 + [pa.binary()]
    for batch in batches:
        found: dict[tuple[int, int], list] = {}
        for text, row in zip(batch.column("text"), batch.column("todo")):
            data = text.as_buffer()
            data = memoryview(data) if data is not None else b""
            for s in row.as_py():
                known = found.get((s["gram"], s["hash"]))
                if known:
                    known[1] += 1
                else:
                    first, last, at = unpacked(s["place"])
                    found[s["gram"], s["hash"]] = [at - first, 1, bytes(data[first : last + s["depth"]])]
        columns = list(zip(*[(*k, *v) for k, v in found.items()])) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _PIECES)


def _sorted_out(depth: int):
    """Stretches of whole grams to runs of repeated windows: gram, hash, from, to (from the stretch's first byte)."""
    names = ["gram", "hash", "from", "to"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        data, offsets = _bytes_of(table["bytes"].combine_chunks())
        gram, digest = table["gram"].to_numpy(), table["hash"].to_numpy()
        ahead, times = table["ahead"].to_numpy(), table["times"].to_numpy()
        # Equal stretches of several tasks are next to each other.
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])
        one = np.flatnonzero(new)
        times = np.add.reduceat(times, one)
        count = offsets[one + 1] - offsets[one] - depth + 1
        bounds = np.append(0, np.cumsum(count))
        which = np.repeat(np.arange(len(one)), count)
        inside = np.arange(bounds[-1]) - bounds[which]
        _, number = np.unique(gram[one], return_inverse=True)
        group = number[which] * 65536 + (ahead[one][which] - inside)
        again = radix_groups(data, offsets[one][which] + inside, group, times[which], depth)
        first, last, of = _runs(again, bounds)
        begin = bounds[of]
        columns = gram[one][of], digest[one][of], first - begin, last - begin + depth
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*(left.to_batches() if left else ()), batch])
            gram = table["gram"].to_numpy()
            edges = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            # The last gram may go on in the next batch.
            at = 0
            while len(edges) and at < edges[-1]:
                k = int(np.searchsorted(edges, at + SORTED_AT_ONCE, "right")) - 1
                end = int(edges[k] if k >= 0 and edges[k] > at else edges[np.searchsorted(edges, at, "right")])
                yield solve(table.slice(at, end - at))
                at = end
            left = table.slice(at)
        if left:
            yield solve(left)

    return run


def _windows(depth: int):
    """Digest of every window of the stretches of hot grams: key, from, high, low."""
    names = ["key", "from", "high", "low"]
    kinds = [pa.binary()] + [pa.int64()] * 3

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, row in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("todo")):
                data = memoryview(text.as_buffer())
                for s in row.as_py():
                    first, last, _ = unpacked(s["place"])
                    for i in range(first, last + 1):
                        two = np.frombuffer(xxhash.xxh3_128_digest(data[i : i + depth]), np.int64)
                        rows.append((key, i, int(two[0]), int(two[1])))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return digests


def repeated(docs: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """key, doc_id, text and runs (array of from, to) of every row; runs may overlap, null for none."""
    if depth < 16 or depth >= 1 << 15:
        raise ValueError("depth is between 16 and 32767 bytes")
    hits, worst = repeated_grams(docs, depth, most)
    first = F.shiftright("place", 32)
    last = first + F.shiftright("place", 16).bitwiseAND(0xFFFF)
    runs = hits.where("kind = 0").select("key", first.alias("from"), (last + depth).alias("to"))
    texts = keyed(docs)

    def todo(kind):
        what = F.collect_list(F.struct("gram", "hash", "place", F.lit(depth).alias("depth")))
        return texts.join(hits.where(F.col("kind") == kind).groupBy("key").agg(what.alias("todo")), "key")

    if worst >= 1:
        pieces = todo(1).mapInArrow(_cut_out, "gram long, hash long, ahead long, times long, bytes binary")
        pieces = pieces.repartition("gram").sortWithinPartitions("gram", "hash")
        found = pieces.mapInArrow(_sorted_out(depth), "gram long, hash long, from long, to long")
        back = hits.where("kind = 1").join(found, ["gram", "hash"])
        runs = runs.unionByName(back.select("key", (first + F.col("from")).alias("from"), (first + F.col("to")).alias("to")))
    if worst >= 2:
        windows = todo(2).mapInArrow(_windows(depth), "key binary, from long, high long, low long")
        twice = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # A window of a very common passage meets its digest in SALTS partitions.
        twice = twice.select("high", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        back = windows.withColumn("salt", F.pmod(F.xxhash64("key", "from"), SALTS).cast("int"))
        back = back.join(twice, ["high", "low", "salt"])
        back = back.select("key", "from", (F.col("from") + depth).alias("to")).distinct()
        runs = runs.unionByName(back)
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("runs"))
    return texts.join(runs, "key", "left")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that intervals cover; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def _kept(data: memoryview, runs: pa.Scalar) -> tuple[list[memoryview], np.ndarray, np.ndarray]:
    if not runs.is_valid:
        none = np.zeros(0, np.int64)
        return [data], none, none
    start, end = merged(runs.values.field("from").to_numpy(), runs.values.field("to").to_numpy())
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2])], start, end


def _finished(names: list[str], schema: pa.Schema, row):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                data = memoryview(text.as_buffer())
                out.append(row(data, *_kept(data, runs)))
            columns = list(zip(*out)) or [()] * len(names)
            columns = [pa.array(c, schema.field(n).type) for c, n in zip(columns, names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return finish


def removed(docs: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """doc_id, spans and kept of every row: the bytes that are left, and what was taken out.

    Spans are maximal (start, end) in bytes of the text. The rest may begin or end inside a
    character, so it is binary. Null and empty texts have no spans; rows that are given twice
    are copies of each other.
    """
    schema = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def row(data, pieces, start, end):
        return [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())], b"".join(pieces)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, spans array<struct<start:long,end:long>>, kept binary"
    return repeated(docs, depth, most).mapInArrow(_finished(["spans", "kept"], schema, row), out)


def summary(docs: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see `removed`."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([*[(n, pa.int64()) for n in names[:3]], (names[3], pa.string())])

    def row(data, pieces, start, end):
        digest = hashlib.sha256()
        for piece in pieces:
            digest.update(piece)
        return len(data), int((end - start).sum()), len(start), digest.hexdigest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeated(docs, depth, most).mapInArrow(_finished(names, schema, row), out)
