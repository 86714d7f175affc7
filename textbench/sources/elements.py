"""Elements of large JSON files, read by many tasks a file.

A file is one JSON array, or an object with an array under a known name. Spark's text
reader cuts files into byte ranges at commas, on any file system, so a task gets
fragments of a range in their order without knowing whether it starts inside
a string and how deep. Three passes over the ranges settle that:

1. Each range counts its quotes and, for a start outside and inside a string, how
   far it goes down or up. Running sums over the ranges of a file (a row each) then give
   every range its true start.
2. From there each range finds the arrays that open, continue and close in it and counts
   their separators, so every range knows the position of its elements. The
   pieces before its first and after its last separator belong to elements of several
   ranges; they are kept with the counts and put together from there.
3. The elements that lie inside a range are given out, without a shuffle.

Commas inside strings, escaped quotes, brackets in strings and elements longer than a
range are all met. An element that is no JSON becomes null and does not spoil its file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textbench.session import stored

# Names under which a file keeps its rows, in the order they are tried.
LAYOUTS = ("samples", "interactions")

#: Most ranges whose starts are broadcast (about 100 bytes each); more are joined.
MOST_BROADCAST = 200_000

_SIGN = np.zeros(256, np.int8)
_SIGN[[ord(c) for c in "[{"]] = 1
_SIGN[[ord(c) for c in "]}"]] = -1
_BLANK = b" \t\r\n"


def fragments(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, start, bytes): what stands between commas, in the order of each range."""
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.option("lineSep", ",").option("recursiveFileLookup", "true").text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("bytes"),
    )


def _real_quotes(data: np.ndarray) -> np.ndarray:
    """Marks quotes without an odd run of backslashes before them."""
    quotes = data == 34
    slashes = data == 92
    if slashes.any():
        at = np.flatnonzero(quotes)
        before = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        run = np.where(at > 0, at - 1 - before[np.maximum(at - 1, 0)], 0)
        quotes[at[run % 2 == 1]] = False
    return quotes


class Scan:
    """Bytes of a range with where strings and brackets are, from a known start."""

    def __init__(self, data: np.ndarray, inside: bool, depth: int):
        self.data = data
        self.quotes = _real_quotes(data)
        odd = (np.cumsum(self.quotes) + inside) % 2 == 1
        self.sign = np.where(odd, 0, _SIGN[data])
        self.depth = depth + np.cumsum(self.sign, dtype=np.int64)
        self.commas = (data == 44) & ~odd
        self.inside = bool(odd[-1]) if len(data) else inside
        self.end = int(self.depth[-1]) if len(data) else depth

    def key_before(self, at: int) -> bytes:
        """Name of the value that begins at `at`; empty where it has none."""
        head = self.data[:at].tobytes().rstrip(_BLANK)
        if not head.endswith(b":"):
            return b""
        head = head[:-1].rstrip(_BLANK)
        marks = np.flatnonzero(self.quotes[: len(head)])
        if not head.endswith(b'"') or len(marks) < 2:
            return b""
        return head[marks[-2] + 1 : -1]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool, dict]]:
    """(range, its next bytes, whether the range starts here, its other columns).

    Each batch gives the fragments of a range joined by commas, with a comma at
    the end unless nothing follows; bytes are whole fragments.
    """
    last = None
    for batch in batches:
        paths, starts = batch.column("path"), batch.column("start").to_numpy()
        if not len(paths):
            continue
        other = pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False) | (starts[1:] != starts[:-1])
        new = [0, *(np.flatnonzero(other) + 1).tolist(), len(paths)]
        # A batch has few ranges and many fragments.
        values = batch.column("bytes").to_pylist()
        for a, b in zip(new, new[1:]):
            name = paths[a].as_py(), int(starts[a])
            extra = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c not in ("path", "start", "bytes")}
            yield name, b",".join([*values[a:b], b""]), name != last, extra
            last = name


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: path, start, quotes, outer and inner change of depth, and whether a file is a bare array.

    The first bytes of a file tell its form; other ranges have null.
    """
    now, sums, bare = None, [0, 0, 0], None

    def row():
        values = [*now, *sums, bare]
        kinds = [pa.string()] + [pa.int64()] * 4 + [pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds)], ["path", "start", "quotes", "outer", "inner", "bare"]
        )

    for name, raw, fresh, _ in _ranges(batches):
        if fresh:
            if now:
                yield row()
            now, sums, bare = name, [0, 0, 0], None if name[1] else _bare(raw)
        data = np.frombuffer(raw, np.uint8)
        quotes = _real_quotes(data)
        odd = (np.cumsum(quotes) + sums[0]) % 2 == 1
        sign = _SIGN[data]
        sums = [sums[0] + int(quotes.sum()), sums[1] + int(sign[~odd].sum()), sums[2] + int(sign[odd].sum())]
    if now:
        yield row()


def _starts(ranges: DataFrame) -> DataFrame:
    """path, start, inside, depth, bare: the true start of each range, from running sums."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))
    return known.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select(
        "path", "start", "inside", "depth", F.max("bare").over(Window.partitionBy("path")).alias("bare")
    )


class Arrays:
    """Follows the arrays of rows through one range.

    `pieces` takes (segment, number of separators before, bytes, begun, ended) for each
    part of an element; segment 0 is the array that was open at the start.
    """

    def __init__(self, start: int, inside: bool, depth: int, bare: bool):
        self.inside, self.depth = inside, depth
        self.level = 1 if bare else 2
        self.bare, self.segment = bare, 0
        self.open = depth >= self.level
        self.count, self.begun, self.rest = 0, False, b""
        self.opened: list[str] = []
        self.closed = False

    def feed(self, raw: bytes) -> Iterator[tuple[int, int, bytes, bool, bool]]:
        data = np.frombuffer(raw, np.uint8)
        scan = Scan(data, self.inside, self.depth)
        level = self.level
        ups = (scan.sign > 0) & (scan.depth == level)
        downs = (scan.sign < 0) & (scan.depth == level - 1)
        cuts = scan.commas & (scan.depth == level)
        at = 0
        for i in np.flatnonzero(ups | downs | cuts).tolist():
            if ups[i]:
                name = "array" if self.bare else scan.key_before(i).decode("utf-8", "replace")
                if data[i] == 91 and (self.bare or name in LAYOUTS):
                    self.segment += 1
                    self.opened.append(name)
                    self.open, self.count, self.begun, self.rest = True, 0, True, b""
                    self.closed = False
                    at = i + 1
            elif self.open:
                yield self.segment, self.count, self.rest + raw[at:i], self.begun, True
                self.rest, self.begun, at = b"", True, i + 1
                if cuts[i]:
                    self.count += 1
                else:
                    self.open, self.closed = False, True
            elif downs[i]:
                # An array of no interest ends.
                self.closed = True
        if self.open:
            self.rest += raw[at:]
        self.inside, self.depth = scan.inside, scan.end

    def finish(self) -> Iterator[tuple[int, int, bytes, bool, bool]]:
        if self.open:
            yield self.segment, self.count, self.rest, self.begun, False


def _bare(raw: bytes) -> bool:
    return raw.lstrip(_BLANK).startswith(b"[")


_SEGMENTS = "path string, start long, segment int, layout string, cuts long, closed boolean, pieces array<struct<at: long, bytes: binary>>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: a row per range and array in it, with the pieces of elements at the range's ends."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
    kinds.append(pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.binary())])))
    now, arrays, pieces, cuts = None, None, {}, {}

    def keep(found):
        for segment, at, raw, begun, ended in found:
            cuts[segment] = max(at, cuts.get(segment, 0))
            if not (begun and ended):
                pieces.setdefault(segment, []).append({"at": at, "bytes": raw})

    def rows():
        keep(arrays.finish())
        last = arrays.segment
        values = [
            [now[0], now[1], s, arrays.opened[s - 1] if s else None, cuts.get(s, 0),
             arrays.closed if s == last else s in cuts, pieces.get(s, [])]
            for s in range(last + 1)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*values), kinds)],
            ["path", "start", "segment", "layout", "cuts", "closed", "pieces"],
        )

    for name, raw, fresh, extra in _ranges(batches):
        if fresh:
            if now:
                yield rows()
            now, pieces, cuts = name, {}, {}
            arrays = Arrays(name[1], extra["inside"], extra["depth"], extra["bare"])
        keep(arrays.feed(raw))
    if now:
        yield rows()


def _given_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third pass: path, layout, ord, raw of elements that lie inside a range."""
    names = ["path", "layout", "ord", "raw"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    arrays, wanted = None, {}
    for name, raw, fresh, extra in _ranges(batches):
        if fresh:
            arrays = Arrays(name[1], extra["inside"], extra["depth"], extra["bare"])
            wanted = {w["segment"]: (w["layout"], w["before"]) for w in extra["wanted"] or ()}
        out = []
        for segment, at, piece, begun, ended in arrays.feed(raw):
            if begun and ended and segment in wanted:
                layout, before = wanted[segment]
                out.append((name[0], layout, before + at, piece))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _with_starts(rows: DataFrame, starts: DataFrame, ranges: int) -> DataFrame:
    """Fragments, in their order, with what is known of their ranges."""
    if ranges <= MOST_BROADCAST:
        return rows.join(F.broadcast(starts), ["path", "start"])
    numbered = rows.withColumn("_seq", F.monotonically_increasing_id())
    met = numbered.join(starts, ["path", "start"]).repartition("path", "start")
    return met.sortWithinPartitions("path", "start", "_seq").drop("_seq")


def _arrays_of(segments: DataFrame) -> DataFrame:
    """path, start, segment, layout, before, pieces of the array that is read of each file.

    `before` is the number of its separators in earlier ranges. The array is the last one of
    the first name in LAYOUTS that has one.
    """
    order = Window.partitionBy("path").orderBy("start", "segment")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("segment") > 0, F.struct("start", "segment", "layout"))
    # The array a segment is in: its own, or the last one that opened, unless it closed since.
    told = segments.withColumn("_own", F.last(opened, ignorenulls=True).over(up_to)).withColumn(
        "_shut",
        F.max(F.when(F.col("closed"), F.struct("start", "segment"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    )
    begun = F.struct(F.col("_own.start").alias("start"), F.col("_own.segment").alias("segment"))
    inside = F.col("_own").isNotNull() & F.coalesce((F.col("segment") > 0) | (F.col("_shut") < begun), F.lit(True))
    told = told.where(inside).withColumn("layout", F.col("_own.layout"))
    rank = F.coalesce(*[F.when(F.col("layout") == name, -i) for i, name in enumerate(LAYOUTS)], F.lit(1))
    best = F.max(F.struct(rank.alias("rank"), "_own")).over(Window.partitionBy("path"))
    chosen = told.withColumn("_best", best).where(F.col("_best._own") == F.col("_own"))
    ahead = F.coalesce(F.sum("cuts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chosen.withColumn("before", ahead).select("path", "start", "segment", "layout", "before", "pieces")


def read_elements(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, layout, ord, raw): the elements of the files of a folder, as `normalize_container` gives them.

    Files are split by `spark.sql.files.maxPartitionBytes`. Two passes are made at once, the
    last when the result is read. A compressed file is one range.
    """
    rows = fragments(spark, path)
    sums = "path string, start long, quotes long, outer long, inner long, bare boolean"
    ranges = stored(rows.mapInArrow(_summed, sums), "ranges")
    starts, many = stored(_starts(ranges), "starts"), ranges.count()
    segments = stored(_with_starts(rows, starts, many).mapInArrow(_counted, _SEGMENTS), "segments")
    arrays = stored(_arrays_of(segments), "arrays")
    wanted = arrays.groupBy("path", "start").agg(F.collect_list(F.struct("segment", "layout", "before")).alias("wanted"))
    whole = _with_starts(rows, starts.join(wanted, ["path", "start"]), many)
    whole = whole.mapInArrow(_given_out, "path string, layout string, ord long, raw binary")
    parts = arrays.select("path", "layout", "before", "start", F.explode("pieces").alias("_p"))
    parts = parts.groupBy("path", "layout", (F.col("before") + F.col("_p.at")).alias("ord")).agg(
        F.array_sort(F.collect_list(F.struct("start", F.col("_p.bytes").alias("bytes")))).alias("_parts")
    )
    joined = F.aggregate("_parts", F.lit(b""), lambda all_of, p: F.concat(all_of, p["bytes"]))
    out = whole.unionByName(parts.select("path", "layout", "ord", joined.alias("raw")))
    text = F.col("raw").cast("string")
    out = out.where(text.rlike(r"\S"))
    return out.withColumn("raw", F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0)))
