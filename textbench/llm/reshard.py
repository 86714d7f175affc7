"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards take up to their capacity, and a byte
that changes its shard costs one. Successive shortest paths on this small graph
(shards, not rows) give the block transfers that move the fewest bytes. Inside
an old shard documents are laid out by falling size class and a hash of the id;
each transfer is a stretch of that order, so blocks are cut between short
documents and shard sizes come out nearly equal. Shards that gain or lose
nothing keep their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.llm.order import piece_sums, with_running_sums
from textbench.llm.scratch import stored

OLD_SHARDS = 32
SHARDS = 40
#: Bytes a row takes beside its text.
ROW_BYTES = 16


def capacities(total: int, shards: int = SHARDS) -> list[int]:
    """Sizes that differ by at most one byte."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def transfers(supply: Sequence[int], capacity: Sequence[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from old shard i to new shard j at the least cost.

    `cost[i, j]` is the price of a byte, by default 0 where i = j and 1
    elsewhere. Supplies and capacities must have the same sum.
    """
    m, n = len(supply), len(capacity)
    if sum(supply) != sum(capacity):
        raise ValueError("supplies and capacities differ in their sum")
    if cost is None:
        cost = 1.0 - np.eye(m, n)
    flow = np.zeros((m, n), dtype=object)
    left, room = list(map(int, supply)), list(map(int, capacity))
    while any(left):
        # Shortest paths from the old shards that still hold bytes; moving back along a flow refunds it.
        old = np.array([0.0 if x else np.inf for x in left])
        new = np.full(n, np.inf)
        via_old, via_new = np.full(n, -1), np.full(m, -1)
        refund = np.where(flow > 0, -cost, np.inf)
        for _ in range(m + n):
            path = old[:, None] + cost
            best = path.argmin(axis=0)
            better = path[best, np.arange(n)] < new - 1e-12
            new[better], via_old[better] = path[best, np.arange(n)][better], best[better]
            back = new[None, :] + refund
            best = back.argmin(axis=1)
            nearer = back[np.arange(m), best] < old - 1e-12
            old[nearer], via_new[nearer] = back[np.arange(m), best][nearer], best[nearer]
            if not better.any() and not nearer.any():
                break
        open_ = [j for j in range(n) if room[j]]
        end = min(open_, key=lambda j: (new[j], j))
        steps, j = [], end
        while True:
            i = int(via_old[j])
            steps.append((i, j, 1))
            if via_new[i] < 0:
                break
            j = int(via_new[i])
            steps.append((i, j, -1))
        amount = min([left[i], room[end], *[flow[a, b] for a, b, sign in steps if sign < 0]])
        for a, b, sign in steps:
            flow[a, b] += sign * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def hashed_layout(id_: Column, shards: int = OLD_SHARDS) -> Column:
    """Shard of an id in a layout by hash; null ids lie in shard 0."""
    return F.coalesce(F.pmod(F.xxhash64(id_), F.lit(shards)), F.lit(0)).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and the bytes of its row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def plan(
    docs: DataFrame, old: str, size: str, id_col: str = "doc_id",
    shards: int = SHARDS, old_shards: int = OLD_SHARDS,
    capacity: Sequence[int] | None = None, cost: np.ndarray | None = None,
) -> DataFrame:
    """`docs` plus shard (from 0), slot (gapless from 0 in its shard) and moved.

    `old` names each row's present shard below `old_shards`, `size` its bytes. Rows
    without such a shard (null, or any other number) are supply that has to move.
    Repeated rows are rows of their own. What reaches the driver is a figure per
    old shard and a count per pair of old and new shard.
    """
    names = ["shard", "slot", "moved"]
    # Size classes of an eighth of a doubling, largest first; then a hash of the id.
    level = 255 - F.least(F.floor(F.log2(F.col(size).cast("double") + 1) * 8), F.lit(255))
    digest = F.concat(
        F.lpad(F.hex(level), 2, "0"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
    )
    placed = F.col(old).between(0, old_shards - 1)
    rows = docs.drop(*names).withColumns(
        {"_old": F.when(placed, F.col(old)).otherwise(old_shards).cast("int"), "_digest": digest}
    )
    sums = {"_before": F.col(size), "_rank": F.lit(1).cast("long")}
    pieces = piece_sums(rows, "_old", "_digest", sums)
    held = {r._old: r.n for r in pieces.groupBy("_old").agg(F.sum("_all__before").alias("n")).collect()}
    supply = [int(held.get(k, 0)) for k in range(old_shards)]
    price = 1.0 - np.eye(old_shards, shards) if cost is None else np.asarray(cost, float)
    if held.get(old_shards):
        # Rows without a shard: wherever they go, they move.
        supply.append(int(held[old_shards]))
        price = np.vstack([price, np.full(shards, max(1.0, price.max()))])
    flow = transfers(supply, capacity or capacities(sum(supply), shards), price)
    # What stays comes first: the largest documents do not move.
    bounds: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(supply)):
        targets = sorted((j for j in range(shards) if flow[i, j]), key=lambda j: (j != i or i == old_shards, j))
        ends = np.cumsum([int(flow[i, j]) for j in targets]) if targets else []
        bounds[i] = [(int(j), int(e)) for j, e in zip(targets, ends)]
    middle = F.col("_before") + F.col(size) / 2
    shard = F.lit(None).cast("int")
    for i, parts in bounds.items():
        if parts:
            choice = F.lit(parts[-1][0])
            for j, end in reversed(parts[:-1]):
                choice = F.when(middle < end, j).otherwise(choice)
            shard = F.when(F.col("_old") == i, choice).otherwise(shard)
    placed = with_running_sums(rows, "_old", ["_digest", id_col, size], sums, pieces)
    placed = placed.withColumn("shard", shard)
    counts = {(r._old, r.shard): r.n for r in placed.groupBy("_old", "shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A stretch's rows follow one another in the old order: its slots are ranks, shifted.
    shift, filled = {}, dict.fromkeys(range(shards), 0)
    for i, parts in bounds.items():
        rank = 0
        for j, _ in parts:
            n = counts.get((i, j), 0)
            shift[i * shards + j] = filled[j] - rank
            filled[j] += n
            rank += n
    key = F.col("_old") * shards + F.col("shard")
    slot = F.col("_rank") + (_lookup(shift, key) if shift else F.lit(0))
    return placed.withColumns(
        {"slot": slot.cast("long"), "moved": (F.col("shard") != F.col("_old")) | (F.col("_old") == old_shards)}
    ).drop("_old", "_digest", "_before", "_rank")


def affected(planned: DataFrame, old: str) -> list[int]:
    """Shards whose files must be written or removed: all that gain or lose a row."""
    moves = planned.where("moved").select(F.explode(F.array("shard", F.col(old))).alias("s"))
    return sorted(r.s for r in moves.where("s is not null").distinct().collect())


_STAGED, _PLAN = "_reshard-", "_plan"


def rewrite(planned: DataFrame, old: str, path: str) -> list[int]:
    """Write the affected shards of the table in `path` in slot order; gives their numbers.

    A shard is a folder `shard=k`. Affected ones are written beside the others first, so `planned` may
    read `path` itself, and then take their places one by one; a shard that
    keeps no row is removed. Other shards keep their files. A job that is lost before the
    exchange leaves the table as it was; one that is lost within it is ended by `resume`.
    """
    changed = affected(planned, old)
    if not changed:
        return []
    spark = planned.sparkSession
    staged = f"{path}/{_STAGED}{uuid.uuid4().hex}"
    part = planned.where(F.col("shard").isin(changed))
    # A shard may be large: its rows go to files by ranges of slots.
    part = part.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    part.write.partitionBy("shard").parquet(staged)
    kept = {int(n.removeprefix("shard=")) for n in _Files(spark, staged).names() if n.startswith("shard=")}
    plan_rows = [(k, k in kept) for k in changed]
    spark.createDataFrame(plan_rows, "shard int, kept boolean").coalesce(1).write.parquet(f"{staged}/{_PLAN}")
    resume(spark, path)
    return changed


def resume(spark: SparkSession, path: str) -> None:
    """End an exchange of shards that was planned whole, and drop what was not."""
    files = _Files(spark, path)
    for staged in [n for n in files.names() if n.startswith(_STAGED)]:
        if files.exists(f"{staged}/{_PLAN}/_SUCCESS"):
            for r in spark.read.parquet(f"{path}/{staged}/{_PLAN}").collect():
                name = f"shard={r.shard}"
                if not r.kept:
                    files.remove(name)
                elif files.exists(f"{staged}/{name}"):
                    files.remove(name)
                    files.rename(f"{staged}/{name}", name)
        files.remove(staged)


class _Files:
    """Names below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at("")))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{old} could not be renamed to {new}")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) from a layout by hash.

    The law is `bytes`: sizes of shards are nearly equal. Null texts have the
    checksum of an empty one.
    """
    rows = docs.select(
        F.col(id_col),
        text_size(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        hashed_layout(F.col(id_col), old_shards).alias("old_shard"),
    )
    # Texts are read once; what the plan goes over three times is narrow.
    rows, _ = stored(rows, "sizes")
    return plan(rows, "old_shard", "size", id_col, shards, old_shards).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def reshard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """`docs` plus shard, slot and moved, from a layout by hash."""
    names = docs.columns
    rows = docs.withColumns(
        {"_size": text_size(F.col(text_col)), "_from": hashed_layout(F.col(id_col), old_shards)}
    )
    out = plan(rows, "_from", "_size", id_col, shards, old_shards)
    return out.select(*[n for n in names if n not in ("shard", "slot", "moved")], "shard", "slot", "moved")
