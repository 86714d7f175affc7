"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time, a straight line from a
first to a last weight. Its integral is the source's share of all words, capped
at `CAP` times the source's size with the excess reshared by weight. Inside a
source documents follow a hash of their id, pass after pass; the words before a
document are its demand offset, and inverting the cumulative demand of the
schedule gives its training position in [0, 1). Documents are then range-sorted
by position.

Only DataFrame functions are used. Running word counts are cut into pieces per
source (see `order`), so a source with a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.order import piece_sums, with_running_sums

CAP = 3
#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cycled_weights(rank: Column) -> tuple[Column, Column]:
    """First and last weight by the rank of a source from 0.

    Mean weights run 1, 2, 3 and repeat; light sources come early in training
    (from one and a half to a half of the mean), heavy ones late.
    """
    mean = F.pmod(rank, F.lit(3)) + 1
    lean = (mean - 2) * F.lit(0.5)
    return mean * (1 - lean), mean * (1 + lean)


def source_targets(sizes: DataFrame, schedule=cycled_weights, cap: int = CAP) -> DataFrame:
    """(_key, source_size, target, _lean) from (_key, source_size): one row per source.

    Sources rank by code point with null last. Filling starts with the source
    that reaches its cap first: with sources in order of cap per weight, the
    common level is what is left over the weight that is left, at the first
    source whose cap lies above it. This table has a row per source and is the
    only one that a single task sees whole.
    """
    by_name = Window.orderBy("_key")
    first, last = schedule(F.row_number().over(by_name) - 1)
    # The mean of a straight line is its integral over [0, 1].
    rows = sizes.withColumns({"_first": first, "_last": last}).withColumn(
        "_weight", (F.col("_first") + F.col("_last")) / 2
    )
    most = F.lit(cap) * F.col("source_size")
    rows = rows.withColumn("_full_at", most / F.col("_weight"))
    by_cap = Window.orderBy("_full_at", "_key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))
    rows = rows.withColumn("_level", left / F.sum("_weight").over(after))
    level = F.first(
        F.when(F.col("_full_at") >= F.col("_level"), F.col("_level")), ignorenulls=True
    ).over(everything)
    return rows.withColumn("_common", level).select(
        "_key",
        "source_size",
        F.least(most.cast("double"), F.col("_common") * F.col("_weight")).alias("target"),
        ((F.col("_last") - F.col("_first")) / (F.col("_last") + F.col("_first"))).alias("_lean"),
    )


def position(share: Column, lean: Column) -> Column:
    """Training time at which a share of a source's demand has been met.

    The demand up to time t is t + lean * (t² - t); this is its inverse.
    """
    b = 1 - lean
    return F.when(share <= 0, F.lit(0.0)).otherwise(
        2 * share / (b + F.sqrt(b * b + 4 * lean * share))
    )


def assign(
    docs: DataFrame, schedule=cycled_weights, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """`docs` plus size, source_size, target, taken, takes and first_position.

    `taken` counts the words the mix takes, repeats included: whole passes over
    the source and, in the last pass, the words below the target, so a source's
    taken words are its target rounded down. `takes` counts the passes that
    reach the document. Documents without words, null texts among them, have
    size 0 and take no words. Rows with a null id are placed like any other and
    repeated rows count each time. Columns of these names in `docs` are
    replaced. An empty table gives an empty result.
    """
    own = ["size", "source_size", "target", "taken", "takes", "first_position"]
    rows = docs.drop(*own).withColumns(
        {
            "size": word_count(F.col(text_col)),
            # Sorts by code point with null last, and is never null itself.
            "_key": F.concat(
                F.when(F.col(source_col).isNull(), "1").otherwise("0"),
                F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            ),
            "_digest": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
        }
    )
    sums = {"_before": F.col("size")}
    pieces = piece_sums(rows, "_key", "_digest", sums)
    sizes = pieces.groupBy("_key").agg(F.sum("_all__before").alias("source_size"))
    placed = with_running_sums(
        rows, "_key", ["_digest", id_col, "size"], sums, pieces, source_targets(sizes, schedule, cap)
    )
    demand = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumns({"_demand": demand, "_whole": whole}).withColumn(
        "_rest", F.col("_demand") - F.col("_whole") * F.col("source_size") - F.col("_before")
    )
    share = F.col("_before") / F.col("_demand")
    taken = F.col("_whole") * F.col("size") + F.greatest(F.least("_rest", "size"), F.lit(0))
    takes = F.col("_whole") + (F.col("_rest") > 0).cast("long")
    return placed.withColumns(
        {
            "taken": taken.cast("long"),
            "takes": takes,
            "first_position": F.when(takes > 0, position(share, F.col("_lean"))),
        }
    ).drop("_key", "_digest", "_whole", "_rest")


def mixture(
    docs: DataFrame, schedule=cycled_weights, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """`docs` as the mix takes them: a row per take, range-sorted by training position.

    A document reached by the last pass of its source is taken whole, so a
    source may exceed its target by less than that document.
    """
    placed = assign(docs, schedule, cap, id_col, text_col, source_col)
    takes = placed.where("takes > 0").withColumn(
        "_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("takes") - 1))
    )
    share = (F.col("_before") + F.col("_pass") * F.col("source_size")) / F.col("_demand")
    takes = takes.withColumn("_position", position(share, F.col("_lean")))
    order = ["_position", id_col, "_pass"]
    return (
        takes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*docs.columns)
    )


def summary(
    docs: DataFrame, schedule=cycled_weights, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken, first_position), sorted by position."""
    narrow = docs.select(id_col, text_col, source_col)
    out = assign(narrow, schedule, cap, id_col, text_col, source_col).select(
        id_col, "size", "source_size", "target", "taken", "first_position"
    )
    order = ["first_position", id_col]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
