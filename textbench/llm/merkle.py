"""Merkle manifest of a dataset: leaves, subroots by source, a root and proofs.

Method: slot pivot. Nodes of a level are numbered in their order; number // FANOUT
is the parent and number % FANOUT the slot. Conditional aggregates spread the
children of a parent into FANOUT columns. The columns in a row give the parent's
digest, and what is left and right of a node's own column are its siblings.

Levels are pivoted upwards and written once each; their sizes fall by FANOUT. On
the way down each parent hands its children its own siblings, so only tables
of a sixteenth of the leaves carry siblings through a shuffle.

A leaf covers doc_id, source, lang, n_chars and text; each field is `-` if null,
else its length in UTF-8 bytes, `:` and its value. Null ids come first in a
source; equal ids are ordered by leaf. A source of one row has its leaf as
subroot, a table of one source its subroot as root; without siblings the proof
is the digest of nothing. A null id is never tampered with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.scratch import cut
from textbench.operators.ordinal import with_sorted_position

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(fields: list[Column]) -> Column:
    def framed(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[framed(f) for f in fields])


def pivot(nodes: DataFrame) -> DataFrame:
    """(_key, _pos, _n, s0 … s15, _digest): one row a parent, for keys of several nodes.

    `nodes` has _key, _pos from 0, _n (nodes of the key) and _node, a struct with `digest`.
    """
    slot = F.col("_pos") % FANOUT
    slots = [f"s{k}" for k in range(FANOUT)]
    spread = (
        nodes.where("_n > 1")
        .groupBy("_key", F.floor(F.col("_pos") / FANOUT).alias("_pos"))
        .agg(
            F.max("_n").alias("_n"),
            *[F.max(F.when(slot == k, F.col("_node"))).alias(s) for k, s in enumerate(slots)],
        )
    )
    return spread.withColumn("_n", F.ceil(F.col("_n") / FANOUT)).withColumn(
        "_digest", digest(*[F.col(s)["digest"] for s in slots])
    )


def hand_down(pivoted: DataFrame, above: DataFrame) -> DataFrame:
    """Each child of `pivoted` with _node, _path and the other columns of `above`.

    `above` has _key and _pos of the parents and their _path: an array from the
    lowest level to the root of what stands left and right of the node.
    """
    digests = [F.coalesce(F.col(f"s{k}")["digest"], F.lit("")) for k in range(FANOUT)]
    children = F.array(
        *[
            F.struct(
                F.lit(k).alias("slot"),
                F.col(f"s{k}").alias("node"),
                F.concat_ws("", *digests[:k]).alias("left"),
                F.concat_ws("", *digests[k + 1 :]).alias("right"),
            )
            for k in range(FANOUT)
        ]
    )
    up = above.select(*[F.col(c).alias(f"_up{c}") if c in ("_key", "_pos") else c for c in above.columns])
    met = pivoted.join(up, F.col("_key").eqNullSafe(F.col("_up_key")) & (F.col("_pos") == F.col("_up_pos")))
    rest = [c for c in above.columns if c not in ("_key", "_pos", "_path")]
    return (
        met.withColumn("_child", F.explode(F.filter(children, lambda c: c["node"].isNotNull())))
        .withColumn("_pos", F.col("_pos") * FANOUT + F.col("_child.slot"))
        .select(
            "_key",
            "_pos",
            F.col("_child.node").alias("_node"),
            F.concat(F.array(F.struct("_child.left", "_child.right")), "_path").alias("_path"),
            *rest,
        )
    )


class Tree:
    """Levels of the trees of all keys; `tops` has (_key, _n, _top), one row a key."""

    def __init__(self, nodes: DataFrame, most: int):
        """`most` is the largest _n."""
        self.leaves = nodes
        self.height, self.levels, tops = 0, [], []
        while most > FANOUT**self.height:
            self.height += 1
        for _ in range(self.height):
            tops.append(nodes.where("_n = 1"))
            self.levels.append(cut(pivot(nodes)))
            nodes = self.levels[-1].select(
                "_key", "_pos", "_n", F.struct(F.col("_digest").alias("digest")).alias("_node")
            )
        tops.append(nodes.where("_n = 1"))
        self.tops = reduce(DataFrame.unionByName, [t.select("_key", F.col("_node.digest").alias("_top")) for t in tops])

    def paths(self, above: DataFrame) -> DataFrame:
        """Leaves with _node, _path and other columns of `above`, which has a row per key: _key, _n, _path …"""
        steps = sum([(F.col("_n") > FANOUT**k).cast("int") for k in range(self.height)], F.lit(0))
        tops = above.withColumn("_steps", steps).withColumn("_pos", F.lit(0).cast("long")).drop("_n")

        def ending(level):
            return tops.where(F.col("_steps") == level).drop("_steps")

        now = ending(self.height)
        for level in range(self.height - 1, -1, -1):
            now = hand_down(self.levels[level], now)
            if level:
                now = now.drop("_node").unionByName(ending(level))
        single = self.leaves.where("_n = 1").select("_key", "_node")
        tops = ending(0).drop("_pos").withColumnRenamed("_key", "_up_key")
        single = single.join(tops, F.col("_key").eqNullSafe(F.col("_up_key"))).withColumn("_pos", F.lit(0).cast("long"))
        if not self.height:
            return single.drop("_up_key")
        return now.unionByName(single.drop("_up_key"))


def no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def proof(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(path: Column, node: Column) -> Column:
    """The root that follows from `node` and the siblings of its path."""
    return F.aggregate(path, node, lambda below, p: F.sha2(F.concat(p["left"], below, p["right"]), 256))


def manifest(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    `text_now` is the text to verify against the manifest of `docs`; by
    default it is unchanged.
    """
    fields = [F.col(c) for c in FIELDS]
    whole = leaf(fields)
    now = whole if text_now is None else leaf([*fields[:-1], text_now])
    rows = docs.select("doc_id", "source", whole.alias("leaf"), now.alias("now"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    rows = with_sorted_position(rows, order, "_at")
    firsts = cut(rows.groupBy(F.col("source").alias("_key")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    nodes = rows.join(firsts, F.col("source").eqNullSafe(F.col("_key"))).select(
        "_key",
        (F.col("_at") - F.col("_first")).alias("_pos"),
        "_n",
        F.struct("doc_id", F.col("leaf").alias("digest"), "now").alias("_node"),
    )
    trees = Tree(nodes, firsts.agg(F.max("_n")).first()[0] or 0)
    order = [F.col("_source").asc_nulls_first()]
    sources = with_sorted_position(trees.tops.withColumnsRenamed({"_key": "_source", "_top": "digest"}), order, "_pos")
    total = sources.count()
    upper = Tree(
        cut(
            sources.select(
                F.lit("").alias("_key"), "_pos", F.lit(total).cast("long").alias("_n"), F.struct("_source", "digest").alias("_node")
            )
        ),
        total,
    )
    root = upper.tops.select("_key", F.lit(total).cast("long").alias("_n"), no_path().alias("_path"), F.col("_top").alias("root"))
    above = upper.paths(root).select(
        F.col("_node._source").alias("_source"), "_path", F.col("_node.digest").alias("subroot"), "root"
    )
    above = cut(
        above.join(firsts, F.col("_source").eqNullSafe(F.col("_key"))).select("_key", "_n", "_path", "subroot", "root")
    )
    out = trees.paths(above)
    return out.select(
        F.col("_node.doc_id").alias("doc_id"),
        F.col("_node.digest").alias("leaf"),
        "subroot",
        "root",
        proof(F.col("_path")).alias("proof_sha256"),
        fold(F.col("_path"), F.col("_node.now")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def summary(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest, held against texts of which those whose id's crc32 `every` divides are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return manifest(docs, F.when(hit, lowered(F.col("text"))).otherwise(F.col("text")))
