"""Tables that are written together once, whatever is repeated or lost on the way.

A commit writes each of its tables below `<path>/<table>/commit=<id>/…` and, when all of them
are there, one log entry `<path>/_log/<id>`, which a rename puts in place as a whole.
Readers follow the log: rows of an attempt without an entry are never seen, so a job that
fails between two tables leaves nothing, and its repetition leaves each row once.

An entry lists the keys (experiments) that the commit holds. A later commit of the
same key replaces it (`replace=True`, as a run is written again) or adds to it. A commit whose id is in
the log already does nothing, so a job that was repeated after its end is harmless
too. `vacuum` removes what no reader sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

_LOG = "_log"
_OF_LOG = ["commit", "seq", "replace"]


class _Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.base = path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.base}/{name}"))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.base}/{name}")))

    def rename(self, old: str, new: str) -> bool:
        to = self._path(f"{self.base}/{new}")
        self.fs.mkdirs(to.getParent())
        return not self.fs.exists(to) and self.fs.rename(self._path(f"{self.base}/{old}"), to)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.base}/{name}"), True)


def committed(spark: SparkSession, path: str) -> list[str]:
    return _Folder(spark, path).names(_LOG)


def log(spark: SparkSession, path: str) -> DataFrame:
    """(by…, commit, seq, replace): a row for each commit and key, or None without commits."""
    names = committed(spark, path)
    return spark.read.parquet(*[f"{path}/{_LOG}/{n}" for n in names]) if names else None


def commit_tables(
    tables: Mapping[str, DataFrame],
    path: str,
    by: Sequence[str],
    commit: str | None = None,
    replace: bool = True,
) -> str:
    """Write tables, all of which have the columns `by`, in one commit; gives its id.

    `commit` names the job: with a name that a repetition has again, a commit that is
    done is not made twice. Attempts write to folders of their own, so a failed one cannot mix
    with the next.
    """
    by, frames = list(by), list(tables.values())
    spark = frames[0].sparkSession
    folder, name = _Folder(spark, path), commit or uuid.uuid4().hex
    if folder.exists(f"{_LOG}/{name}"):
        return name
    attempt = f"{name}~{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.withColumn("commit", F.lit(attempt)).write.mode("append").partitionBy("commit", *by).parquet(f"{path}/{table}")
    # The keys are read from what was written, so that they are those of the rows in place.
    keys = None
    for table, df in tables.items():
        got = _typed(spark, f"{path}/{table}", df.schema, by)
        got = got.where(F.col("commit") == attempt).select(*by, "commit")
        keys = got if keys is None else keys.unionByName(got)
    before = log(spark, path)
    seq = 0 if before is None else before.agg(F.max("seq")).first()[0] + 1
    staged = f"_staged/{attempt}"
    keys.distinct().withColumns({"seq": F.lit(seq), "replace": F.lit(replace)}).write.parquet(f"{path}/{staged}")
    if not folder.rename(staged, f"{_LOG}/{name}"):
        # Another attempt of the same job was faster; its rows count.
        folder.remove(staged)
    return name


def _typed(spark: SparkSession, path: str, schema: Ty.StructType, by: Sequence[str]) -> DataFrame:
    """Parquet below `path` with folder names read as the types they were written from."""
    fields = [f for f in schema if f.name not in by]
    fields += [Ty.StructField("commit", Ty.StringType())] + [schema[k] for k in by]
    return spark.read.schema(Ty.StructType(fields)).parquet(path)


def visible(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """(by…, commit): commits that count for each key, the last one that replaces and those after it."""
    entries = log(spark, path)
    order = F.struct("seq", "commit")
    last = entries.groupBy(*by).agg(F.max(F.when(F.col("replace"), order)).alias("_last"))
    met = entries.alias("e").join(last.alias("l"), [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in by])
    seen = F.col("_last").isNull() | (F.struct("e.seq", "e.commit") >= F.col("_last"))
    return met.where(seen).select(*[f"e.{k}" for k in by], "e.commit")


def read_committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of `table` that count. Partitions of other commits are not read."""
    entries = log(spark, path)
    if entries is None:
        raise ValueError(f"nothing is committed in {path}")
    by = [c for c in entries.columns if c not in _OF_LOG]
    found = spark.read.parquet(f"{path}/{table}").schema
    known = {f.name: f for f in entries.schema}
    fields = [known[f.name] if f.name in by else f for f in found if f.name != "commit"]
    rows = _typed(spark, f"{path}/{table}", Ty.StructType(fields), by)
    counts = visible(spark, path, by)
    same = [rows[k].eqNullSafe(counts[k]) for k in by] + [rows["commit"] == counts["commit"]]
    # Only names of attempts that counted are asked for, so that folders of others are not listed as work.
    attempts = [r.commit for r in counts.select("commit").distinct().limit(1001).collect()]
    if len(attempts) <= 1000:
        rows = rows.where(F.col("commit").isin(attempts))
    return rows.join(counts, same, "left_semi").drop("commit")


def vacuum(spark: SparkSession, path: str, tables: Sequence[str]) -> list[str]:
    """Remove rows of attempts that no reader sees; gives their folders.

    Only to be called while nothing is being written: an attempt under way has no entry.
    """
    folder, entries = _Folder(spark, path), log(spark, path)
    by = [] if entries is None else [c for c in entries.columns if c not in _OF_LOG]
    # A folder per commit, as many as the driver lists in any case.
    kept = set() if entries is None else {r.commit for r in visible(spark, path, by).select("commit").distinct().collect()}
    gone = []
    for table in tables:
        for name in folder.names(table):
            if name.startswith("commit=") and spark._jvm.java.net.URLDecoder.decode(name[7:], "UTF-8") not in kept:
                folder.remove(f"{table}/{name}")
                gone.append(f"{table}/{name}")
    folder.remove("_staged")
    return gone
