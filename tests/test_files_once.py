"""Files are read and parsed once, however often the numbered rows are used."""

import json

from pyspark.sql import functions as F

from textbench.operators import curate
from textbench.sources import elements, readers


def test_numbered_rows_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 90, numPartitions=3).select(
        F.concat(F.lit("f"), (F.col("id") % 9).cast("string")).alias("path"),
        F.floor(F.col("id") / 9).alias("ord"),
        F.concat_ws("_", F.lit("q"), (F.col("id") % 30).cast("string"), F.col("id").cast("string")).alias("sample_id"),
    )
    numbered = readers.number_files(rows.mapInArrow(seen, rows.schema))
    kept = curate.dedup_first(numbered).collect()
    assert sorted(r.ord for r in numbered.collect()) == list(range(90))
    assert len(kept) == 30 and read.value == 90


def test_form_of_files_comes_with_the_first_pass(spark, tmp_path):
    items = [{"sample_id": f"q_{k}", "sentences": "a, [b], {c}" * 9} for k in range(40)]
    (tmp_path / "a.json").write_text(" \n" + json.dumps(items))
    (tmp_path / "b.json").write_text(json.dumps({"name": "x", "samples": items}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = elements.fragments(spark, str(tmp_path))
        sums = "path string, start long, quotes long, outer long, inner long, bare boolean"
        ranges = rows.mapInArrow(elements._summed, sums).collect()
        starts = elements._starts(spark.createDataFrame(ranges, sums)).collect()
        found = elements.read_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(ranges) > 8 and all((r.bare is None) == (r.start > 0) for r in ranges)
    assert {(r.path[-6:], r.bare) for r in starts} == {("a.json", True), ("b.json", False)}
    assert sorted((r.path[-6:], r.ord) for r in found) == [(p, k) for p in ("a.json", "b.json") for k in range(40)]
    assert all(json.loads(r.raw) == items[r.ord] for r in found)
