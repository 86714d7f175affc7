"""Writers deal a key by the bytes of its rows."""

from pyspark.sql import functions as F

from textbench.session import scratch_path
from textbench.sources import writers


def test_a_key_of_many_bytes_is_written_by_several_tasks(spark):
    """Also where all rows are equal."""
    rows = spark.range(0, 4096, 1, 8).select(F.lit("a").alias("split"), F.expr("uuid()").alias("text"), F.lit(1).alias("n"))
    path, source = scratch_path(spark, "sink"), scratch_path(spark, "source")
    rows.write.parquet(source)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        writers.split_write(spark.read.parquet(source), path)
    finally:
        spark.conf.set(name, before)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 4096 and max(r["count"] for r in files) <= 1024
