"""Models of personal data come from all rows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from textbench.llm import pii


def test_pii_models_are_fitted_on_all_rows(spark):
    """Secrets only in rows that a sample of 10,000 ids by their hash leaves out."""
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) > 10_000
    docs = spark.range(12_000).withColumnRenamed("id", "doc_id").withColumn("late", late)
    text = F.when(F.col("late"), F.concat(F.lit("the password: k9Xq"), F.lpad(F.col("doc_id").cast("string"), 9, "7"), F.lit(" is"))).otherwise("plain words abcdefgh12345")
    docs = docs.select("doc_id", text.alias("text"))
    detector = pii.fit(docs)
    assert "secret" in detector.models
    found = pii.find(docs, detector).select(pii._text_of(F.col("_spans")).alias("s"))
    assert found.where("s like '%secret%'").count() == 2_000


def test_pii_sums_of_spark_grow_the_same_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (500, len(pii.FEATURES)))
    y = (x[:, 1] > 11) ^ (x[:, 4] > 20)
    rows = [("ip", False, int(b), a.tolist(), 1) for a, b in zip(x, y)]
    table = spark.createDataFrame(rows, "kind string, held boolean, y int, x array<long>, n long")
    grown = pii.grow({"ip": (500, int(y.sum()))}, pii._sums_of(table))["ip"]
    assert len(grown.trees) == pii.TREES
    assert np.allclose(grown.raw(x.astype(float)), pii.boost(x.astype(float), y.astype(float)).raw(x.astype(float)), atol=1e-4)
    values = [0, 5, 31, 32, 33, 63, 64, 67, 1000]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(pii.rounded(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == [0, 5, 31, 32, 32, 62, 64, 64, 992]


def test_pii_fit_is_the_same_by_rounds_of_spark(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(pii, "TREES", 3)
    here = pii.fit(docs)
    monkeypatch.setattr(pii, "HERE", -1)
    there = pii.fit(docs)
    assert here.models and here.models.keys() == there.models.keys()
    for kind, (model, least) in here.models.items():
        other, limit = there.models[kind]
        assert [(t.top, t.low, t.high) for t in model.trees] == [(t.top, t.low, t.high) for t in other.trees]
        assert np.allclose([t.leaves for t in model.trees], [t.leaves for t in other.trees], atol=1e-6)
        assert abs(least - limit) < 0.01
