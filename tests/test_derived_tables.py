"""Derived tables over odd documents: the same rows from Spark and from DuckDB."""

import shutil

import duckdb
import pytest
from compare import TABLES, connect, differences

import __spark_entry__ as entry
from textbench.plans.fixtures import Tables, with_tables

SMALL = "/root/testdata/sf0.001"
NULL = [None, "Plain text. It ends."]
WIDE = ["\u3000Wide text. It ends.\u2003", "\u00a0Some text.\u2009 It goes on\u202f"]
RUNS, SQLS = entry.queries(), entry.oracle_sql()


def folder(path, texts):
    """The smallest tables with these texts, each under sixty ids and four languages."""
    for name in TABLES:
        shutil.copy(f"{SMALL}/{name}.parquet", path / f"{name}.parquet")
    languages = ["en", "de", "fr", "es"]
    rows = [(i, texts[i % len(texts)], languages[i // 7 % 4]) for i in range(60 * len(texts))]
    con = duckdb.connect()
    con.execute("CREATE TABLE made (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO made VALUES (?, ?, ?)", rows)
    con.execute(
        f"COPY (SELECT doc_id, text, lang, 'web' AS source, length(text) AS n_chars FROM made) TO '{path}/documents.parquet'"
    )
    return str(path)


@pytest.fixture(scope="module")
def null_texts(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("null"), NULL)


@pytest.fixture(scope="module")
def wide_texts(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("wide"), WIDE)


@pytest.mark.parametrize("name, columns", [("response", "model, template, ord, content"), ("synth", "question_id, story, content")])
def test_tables_with_null_texts(spark, null_texts, name, columns):
    sql = with_tables([f"fx_{name}"], f"SELECT {columns} FROM fx_{name}")
    made = getattr(Tables(spark, null_texts), name).select(*columns.split(", "))
    assert differences(made, connect(null_texts), sql) == []


@pytest.mark.parametrize("name", ["missing_choices", "union_models"])
def test_queries_with_null_texts(spark, null_texts, name):
    assert differences(RUNS[name](spark, null_texts), connect(null_texts), SQLS[name]) == []


@pytest.mark.parametrize("name", ["assemble_item", "first_match_per_choice", "parse_synthesis"])
def test_no_record_of_a_null_text_is_lost(spark, null_texts, name):
    [(asked,)] = connect(null_texts).execute(f"SELECT count(*) FROM ({SQLS[name]}) q").fetchall()
    assert RUNS[name](spark, null_texts).count() == asked


@pytest.mark.parametrize("name", ["assemble_item", "first_match_per_choice", "parse_synthesis", "score_stream"])
def test_queries_with_wide_spaces(spark, wide_texts, name):
    assert differences(RUNS[name](spark, wide_texts), connect(wide_texts), SQLS[name]) == []
