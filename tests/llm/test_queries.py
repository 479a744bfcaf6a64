"""Registered queries against their SQL, the pipeline stage by stage, and a library without them."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cellarline.llm.queries import llm_queries, llm_sql
from tests.conftest import DATA
from tests.llm.helpers import AWKWARD, prose
from tools.compare import differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = llm_queries()[name](spark, DATA).toPandas()
    assert differences(got, con.execute(llm_sql()[name]).df()) == []


def test_one_query_for_each_operator():
    names = [name.split("_")[0] for name in llm_queries()]
    assert names == [f"op{n}" for n in range(1, 14)]
    assert set(llm_queries()) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    joined = last.join(kept, "doc_id").where("decoded = text")
    assert joined.count() == kept.count() == last.count()


def test_stages_decide(spark):
    rows = [(i, t, "en", "s", 0) for i, t in AWKWARD] + [(30, prose(3, 200), "en", "s", 0), (31, prose(3, 199) + " end", "en", "s", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    apart = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()]
    assert sorted(apart, key=lambda i: (i is None, i)) == [1, 4, 5, 7, 30, None]
    found = corpus_pipeline.dedup_lines(spark, docs, DATA)
    assert found.where("n_chars <> length(text)").count() == 0 and found.count() == len(rows)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    leaked = docs.withColumn("text", F.when(F.col("doc_id") == 30, F.lit("before " + item)).otherwise(F.col("text")))
    clean = [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, leaked, DATA).collect()]
    assert 30 not in clean and len(clean) == len(rows) - 1


def test_stages_keep_columns_and_rows_of_their_own(spark):
    """Clashing columns stay as they were; rows that repeat an id go with their own text, and one of equal rows stays."""
    a, b = prose(1, 90), prose(2, 90)
    rows = [(3, a), (6, a), (6, b), (9, b), (7, prose(4, 90)), (7, prose(4, 90)), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    docs = docs.withColumns({name: F.lit("clash") for name in ("_score", "_row", "_copy", "row", "component", "_gone")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns
        assert all(r[name] == "clash" for r in got.collect() for name in ("_score", "_row", "_copy", "row", "component", "_gone"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, a), (3, a), (6, b), (7, prose(4, 90))])


def test_empty_tables_go_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_the_rest_works_without_these(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and set(e.oracle_sql()) == set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 80


