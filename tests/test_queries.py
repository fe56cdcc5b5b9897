"""Registered queries against their SQL on the smallest given tables, and the contract without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quern.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: "null" if x is None or x is pd.NA or x != x else repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(clean(getattr(v, "item", lambda v=v: v)()) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["ret1_postings", "ret2_bm25", "ret3_knn", "ret3_knn_filtered", "ret4_recall", "ret5_hybrid", "set3_semantic", "val3_dataset", "fus4_quota", "str4_status", "fn16_json", "fn17_dates", "fn12_safe_ratio", "fus1_rrf", "fus3_subqueries", "met8_case_metrics", "met9_run_summary", "met12_attribution", "exp1_compare", "jn7_containment", "snk2_digest", "str2_changes", "win5_budget", "met18_calibrate", "rnk3_fallback"])
def test_query_equals_sql(spark, db, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())


NEW = [n for n in catalog.oracle_sql() if catalog.QUERIES[n].__closure__ and any(c.cell_contents.__module__.rsplit(".", 1)[-1] in ("documents", "questions", "evaluation", "files") for c in catalog.QUERIES[n].__closure__ if callable(c.cell_contents))]


@pytest.mark.parametrize("name", NEW)
def test_query_on_documents_questions_evaluation_or_files_equals_sql(spark, db, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.sql(catalog.oracle_sql()[name]).df())


def test_failed_reranks_and_empty_contexts_have_rows(spark):
    from quern.operators import context, fusion

    hits = spark.createDataFrame([(1, 7, 1, "x"), (2, 8, 1, "y")], "query_id long, chunk_id long, rank int, content string")
    scores = spark.createDataFrame([(1, 7, 0.5)], "query_id long, chunk_id long, rerank_score double")
    got = {(r.query_id, r.chunk_id, r.status) for r in fusion.rerank_or_fallback(hits, scores, fail_open=False).collect()}
    assert got == {(1, 7, "SUCCESS"), (2, None, "FAILED")}
    questions = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    status = context.context_status(questions, hits, hits.where("query_id = 1"))
    assert {(r.query_id, r.n_chunks, r.status) for r in status.collect()} == {(1, 1, "SUCCESS"), (2, 0, "TRUNCATED"), (3, 0, "EMPTY")}


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_contract_holds_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    subprocess.run(["cp", "-r", str(root / "quern"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    if (tmp_path / "quern/llm").exists():
        (tmp_path / "quern/llm").rename(tmp_path / "moved")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-2]) == len(catalog.queries())


@pytest.mark.parametrize("name", ["ana7_features", "ana8_policy"])
def test_features_and_policy_of_shared_hits_run(spark, name):
    """Each question has one row; a union of two parts of the hits, dealt by question, failed here when it was read."""
    assert catalog.queries()[name](spark, SF).toPandas()["query_id"].nunique() == spark.read.parquet(f"{SF}/benchmark.parquet").count()


def test_chunk_types_are_read_without_ranking_the_hits(spark):
    """What the hits are joined to is every line item; ranking all lists again for that took a third of the time."""
    plan = catalog.queries()["ret7_auto"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Window [" in x]) <= 9


def _lines(spark, name, word):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if word in x]


def test_what_a_task_holds_of_a_case_is_bounded(spark):
    """Items, facts and cases are dealt by part into a known number of tasks; few partitions each got a share of all before."""
    dealt = _lines(spark, "met12_attribution", "RepartitionByExpression [case_code") + _lines(spark, "met12_attribution", "RepartitionByExpression [query_id")
    assert len([x for x in dealt if "chunk_id" not in x]) >= 3


def test_expanded_hits_rank_the_lists_once(spark):
    """The chunks of both lists are written once; before, they were ranked again for each of their three uses."""
    assert len(_lines(spark, "jn11_expand", "Window [")) <= 3
