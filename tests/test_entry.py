"""The driver's entry points: every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import os
import subprocess
import sys
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
HEAVY = {"print_hunks", "xml_documents"}


def canon(x):
    if isinstance(x, dict):
        return tuple(sorted((k, canon(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(canon, x))
    if isinstance(x, float):
        return None if x != x else int(x) if x == int(x) else round(x, 9)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def core():
    import __spark_entry__ as e
    from lexdelta.plans import delivered, documents, printed, problems, relational, structure, versions

    names = [n for r in (problems.R, versions.R, relational.R, structure.R, printed.R, documents.R, delivered.R) for n in r.sql]
    return e, names


def test_names():
    e, _ = core()
    assert e.oracle_sql().keys() <= e.queries().keys()


@needs_data
def test_entry(spark):
    e, _ = core()
    assert e.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", core()[1])
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    e, _ = core()
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    df = e.queries()[name](spark, DATA)
    c = con.execute(e.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = Counter(repr(tuple(canon(r[i]) for i in order)) for r in c.fetchall())
    mine = sorted(df.columns)
    got = Counter(repr(tuple(canon(r[c]) for c in mine)) for r in df.collect())
    assert got == want


@needs_data
@pytest.mark.parametrize("name", ["compare_changes", "compare_money", "print_hunks", "print_breadcrumbs", "xml_documents", "html_reports", "tree_json", "body_spans", "account_paths", "accept_marks", "p1_units", "p2_schema", "change_groups", "word_diff", "seq_ratio"])
def test_query_without_sql_runs(spark, name):
    e, _ = core()
    assert e.queries()[name](spark, DATA).count() > 0


def test_core_works_without_the_text_problems(tmp_path):
    """Nothing outside the subpackage imports it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "lexdelta")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as h:
                        assert "lexdelta.llm" not in h.read(), f
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n def find_spec(self, name, path=None, target=None):\n  if name.startswith('lexdelta.llm'): raise ImportError(name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'p5_found' in e.queries() and 'p4_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0
