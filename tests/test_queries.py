"""Every registered query of the engine's own operators against its SQL, on the smallest tables; those without SQL must give rows."""

import os

import pytest

from assaykit import plans

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SMALL)
    cur = con.execute(plans.oracle_sql()[name])
    assert ordered(df.columns, df.collect()) == ordered([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["both", "pipeline", "llm"])
def test_the_rest_works_without_the_llm_subpackage(tmp_path, gone):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skipped = ["__pycache__"] + ["llm"] * (gone != "pipeline")
    shutil.copytree(f"{root}/assaykit", tmp_path / "assaykit", ignore=shutil.ignore_patterns(*skipped))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if gone == "llm":
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    code = f"import __spark_entry__ as e; q = e.queries(); assert 'q01_findings_report' in q and 'pipeline' not in q and any(k.startswith('op') for k in q) == {gone == 'pipeline'}; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_table_arithmetic_broadcasts_no_cells(spark):
    """Cells meet cells; 1.2 million papers' cells come from a file of 5 MB, so that a broadcast chosen by the file's size took all of the driver's memory."""
    df = plans.queries()["q74_rule_table_arithmetic"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 4


def test_near_miss_rounds_halves_as_its_sql(spark, tmp_path):
    """Cells of (nearly) half a cent by the order of multiplication and division, and a gap that ends in half a millionth."""
    import duckdb

    lines = [(1, 17842.05, 18.0), (2, 18684.1, 20.0), (3, 800.0, 1.0), (4, 2000.0, 2.0)]
    spark.createDataFrame(lines, "l_partkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 996.7), (2, 945.9), (3, 801.57), (4, 1000.0)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, plans.queries()["q09_near_miss_value"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.execute(plans.oracle_sql()["q09_near_miss_value"]).fetchall())
    assert [r[:3] for r in got] == [(1, 99670, 99123), (2, 94590, 93420), (3, 80157, 80000)]
