import __spark_entry__ as entry


def test_every_sql_twin_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 170


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"qc_flag", "reasons"} <= set(df.columns)


def test_registry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    code = "import __spark_entry__ as e; print(len(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
