"""Each query against its SQL twin, and the entry without its optional parts."""

import os
import subprocess
import sys

import duckdb
import pytest

from clueframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else repr(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, sf, sql, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = sql.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())


def test_entry_without_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "clueframe"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/clueframe/llm"], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_half_way_means_go_up_in_any_order(spark):
    from clueframe.operators import evaluation

    values = {1: [54.3, 54.4] * 2000, 2: [29.3, 29.4] * 3000, 3: [None], 4: [float("inf"), 1.0], 5: [1e25, 1.0], 6: [0.1234567891234]}
    for order in (1, -1):
        rows = [(u, 1, x, True) for u, xs in values.items() for x in xs][::order]
        table = spark.createDataFrame(rows, "user_id int, score_points int, distance_km double, is_match boolean")
        got = {r.user_id: r.mean_km for r in evaluation.scoreboard(table.coalesce(1), ["user_id"]).collect()}
        assert got == {1: 54.4, 2: 29.4, 3: None, 4: float("inf"), 5: 5e24, 6: 0.1}
