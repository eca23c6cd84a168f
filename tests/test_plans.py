"""Every plan gives the same rows in Spark and in DuckDB, more than none, and classes that differ."""

import duckdb
import pytest

from lexsieve.functions.dialect import DUCK
from lexsieve.plans.queries import PLANS, run

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer", "region", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", PLANS)
def test_same_rows(spark, con, name):
    df = run(spark, SF, name)
    names = sorted(df.columns)
    got = plain(tuple(r[c] for c in names) for r in df.collect())
    cur = con.execute(PLANS[name](DUCK))
    at = [[d[0] for d in cur.description].index(c) for c in names]
    assert got == plain(tuple(r[i] for i in at) for r in cur.fetchall())
    assert got and all(len(set(col)) >= 1 for col in zip(*got))


def test_no_word_of_a_clause_travels(spark):
    """pattern_cosine: before, the words of all clauses were shuffled, and fields and norms joined to them."""
    plan = run(spark, SF, "pattern_cosine")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
