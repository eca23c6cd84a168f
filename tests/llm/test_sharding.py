import duckdb

from lexsieve.llm.rendezvous import assign_shards, assign_shards_sql


def test_shares_moves_and_sql(spark):
    df = spark.range(0, 20_000).toDF("doc_id")
    weights = {0: 1.0, 1: 1.0, 2: 2.0}
    before = dict(map(tuple, assign_shards(df, weights).collect()))
    share = [sum(s == k for s in before.values()) / len(before) for k in weights]
    assert abs(share[0] - 0.25) < 0.02 and abs(share[2] - 0.5) < 0.02
    after = dict(map(tuple, assign_shards(df, weights | {3: 1.0}).collect()))
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 3 for k in moved) and abs(len(moved) / len(before) - 0.2) < 0.02
    documents = df.toPandas()  # noqa: F841
    assert dict(duckdb.sql(assign_shards_sql("documents", weights)).fetchall()) == before


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "doc_id bigint, shard string").selectExpr("*", "3 score", "null text")
    rows = [tuple(r) for r in assign_shards(df, {5: 1.0, 6: 1.0}).collect()]
    assert rows[1] == (None, None) and rows[0] == rows[2] and rows[0][1] in (5, 6)
    assert assign_shards(df.limit(0), {0: 1.0}).count() == 0
    got = duckdb.sql(assign_shards_sql("(VALUES (1::BIGINT), (NULL), (1)) t(doc_id)", {5: 1.0, 6: 1.0})).fetchall()
    assert sorted(map(str, got)) == sorted(str(r) for r in rows)
