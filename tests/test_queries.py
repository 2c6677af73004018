"""Every query of the reference's own operators against its SQL at the smallest scale, where the test tables are there."""

import os

import duckdb
import pytest

from paperloom.plans import composites as queries

AT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(AT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "pages", "conversations", "events", "part", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{AT}/{t}.parquet')")
    out = queries.QUERIES[name](spark, AT)
    columns = ", ".join(f'"{c}"' for c in out.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_every_item_is_checked(spark, tmp_path):
    """More than 40 items, and ids with a gap."""
    ids = [i for i in range(60) if i != 7]
    spark.createDataFrame([(i, f"alpha beta gamma{i}") for i in ids], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "alpha beta and others" if i % 2 else "nothing alike") for i in range(120)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["grounding_check"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.item_id for r in got} == {i: ids[i % len(ids)] for i in range(120)} and len(got) == 120
