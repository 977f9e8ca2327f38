"""Every query with an SQL equivalent gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from robustclust.operators import estimators
from robustclust.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["kmeanspp_init", "kmedianpp_init"])
@pytest.mark.parametrize("n", [400, 6000])
def test_seeding_gives_the_drawn_ids(spark, tmp_path, name, n):
    """Every vector is held by two ids, in small and large tables."""
    vector = f"array(CAST(id % {n // 2} AS FLOAT), CAST(id % {n // 2} * 7 % 11 AS FLOAT))"
    spark.range(n).selectExpr("id AS vec_id", f"{vector} AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert len(got) == 4 and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["fit_kzmeans", "fit_kzmedian"])
def test_coreset_estimators_run_at_the_default_accuracy(spark, monkeypatch, name):
    fit, seen = estimators.DistributedKZLp.fit, []
    monkeypatch.setattr(estimators.DistributedKZLp, "fit", lambda self, points: seen.append(self.epsilon) or fit(self, points))
    assert registry.queries()[name](spark, FOLDER).count() == 6 and seen == [estimators.DistributedKZLp.epsilon]


@pytest.mark.parametrize("n", [3, 10_050])
def test_a_cover_is_of_the_whole_table(spark, tmp_path, n):
    """More rows than a site holds, and fewer than there are rounds."""
    spark.range(n).selectExpr("id AS vec_id", "array(CAST(id * 7919 % 501 AS FLOAT) * 0.3F, CAST(id % 7 AS FLOAT) * 1.1F) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.queries()["charikar_cover_fixed_r"](spark, str(tmp_path)).orderBy("pick").collect()
    want = con.execute(registry.oracle_sql()["charikar_cover_fixed_r"] + " ORDER BY pick").fetchall()
    assert len(want) == 4 and [tuple(r) for r in got] == want
