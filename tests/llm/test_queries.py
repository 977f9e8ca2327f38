import os

import duckdb
import pytest

from robustclust.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


#: queries of which SQL can express some columns
PARTIAL = {
    "op4_secrets": r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op6_mix_pivotal": r"""
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size
FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)""",
    "op9_media_avi": """
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(t || repeat(' ', CAST(m - n AS BIGINT))) AS payload_sha256
FROM (SELECT *, greatest(ceil(n / 192.0), 1) * 192 AS m FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents))""",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(PARTIAL))
def test_columns_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = con.execute(PARTIAL[name]).df()
    got = queries.queries()[name](spark, FOLDER).select(*want.columns).collect()
    assert sorted(map(repr, want.astype(object).itertuples(index=False, name=None))) == sorted(repr(tuple(r)) for r in got)
