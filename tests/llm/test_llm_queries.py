"""The registered queries over the smallest tables, and those with SQL against it."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from lakeweave.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    rows = df.collect()
    table = {"op7_media": None, "op8_html": "pages", "op10_urls": "pages"}.get(name, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        cur = con.execute(queries.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(str, cur.fetchall())) == sorted(map(str, df.select(names).toPandas().itertuples(index=False, name=None)))
