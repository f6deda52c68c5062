"""Every query against its SQL on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lakeweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, Decimal)):
        return None if math.isnan(x) else round(float(x), 5)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda cols, r: repr([plain(r[cols.index(c)]) for c in sorted(cols)])
    assert sorted(key(df.columns, r) for r in rows) == sorted(key(names, r) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["threshold_sweep", "macro_f05_testlike", "miss_profile"])
def test_true_links_are_counted(spark, tmp_path, monkeypatch, name):
    """F14 F15 F19: a group of copies has true links by the square of its size; the metrics form none of those pairs."""
    from lakeweave.plans import linkage

    texts = ["one two three four five six seven eight 9"] * 90 + [f"some words {k % 7} of number {k % 5} and more {k % 3}" for k in range(60)] + [None, None, "", "", "x", "x", "x"]
    langs = [["en", "fr", None][k % 17 // 8] for k in range(len(texts))]
    spark.createDataFrame(list(zip(range(len(texts)), texts, langs)), "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def formed(*_):
        raise AssertionError("all true pairs are formed")

    monkeypatch.setattr(linkage, "_truth", formed)
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    want = [tuple(plain(x) for x in r) for r in cur.fetchall()]
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got
