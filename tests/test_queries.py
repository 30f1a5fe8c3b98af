"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations pages events orders lineitem part".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET enable_progress_bar = false")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_tables_with_runs_and_ids(spark, tmp_path):
    roles = ["user", "user", "assistant", "assistant", "user", "user", "assistant", "user"]
    talk = [(c, n + c, r, "t") for c in (1, 4) for n, r in enumerate(roles)]
    docs = [(1, "Follow QSP0401 and iso 13485:2016\nnone\n21 CFR  Part 820 and MDD, mdd", "en", "s"), (2, "QSP0401x", "en", "s")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in ("conversations", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, least in (("q_parallel_turns", 2), ("q_line_refs", 2)):
        df = registry.QUERIES[name](spark, str(tmp_path))
        got = sorted(tuple(norm(v) for v in r) for r in df.collect())
        want = sorted(tuple(norm(v) for v in r) for r in c.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall())
        assert got == want and len(got) >= least, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "name"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
