"""Every query with oracle SQL gives what the SQL gives; every query gives rows; partitioning doesn't matter."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from vellum import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"logic_issues"}


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 9)
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, db, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), db.execute(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE) - EMPTY - {"analyze", "analyze_documents"}))
def test_gives_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merge_ignores_partitioning(spark):
    from vellum.fixtures import fixture
    from vellum.operators import report as R

    f = fixture(spark, "fx_issues")
    a, b = (sorted(map(tuple, R.merged(f.repartition(n)).select("doc_id", "issue_id", "position").collect())) for n in (1, 7))
    assert a == b
    once = R.merged(f).drop("position")
    assert sorted(map(tuple, R.merged(once).select("doc_id", "issue_id").collect())) == sorted((x, y) for x, y, _ in a)


@pytest.mark.parametrize("name", ["retrieval_signals", "retrieval_bridged", "retrieval_answer"])
def test_places_of_questions_are_never_broadcast(spark, name):
    """A standard's hints are; the planner must know their size for that."""
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as said:
        Q.QUERIES[name](spark, SF.replace("0.001", "0.1")).explain()
    plan = said.getvalue().splitlines()
    place = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i in (i for i, x in enumerate(plan) if "BroadcastExchange" in x):
        stop = next((j for j in range(i + 1, len(plan)) if place(plan[j]) <= place(plan[i])), len(plan))
        assert not ("conversations.parquet" in "".join(plan[i:stop]) and "Generate explode(array_distinct" in "".join(plan[i:stop]))
