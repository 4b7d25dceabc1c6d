import random

import pytest
from pyspark.sql import functions as F

from vellum.operators.joins import asof_join, first_mentions, mentioned_before


@pytest.mark.parametrize("heavy", [10**6, 7, 1])
def test_asof_equals_a_loop(spark, heavy):
    """One key with most rows, ties in time, missing keys and times, alike rows, a tolerance."""
    r = random.Random(heavy)
    key = lambda: r.choice(["a", "a", "a", "a", "b", "c", None])
    left = [(key(), r.choice([*range(60), None]), n // 2) for n in range(200)]
    right = [(key(), r.choice([*range(0, 60, 3), None]), n, None if n % 9 == 0 else "x") for n in range(60)]
    want = []
    for k, t, n in left:
        fit = [(u, m, s) for q, u, m, s in right if k is not None and q == k and t is not None and u is not None and u <= t]
        top = max(fit, key=lambda x: x[:2], default=None)
        want.append((k, t, n, *(top if top and t - top[0] <= 10 else (None, None, None))))
    l, q = spark.createDataFrame(left, "k string, t long, n int"), spark.createDataFrame(right, "k string, t long, n int, s string")
    got = asof_join(l, q, ["k"], "t", F.lit(10), heavy=heavy)
    assert got.columns == ["k", "t", "n", "right_t", "right_n", "right_s"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert asof_join(l.limit(0), q, ["k"], "t", heavy=heavy).count() == 0
    assert asof_join(l, q.limit(0), ["k"], "t", heavy=heavy).where("right_t IS NOT NULL").count() == 0


def test_mentions_meet_by_equal_keys(spark):
    texts = spark.createDataFrame([("d", 3, "fig 2 and fig 1"), ("d", 1, "fig 2"), ("e", 1, "none"), ("d", 2, None)], "doc string, pos int, text string")
    index = first_mentions(texts, "doc", "pos", F.regexp_extract_all("text", F.lit(r"fig (\d+)"), F.lit(1)))
    items = spark.createDataFrame([("d", 2, "2"), ("d", 1, "2"), ("d", 9, "1"), ("e", 5, "1")], "doc string, pos int, term string")
    got = mentioned_before(items, index, "doc", "pos")
    assert {(r.doc, r.pos, r.term): r.first for r in got.collect()} == {("d", 2, "2"): 1, ("d", 1, "2"): None, ("d", 9, "1"): 3, ("e", 5, "1"): None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment_equals_a_loop(spark):
    from vellum.operators import joins

    r = random.Random(3)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 12)))
    texts = [(i, "".join(word() for _ in range(r.randint(0, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "long " * 300_000 + "the very end of it, which is found"), (93, "ab")]
    cuts = [t[k : k + n] for _, t in texts[:40] if t for k in [r.randint(0, max(len(t) - 5, 0))] for n in (1, 3, 8, 22, 23, 30, 60)]
    patterns = list(enumerate([*cuts, "absent from all of them, certainly", "", None, "the very end of it, which is found", "x"]))
    got = joins.containing(spark.createDataFrame(patterns, "id long, text string"), spark.createDataFrame(texts, "id long, text string").repartition(3))
    want = {(i, j) for i, p in patterns if p for j, t in texts if t and p in t}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 300


def test_minimisers_are_few(spark):
    import numpy as np

    from vellum.operators import joins

    data = bytes(np.random.default_rng(0).integers(97, 123, 100_000, dtype=np.uint8))
    assert len(joins.minimisers(data)) < len(data) / 5
    step, joins.STEP = joins.STEP, 1000
    try:
        assert (joins.minimisers(data) == (lambda x: x)(np.unique(np.concatenate([joins.minimisers(data[at : at + 2000]) for at in range(0, 100_000, 1000)])))).all()
    finally:
        joins.STEP = step
