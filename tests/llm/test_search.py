"""Clustering, spelling variants and nearest neighbours against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import exponion, ivf_pq, spelling


def vectors(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, v, "x", 1, 2.0, "y") for i, v in rows], "vec_id long, embedding array<double>, block string, n int, dim double, uid string",
    ).repartition(3)


ODD = [(None, [0.5, 0.25, 0.125]), (70, None), (71, []), (72, [1.0, None, 0.0]), (73, [float("nan"), 0.0, 1.0]), (74, [math.inf, 0.0, 0.0]), (75, [1.0, 2.0]), (76, [0.0, 0.0, 0.0])]


def lloyd(rows, k, rounds, dim, seed=3):
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def of(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [of(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    best = [of(v) for _, v in kept]
    sums = Counter()
    for d, j in best:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(kept, best)), key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_op11_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(exponion, "BLOCK", 7)
    r = random.Random(seed)
    spread = (1.0, 0.004, 50.0)[seed]  # the second has many ties and equal centroids
    rows = [(i, [r.uniform(-spread, spread) for _ in range(3)]) for i in range(150)] + ODD
    rows += [(5, rows[5][1]), (5, [9.0, 9.0, 9.0]), *((200 + i, [0.1, 0.1, 0.1]) for i in range(60))]
    got = exponion.clusters(vectors(spark, rows), k=6, rounds=5, dim=3).collect()
    assert sorted((tuple(x) for x in got), key=repr) == lloyd(rows, 6, 5, 3)


def test_op11_few_rows(spark):
    rows = [(1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5])]
    assert sorted(map(tuple, exponion.clusters(vectors(spark, rows), dim=3).collect())) == lloyd(rows, 8, 10, 3)
    assert exponion.clusters(vectors(spark, []), dim=3).collect() == []
    assert exponion.clusters(vectors(spark, [(1, [2.0**17, 0.0, 0.0])]), dim=3).collect() == []


def test_exponion_scans_less_than_all():
    r = np.random.default_rng(0)
    c = r.integers(-1000, 1000, (50, 4))
    x = (c[r.integers(0, 50, 2000)] + r.integers(-20, 20, (2000, 4))).astype("<i4")
    own, upper, lower = np.zeros(2000, np.int32), np.full(2000, np.inf), np.zeros(2000)
    assert exponion.Centroids(c).search(x, own, upper, lower) > 2000 * 25  # nothing is known yet
    new = c + r.integers(-3, 4, c.shape)
    exponion.moved(own, upper, lower, np.sqrt(exponion.squared(new, c)))
    assert exponion.Centroids(new).search(x, own, upper, lower) < 2000 * 10
    every = np.stack([exponion.squared(x, m) for m in new], axis=1)
    assert (own == every.argmin(axis=1)).all()
    assert (upper >= np.sqrt(every.min(axis=1))).all() and (lower <= np.sqrt(np.sort(every, axis=1)[:, 1])).all()


def test_op11_rounds_shuffle_no_vectors(spark):
    store = exponion._Bucketed(spark, 3)
    name, blocks = store.write(spark.range(50).select(F.col("id").alias("block"), F.lit("v").alias("v")))
    other, state = store.write(spark.range(50).select(F.col("id").alias("block"), F.lit("s").alias("state")))
    plan = blocks.hint("merge").join(state, "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    store.drop(name)
    store.drop(other)
    assert not spark.catalog.tableExists(name)


def near(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        of = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form = of[0] if of and n[of[0]] >= 2 * n[w] else None
        out[w] = [w, n[w], len(of), form, n[form] if form else None]
    for w, r in out.items():
        root = w
        while out[root][3]:
            root = out[root][3]
        r.append(root)
    return sorted((tuple(r[:6]) for r in out.values()), key=repr)


@pytest.mark.parametrize("group", [2000, 4])
def test_op12_brute_force(spark, group, monkeypatch):
    """With keys of at most four words too, so that most are cut again and again."""
    monkeypatch.setattr(spelling.near_words, "__defaults__", (group,))
    r = random.Random(group)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 3000, "x" * 2999]
    rows = []
    for i in range(120):
        words = []
        for _ in range(50):
            w = stems[min(int(r.expovariate(0.08)), len(stems) - 1)]
            p = r.randint(0, len(w))
            words.append(r.choice([w, w, w, w[:p] + r.choice("abß") + w[p:], w[:p] + w[p + 1 :], w[:p] + "c" + w[p + 1 :]]))
        rows.append((i // 2 if i % 7 else None, r.choice([" ", ", ", "\n", "9"]).join(words).replace("a", r.choice("aA"))))
    rows += [(900, None), (901, ""), (902, "ÀÉÎÕ÷× Àéîõü Àéîõü Àéîõü àéîõü naïve"), *((2000 + i, "chain" + "s" * (i % 4)) for i in range(40)), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, "q", 1, True, 2) for d, t in rows], "doc_id long, text string, word string, n int, longer boolean, size int").repartition(4)
    got = sorted((tuple(x) for x in spelling.grouped(df).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)
    want = variants(rows)
    assert got == want and sum(w[3] is not None for w in want) > 10
    assert spelling.grouped(df.limit(0)).collect() == []


def exact(rows, every, k):
    use = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, v) in enumerate(use):
        if q is not None and q % every == 0:
            d = sorted((math.dist(v, w), i is None, i or 0) for m, (i, w) in enumerate(use) if m != n and len(w) == len(v))
            out += [(q, rank, None if none else i, round(s, 9)) for rank, (s, none, i) in enumerate(d[:k], 1)]
    return sorted(out, key=repr)


def test_op13_small_tables_are_exact(spark):
    """Hot vectors, ties, repeated rows and ids, other lengths: whatever the shortlist holds is everything here."""
    r = random.Random(0)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(30)] + ODD
    rows += [(100 + i, [0.5, 0.5, 0.0]) for i in range(50)] + [(5, rows[5][1]), (5, rows[5][1]), (10, [3.0, 3.0, 3.0]), (300, [1.0, 5.0]), (301, [1e200, 1e200, 0.0]), (305, [1.0, 5.0])]
    got = ivf_pq.neighbours(vectors(spark, rows), every=5, k=4).collect()
    assert sorted(((x.query_id, x["rank"], x.vec_id, round(x.score, 9)) for x in got), key=repr) == exact(rows, 5, 4)
    assert ivf_pq.neighbours(vectors(spark, [])).collect() == []
    assert ivf_pq.neighbours(vectors(spark, ODD[1:])).collect() == []


@pytest.mark.parametrize("sample", [32_768, 900])
def test_op13_recall(spark, sample):
    """Uniform directions, the hardest case, and clusters with a third of all rows in one; large lists are cut into parts."""
    r = np.random.default_rng(sample)
    x = r.normal(size=(4000, 24))
    x[:1400] = x[0] + 0.05 * r.normal(size=(1400, 24))
    x[1400:2000] = x[1400]
    got = ivf_pq.neighbours(vectors(spark, list(enumerate(x.tolist()))), sample=sample).toPandas()
    hit = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(4000), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.abs(own.score.to_numpy() - d[own.vec_id]).max() < 1e-12
        hit += len(set(own.vec_id) & set(true.tolist()))
    assert hit >= 0.9 * 400
