"""The hash embedding against its definition, word by word."""

import hashlib
import math
import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import vector_index as I
from vellum.operators import vectors as V


def by_definition(text, dim=256):
    import re

    words = [w for w in re.findall(r"[^\W_]+", (text or "").lower().replace("ё", "е")) if len(w) >= 2]
    v = [0.0] * dim
    for g in [g for w in words for g in [w, *([w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 4 else [])]]:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        s = int.from_bytes(hashlib.blake2b(("sign::" + g).encode(), digest_size=8).digest(), "big")
        v[h % dim] += (1 if s % 2 == 0 else -1) * (1 + min(len(g), 12) / 12)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else []


def test_hash_embedding_is_as_defined(spark):
    r = random.Random(0)
    words = ["Ёлка", "дом", "a", "ab", "abc", "abcd", "самолёт", "2017", "x_y", "оченьдлинноеслово"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(60)] + ["", None, "a b", "!!", "дом"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {x.i: x.embedding for x in V.embedded(df, "i").collect()}
    for i, t in enumerate(texts):
        want = by_definition(t)
        assert len(got[i]) == len(want) and np.allclose(got[i], want, atol=1e-12)
        assert np.allclose(V.hash_embedding(t or ""), want, atol=1e-12)


def test_memo_is_bounded_and_not_pickled():
    e = V.HashEmbedding(64)
    e.MEMO = 10
    texts = [f"word{i} other{i}" for i in range(50)]
    assert all(np.allclose(a, by_definition(t, 64)) for a, t in zip(e.batch(texts), texts))
    assert len(e.of) <= 14
    assert not pickle.loads(pickle.dumps(e)).of


def test_fallback_and_empty_provider(spark):
    def broken(text):
        raise OSError("no network")

    df = spark.createDataFrame([(1, "дом")], "i int, text string")
    assert np.allclose(V.embedded(df, "i", V.with_fallback(broken)).first().embedding, by_definition("дом"))


def test_rows_of_facts(spark):
    a = spark.createDataFrame(
        [("aku:d:0", "Q", [1.0], "d", ["X", "Y"]), ("aku:d:1", "Q", [], "d", [])],
        "id string, content string, embedding array<double>, document_id string, entities array<string>",
    )
    assert [tuple(x) for x in V.aku_rows(a).select("id", "entry_type", "entities").collect()] == [("aku:d:0", "aku", "X,Y")]
    b = spark.createDataFrame(
        [("bridge:x", "c", [1.0], "x", ["d1", "d2"])],
        "id string, content string, embedding array<double>, entity string, source_document_ids array<string>",
    )
    assert V.bridge_rows(b).select(F.col("source_document_ids")).first()[0] == "d1,d2"


def brute(rows, queries, k, decimals=9):
    """{query: [(similarity, id)]} of plain Python; rows and queries are pairs of id and vector."""

    def cos(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        c = sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0
        return c if math.isfinite(c) else 0.0

    return {q: [(-s, i) for s, i in sorted((-round(cos(v, w), decimals) + 0.0, i) for i, w in rows)[:k]] for q, v in queries if v}


def of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.similarity, r.id))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def mixed_vectors(n=400, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, 12))
    out = [(i, (centres[i % 9] + 0.2 * r.normal(size=12)).tolist()) for i in range(n)]
    copies = [(n + i, out[0][1]) for i in range(n // 2)]  # a third of all rows
    odd = [(9001, None), (9002, []), (9003, [0.0] * 12), (9004, [float("nan")] * 12), (9005, [1.0, 2.0]), (9006, [1e308, 1e308, *([0.0] * 10)])]
    return out + copies + odd


VECTOR = "id long, embedding array<double>"


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def test_index_is_exact_and_prunes_partitions(spark, tmp_path):
    rows = mixed_vectors()
    index = I.build(spark.createDataFrame(rows, VECTOR), str(tmp_path / "i"), 9)
    assert index.rows.sum() == len(rows) and index.rows[-1] == 6 - (9006 in {r.id for r in I.vectors_of(spark, index).where("__list >= 0").collect()})
    queries = [rows[i] for i in (0, 1, 5, 77)] + [(9003, [0.0] * 12), (9005, [2.0, 4.0]), (9001, None), (9002, [])]
    usable = [(i, v if v is None or all(math.isfinite(x) and abs(x) < 1e300 for x in v) else None) for i, v in rows]
    got = of(I.search(index, _queries(spark, queries), 7, probes=1, exact=True, decimals=9))
    same(got, brute(usable, queries, 7))
    assert I.probes_for(index, spark, 3) <= 2
    # clusters are narrow, so a query for one reads one list: the plan names it
    near = I.search(index, _queries(spark, [rows[1]]), 3, probes=1)
    assert len(of(near)[1]) == 3
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(__list" in plan or "PartitionFilters: [__list" in plan


def test_index_recall_of_vectors_without_structure(spark, tmp_path):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    queries = [r for r in rows if r[0] % 50 == 0]
    index = I.build(spark.createDataFrame(rows, VECTOR), str(tmp_path / "i"))
    probes = I.probes_for(index, spark, 10)
    assert 1 < probes < len(index.rows)
    got = of(I.search(index, _queries(spark, queries), 10, probes))
    want = brute(rows, queries, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_index_upsert_and_reset(spark, tmp_path):
    rows, path = mixed_vectors(200), str(tmp_path / "i")
    named = spark.createDataFrame([(i, v, f"t{i}") for i, v in rows], VECTOR + ", text string")
    index = I.build(named, path, 6)
    moved = [(i, [-x for x in v], "new") for i, v in rows[:40] if v] + [(7000, rows[3][1], "new"), (None, rows[3][1], "lost")]
    for _ in range(2):  # twice gives the same
        index = I.upsert(index, spark.createDataFrame(moved + moved[:3], VECTOR + ", text string"))
    now = dict(rows) | {i: v for i, v, _ in moved if i is not None}
    kept = I.vectors_of(spark, index)
    assert sorted(r.id for r in kept.collect()) == sorted(now) and kept.where("text = 'new'").count() == 41
    queries = [rows[i] for i in (0, 3, 50)]
    usable = [(i, v if v is None or all(math.isfinite(x) and abs(x) < 1e300 for x in v) else None) for i, v in now.items()]
    same(of(I.search(index, _queries(spark, queries), 5, probes=1, exact=True, decimals=9)), brute(usable, queries, 5))
    # a list that all rows leave is gone
    everything = spark.createDataFrame([(i, [1.0] * 12, "same") for i in now], VECTOR + ", text string")
    index = I.upsert(index, everything)
    assert (index.rows > 0).sum() == 1 and index.rows.sum() == len(now)
    I.reset(spark, path)
    assert not (tmp_path / "i").exists()
    assert of(I.search(I.build(named.limit(0), path), _queries(spark, queries), 5, exact=True)) == {}
    index = I.upsert(I.opened(spark, path), named.limit(5))  # no centroids yet: all in one list
    assert len(of(I.search(index, _queries(spark, queries), 9, exact=True))[0]) == 5


def test_many_queries_meet_rows_in_blocks(spark, monkeypatch):
    rows = mixed_vectors(90)
    usable = [(i, v) for i, v in rows if i < 9000]
    monkeypatch.setattr(V, "QUERIES", 20)
    monkeypatch.setattr(V, "BLOCK", 16)
    found = V.top_k(_queries(spark, usable), spark.createDataFrame(usable, VECTOR), 4, 9)
    same(of(found), brute(usable, usable, 4))


def test_short_texts_have_a_vector_where_asked(spark):
    df = spark.createDataFrame([(1, "A."), (2, "!!"), (3, "a дом"), (4, " "), (5, "b c")], "i int, text string")
    got = {x.i: x.embedding for x in V.embedded(df, "i", V.HashEmbedding(short=True)).collect()}
    assert {i: len(v) for i, v in got.items()} == {1: 256, 2: 256, 3: 256, 4: 0, 5: 256}
    assert np.allclose(got[3], by_definition("дом"), atol=1e-12) and all(abs(np.linalg.norm(got[i]) - 1) < 1e-9 for i in (1, 2, 5))
    assert pickle.loads(pickle.dumps(V.HashEmbedding(short=True))).short and not V.hash_embedding("A.")


def test_every_text_has_a_vector_where_asked(spark):
    """Two words of one bucket, one weight and opposite signs cancel out; a blank text has nothing to count."""
    e = V.HashEmbedding(every=True)
    first: dict = {}
    for w in (a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"):
        bucket, weight = e._signed(w)
        first.setdefault((bucket, weight), w)
    gone = next(f"{w} {first[b, -x]}" for (b, x), w in first.items() if (b, -x) in first)
    df = spark.createDataFrame([(1, gone), (2, " "), (3, None), (4, "дом"), (5, f"{gone} дом")], "i int, text string")
    got = {x.i: x.embedding for x in V.embedded(df, "i", V.HashEmbedding(short=True, every=True)).collect()}
    assert not V.hash_embedding(gone) and not V.HashEmbedding(short=True)(gone)
    assert all(len(v) == 256 and abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    assert np.allclose(got[4], by_definition("дом"), atol=1e-12) and np.allclose(got[5], by_definition(f"{gone} дом"), atol=1e-12)
    e.STEP = 2  # places are those of the whole batch
    assert np.allclose(e.batch(["дом дом", "x y", gone, "дом"])[2], got[1], atol=1e-12)
    assert pickle.loads(pickle.dumps(e)).every


def test_all_cosines_in_blocks_equal_those_of_pairs(spark, monkeypatch):
    """Null, empty, zero, infinite and differently long vectors are as cosine() has them, whatever the blocks."""
    from vellum.functions.text import cosine

    inf = float("inf")
    x = [[1.0, 2.0], [2.0, 1.0], None, [], [0.0, 0.0], [1.0, None], [1.0, 2.0, 3.0], [inf, 1.0], [float("nan"), 1.0], [1e200, 1e200], [-3.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id int, embedding array<double>")
    q = df.selectExpr("id AS query_id", "embedding")
    pairs = q.withColumnRenamed("embedding", "q").join(df).select("query_id", "id", F.round(cosine(F.col("q"), F.col("embedding")), 6))
    want = sorted(map(repr, map(tuple, pairs.collect())))
    for portion in (4, 2048):
        monkeypatch.setattr(V, "QUERIES", portion)
        assert sorted(map(repr, map(tuple, V.cosines(q, df, 6).collect()))) == want


def test_all_cosines_need_no_shuffle(spark):
    """Vectors and queries are written once and meet without copies of them being dealt out."""
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id int, embedding array<double>").repartition(3)
    found = V.cosines(df.selectExpr("id AS query_id", "embedding"), df, 6)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 81
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(found.collect()) == sorted(V.cosines(df.selectExpr("id AS query_id", "embedding"), df, 6).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_products_of_few_queries_at_a_time(monkeypatch):
    """The rows found don't depend on how many queries a task multiplies at once; its products never grow with all of them."""
    from vellum.operators import vectors

    r = np.random.default_rng(3)
    q, x = r.normal(size=(50, 8)), r.normal(size=(300, 8))
    mats = vectors._matrices([(i, v.tolist()) for i, v in enumerate(q)])
    one = vectors._best(mats, list(range(300)), x.tolist(), 5, 6)
    seen = []
    monkeypatch.setattr(vectors, "TOGETHER", 7)
    monkeypatch.setattr(np, "zeros", lambda shape, *a, f=np.zeros, **k: seen.append(shape) or f(shape, *a, **k))
    assert vectors._best(mats, list(range(300)), x.tolist(), 5, 6) == one
    assert max(shape[0] for shape in seen if isinstance(shape, tuple)) == 7
