"""The whole pipeline against plain Python on a small corpus with toxic, copied, repeated and benchmark texts."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import compression, packing, simhash
from vellum.llm.common import discard, made, written

SYLLABLES = "ka lo mi ne ru sa to vi wu ze bra cle dro fli gno".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def corpus(r):
    def text(n):
        return " ".join(word(r) for _ in range(n))

    passage, item = text(30), [text(20) for _ in range(4)]
    rows = []
    for i in range(320):
        t = text(r.randint(20, 60))
        if i % 4 == 1:
            t += " nasty vile scum"
        elif i % 16 == 2:
            t = t + " " + passage + " " + text(5)
        elif i % 16 == 6:
            t = text(8) + " " + item[i % 3] + " " + text(8)
        elif i % 16 == 10 and rows:
            t = rows[-2][1] + " end"
        elif i % 16 == 14 and rows:
            t = rows[r.randrange(0, len(rows), 4)][1]
        rows.append((i, t))
    return [*rows, (1000, None), (1001, ""), (1002, text(6000))], item


def repeats_removed(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        out.append((d, "".join(c for c, g in zip(t, gone) if not g)))
    return out


def leaks(t, items):
    def shingles(x):
        w = [y for y in re.split(r"[^\w]|_", x.lower()) if y]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = shingles(t)
    return any(10 * len(shingles(x) & own) >= 8 * len(shingles(x)) for x in items)


@pytest.fixture
def made_input(spark, tmp_path):
    rows, items = corpus(random.Random(3))
    spark.createDataFrame([(d, t, "xx", f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, 1, int(d % 4 == 1)) for d, _ in rows if d < 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, labels, items, str(tmp_path)


def test_run_equals_brute_force(spark, made_input):
    rows, labels, items, path = made_input
    text = {d: t or "" for d, t in rows}
    learn = [(text[d], y) for d, _, y in sorted(((d, q, y) for d, q, y in labels if zlib.crc32(str(d).encode()) % 4 != 2), key=lambda x: (hash((x[0], 0)) & 0xFFFF, x[0], x[2], text[x[0]]))]
    model = compression.fit([(b" ".join(compression.words(t)), y) for t, y in learn], [sum(y == k for _, y in learn) for k in (0, 1)])
    score = model.scores([t for t in text.values()])
    kept = [(d, t) for (d, t), p in zip(text.items(), score) if p < 0.3]
    assert sum(d % 4 == 1 for d, _ in kept if d < 1000) <= 5 and sum(d % 4 != 1 for d, _ in kept if d < 1000) >= 235
    prints = np.array([simhash.fingerprint(t) for _, t in kept], np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    group = simhash.united(np.arange(len(kept)), a, b)
    kept = [x for i, x in enumerate(kept) if group[i] == i]
    kept = [(d, t) for d, t in repeats_removed(kept) if not leaks(t, items)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for d, x in kept:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    before = made()
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    assert len({x.sequence_id for x in got}) == -(-sum(w[3] for w in want) // 4096)
    assert 200 < len(kept) < 280 and made() > before


def test_stages_keep_the_columns(spark, made_input):
    path = made_input[-1]
    docs = spark.read.parquet(path + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), path).count() == 0


def test_discard_deletes_only_what_is_named(spark):
    df = spark.range(3)
    first = made()
    a, b = written(df, "a"), written(df, "b")
    discard(spark, first, first + 1)
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)path|file|not exist"):
        spark.read.parquet(a.inputFiles()[0]).count()
