"""The operators against brute force on small inputs with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import chat, compression, decontaminate, forest, html_text, nbsvm, packing, phrases, simhash, suffix_array
from vellum.llm.common import components

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(seed=0, n=40):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(5, 150))) for _ in range(10)]
    rows = []
    for i in range(n):
        t = base[i % 10]
        kind = r.randint(0, 5)
        if kind == 1:
            t = t[: len(t) // 2] + " changed " + t[len(t) // 2 :]
        elif kind == 2:
            t = t + "\n" + base[(i + 3) % 10]
        elif kind == 3:
            t = "  ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(60))
        rows.append((i * 3 - 5, t))
    rows += [
        (1000, None), (1001, ""), (1002, "  \n "), (1003, "one two"), (1004, "a" * 300), (1005, "b" + "a" * 200),
        (None, base[0]), (None, base[1]), (4, base[2]), (4, base[2]), (2000, " ".join(WORDS * 400)),
    ]
    return rows


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(d, t, "x", 1, "y", 2.0) for d, t in rows],
        "doc_id long, text string, id string, block int, bytes string, shard double",
    ).repartition(3)


def by_smaller(rows, units, length):
    """Per row: (units, removed flags), windows of smaller ids removed; null is the largest id."""
    key = [2**63 - 1 if d is None else d for d, _ in rows]
    first = {}
    for k, (_, t) in zip(key, rows):
        u = units(t)
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, (_, t) in zip(key, rows):
        u = units(t)
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[tuple(u[i : i + length])] < k:
                gone[i : i + length] = [True] * length
        out.append((u, gone))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_op1_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.dedup_substrings(frame(spark, rows)).collect()),
        key=repr,
    )
    want = []
    for (d, _), (u, gone) in zip(rows, by_smaller(rows, lambda t: (t or "").encode(), 50)):
        spans = sum(g and not p for g, p in zip(gone, [False] + gone))
        want.append((d, len(u), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()))
    assert got == sorted(want, key=repr)


def test_op1_text_is_utf8_and_carries_columns(spark):
    rows = [(1, "é" * 40 + "x"), (2, "ab" + "é" * 40)]
    out = suffix_array.without_repeats(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "id", "block", "bytes", "shard"]
    assert {r.doc_id: (r.text, r.id, r.shard) for r in out.collect()} == {1: ("é" * 40 + "x", "x", 2.0), 2: ("ab", "x", 2.0)}


def test_common_prefixes_equal_sorting():
    r = np.random.default_rng(3)
    for least in (10, 25):
        sym = np.r_[r.integers(1, 4, 400), r.integers(1, 4, 60).repeat(2), np.zeros(1, int)].astype(np.int16)
        order, prefix = suffix_array.common_prefixes(sym, least)
        for i in range(1, len(order)):
            a, b = sym[order[i - 1] :], sym[order[i] :]
            n = min(len(a), len(b))
            d = np.flatnonzero(a[:n] != b[:n])
            true = int(d[0]) if len(d) else n
            assert prefix[i] == (true if true < least else -1)


@pytest.mark.parametrize("seed", [0, 1])
def test_op4_brute_force(spark, seed):
    import re

    rows = corpus(seed)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.dedup_phrases(frame(spark, rows)).collect()), key=repr)
    want = []
    for (d, _), (u, gone) in zip(rows, by_smaller(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), 50)):
        want.append((d, len(u), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(u, gone) if not g).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_op8_brute_force(spark):
    import xxhash

    rows = corpus(5)

    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in rows]
    key = [2**63 - 1 if d is None else d for d, _ in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if key[i] == key[j] < 2**63 - 1 or (prints[i] ^ prints[j]).bit_count() <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    low = {c: min(k for k, x in zip(key, comp) if x == c) for c in set(comp)}
    want = sorted(((d, p, low[c] if low[c] < 2**63 - 1 else None) for (d, _), p, c in zip(rows, prints, comp)), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == want


def test_near_duplicate_stage_keeps_unlike_rows(spark):
    import corpus_pipeline

    r = random.Random(7)
    t = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(8)]
    rows = [
        (5, t[0]), (900, t[1]), (None, t[0]), (None, t[1]), (None, t[2]), (None, t[3]), (None, t[3]), (7, t[4]),
        (7, t[5]), (7, t[5]), (6, t[5]), (None, None), (3, ""),
    ]
    rows += corpus(5)
    prints = [simhash.fingerprint(x) for _, x in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    key = [2**63 - 1 if d is None else d for d, _ in rows]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark, rows).columns
    kept = [(x.doc_id, x.text) for x in kept.collect()]
    at = [next(g for g, y in zip(group, rows) if y == x) for x in kept]
    assert sorted(at) == sorted(set(group))
    assert all((2**63 - 1 if d is None else d) == min(k for k, y in zip(key, group) if y == g) for (d, _), g in zip(kept, at))
    assert {(5, t[0]), (900, t[1]), (None, t[2]), (None, t[3]), (7, t[4]), (6, t[5])} <= set(kept)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_op8_finds_all_links(spark, bucket):
    """Random, near and hot fingerprints: links of all buckets, dealt anew or not, give the components of brute force."""
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    flips = [np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64) for _ in range(4)]
    near = base ^ flips[0] ^ flips[1] ^ flips[2]
    hot = (r.integers(0, 2**48, 300, dtype=np.uint64) << np.uint64(16)) | np.uint64(0xABCD)
    line = np.bitwise_xor.accumulate(np.r_[np.uint64(77), np.repeat(np.uint64(1) << np.arange(20, dtype=np.uint64), 1)])
    fp = np.unique(np.r_[base, near, near ^ flips[3], hot, hot ^ (np.uint64(7) << np.uint64(40)), line])
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(5)
    links = [(q.a, q.b) for q in simhash.linked(df, bucket=bucket).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 60 for a, b in links)
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = simhash.united(np.arange(len(fp)), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert (got == simhash.united(np.arange(len(fp)), a, b)).all() and len(set(got.tolist())) < len(fp)
    if bucket == 8:
        sizes = {q.key: q["count"] for q in simhash.buckets(df, bucket).groupBy("key").count().collect()}
        assert max(sizes.values()) < 100  # the 600 of one block are dealt anew


def test_components_with_hubs(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, i) for i in range(150, 400)] + [(600, 601)], "a long, b long")
    got = {q.node: q.component for q in components(e, hub=20).collect()}
    assert got == {**dict.fromkeys([*range(400), 500], 0), 600: 600, 601: 600}


def test_largest_long_stays(spark):
    """A doc_id of 2^63 - 1 isn't null in the results, and null isn't it."""
    big = 2**63 - 1
    rows = frame(spark, [(big, "a b c d e f"), (None, "g h i j k l m"), (None, "n o p q r")])
    for out in (suffix_array.dedup_substrings(rows), phrases.dedup_phrases(rows), simhash.near_duplicates(rows), packing.packed(rows)):
        assert sorted(map(repr, (q.doc_id for q in out.collect()))) == sorted(map(repr, (big, None, None)))
    assert {(q.doc_id, q.component_id) for q in simhash.near_duplicates(rows).collect()} == {(big, big), (None, None)}


def test_one_row_of_each_takes_maps(spark):
    rows = spark.createDataFrame(
        [(1, "a b c d", {"k": 2}), (1, "a b c d", {"k": 1}), (None, "a b c d", {"k": 0}), (None, "x y z w v u", {"k": 5})],
        "doc_id long, text string, m map<string,int>",
    )
    got = sorted(((q.doc_id, q.text, q.m["k"]) for q in simhash.one_row_of_each(rows).collect()), key=repr)
    assert got == [(1, "a b c d", 1), (None, "x y z w v u", 5)]


def test_op4_tells_words_of_one_polynomial_hash_apart(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2^64."""
    w = "ab"
    for _ in range(10):
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(60)]
    rows = [
        (2, " ".join([*around[:30], w, *around[30:]])), (5, " ".join([*around[:30], other, *around[30:]])),
        (9, " ".join([*around[:30], other, *around[30:]])),
    ]
    got = {q.doc_id: q.n_removed for q in phrases.dedup_phrases(frame(spark, rows)).collect()}
    assert got == {2: 0, 5: 0, 9: 61}
    bytes_ = {
        q.doc_id: q.n_removed for q in suffix_array.dedup_substrings(frame(spark, [(1, w + "x" * 20), (2, "y" * 20 + other)])).collect()
    }
    want = by_smaller([(1, w + "x" * 20), (2, "y" * 20 + other)], lambda t: t.encode(), 50)
    assert bytes_ == {1: 0, 2: sum(want[1][1])}


def test_equal_texts_compares_bytes():
    from vellum.llm import anchors

    data = np.frombuffer(b"aaabbbaaaccc", np.uint8)
    first, of = anchors.equal_texts(data, np.array([0, 3, 6, 9, 6]), np.array([3, 3, 3, 3, 2]), np.zeros(5, np.uint64))
    assert of[0] == of[2] and len(set(of.tolist())) == len(first) == 4


def test_clean_judges_rows_by_their_own_text(spark):
    item = "one two three four five six seven"
    rows = [
        (None, "x " + item + " y"), (None, "clean text of its own here"), (3, item),
        (3, "another clean text that shares the id"), (2**63 - 1, "kept"),
    ]
    bench = spark.createDataFrame([(1, item), (None, "nothing like it at all here")], "item_id long, text string")
    got = {(q.doc_id, q.text) for q in decontaminate.clean(frame(spark, rows), bench).collect()}
    assert got == {rows[1], rows[3], rows[4]}


def test_op2_page_shapes():
    def text(html):
        p = html_text.Page(html)
        v = p.votes()
        return p.text(v[0][0] if v else None)

    long = "<p>" + "many words said below the line " * 20 + "</p>"
    assert text(
        '<body><form id=f><div class=header>top</div><article><p>The text.</p></article><form><input> Find</form></form></body>'
    ) == "The text."
    assert text('<article><p>Good <span class="ad"><span>x</span> BUY NOW</span> text</p></article>') == "Good text"
    assert text('<article><p>find the <span class="search-term">word</span> here</p></article>') == "find the word here"
    assert text("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>") == "let x=1 be"
    assert text(
        '<article><p class="header">A</p><figure class="related-figure"><figcaption>B</figcaption></figure><blockquote class="share-quote">C</blockquote><p class="ad">no</p><div class="share-buttons">no</div><p>D</p></article>'
    ) == "A\nB\nC\nD"
    assert text(f'<body><article><p>short and good</p></article><div class="advert">{long}</div></body>') == "short and good"
    assert text('<p>foo<script>var a="<p>no</p>"</script>bar <svg><text>no</text></svg> baz</p>') == "foobar baz"
    assert text("<p>a</p><p>b <!-- c") == "a\nb"


def test_op2_long_and_deep_pages():
    import time

    start = time.time()
    assert html_text.Page("<div>" * 100_000 + "text" + "</div>" * 100_000).text(None) == "text"
    assert html_text.Page("<div>" * 20_000 + "</p>" * 50_000 + "x").text(None) == "x"
    assert html_text.Page("<p '" * 50_000).text(None).startswith("<p '")
    assert html_text.Page("<span class=ad>" * 50_000 + "x").text(None) == ""
    assert time.time() - start < 30


def test_op2_hosts_vote(spark):
    """Brute force of the vote: the path with the largest sum of shares wins on every page of the host."""
    page = '<body><div class="{}"><p>{}</p></div><div class="{}"><p>{}</p></div></body>'
    rows = [(i, "http://a.com/x", page.format("one", "w " * 30, "two", "v " * (20 if i else 60)), 1) for i in range(5)]
    rows += [(10, None, rows[0][2], 1), (10, None, rows[0][2], 1), (11, "http://b.com", "w", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = html_text.main_text(df).collect()
    total = {}
    for _, url, html, _ in rows:
        for p, s in html_text.Page(html).votes():
            total.setdefault(url, {}).setdefault(p, []).append(s)
    for q in got:
        best = max(total[q.url].items(), key=lambda x: (round(sum(x[1]), 6), x[0]))[0]
        assert q.path == best and q.text == html_text.Page(next(h for i, _, h, _ in rows if i == q.page_id)).text(best)
    assert len(got) == len(rows)


def test_op2_equal_votes_and_no_url(spark):
    """Of two paths with equal votes the greater wins for every page of the host; pages without a url are a host of their own."""
    page = '<body><div class="{}"><p>same words</p></div></body>'
    rows = [(i, None, page.format(("one", "two")[i % 2]), i, "h") for i in range(4)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, votes int, host string")).collect()
    total = {}
    for _, _, html, *_ in rows:
        for p, s in html_text.Page(html).votes():
            total[p] = total.get(p, 0) + s
    top = max(total, key=lambda p: (round(total[p], 6), p))
    assert len(set(total.values())) < len(total)
    assert {q.path for q in got} == {top} and {q.text for q in got} == {"same words"} and {q.url for q in got} == {None}


@pytest.mark.parametrize("op", [nbsvm, compression])
def test_a_very_long_row_leaves_its_class(spark, op, monkeypatch):
    """The first row of a class, in the sample's order, is longer than the sample's bytes."""
    from vellum.llm import common

    r = random.Random(1)
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(30)) + (" nasty vile" if i % 2 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    order = [x.doc_id for x in labels.where("doc_id % 2 = 1").where(~common.held_out()).orderBy(F.xxhash64("doc_id")).limit(3).collect()]
    for i in order[:2]:
        docs[i] = (i, "alpha nasty beta vile " * 1500)
    rows, counts = common.labelled_sample(frame(spark, docs), labels, "toxic", 100, 20_000)
    got = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("y").collect()
    assert [q.y for q in got] == [0, 1] and min(q.n for q in got) > 30 and max(q.bytes for q in got) <= 20_000
    only, _ = common.labelled_sample(frame(spark, docs).where(F.col("doc_id").isin(order[:2])), labels, "toxic", 100, 20_000)
    assert only.count() == 1
    scores = {q.doc_id: q.score for q in op.scored(frame(spark, docs), labels).collect()}
    assert min(scores[i] for i in range(1, 300, 2)) > max(scores[i] for i in range(0, 300, 2))


def test_op6_held_out_rows():
    """The figures of the README: rows that aren't learned from, every window compressed."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    label = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [(x["doc_id"], x["text"] or "", label[x["doc_id"]]) for x in pq.read_table(f"{sf}/documents.parquet").to_pylist() if x["doc_id"] in label]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    learn = sorted((x for x, h in zip(rows, held) if not h), key=lambda x: (hash((x[0], 0)) & 0xFFFF, x[0]))
    m = compression.fit([(b" ".join(compression.words(t)), y) for _, t, y in learn], [sum(y == k for *_, y in learn) for k in (0, 1)])
    p = m.scores([t for (_, t, _), h in zip(rows, held) if h])
    y = np.array([y for (*_, y), h in zip(rows, held) if h])
    assert (p[y == 1] >= 0.3).mean() > 0.7 and (p[y == 0] >= 0.3).mean() < 0.02


def test_op6_learns_two_words_together():
    r = random.Random(0)
    some = ["w" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    sample = []
    for i in range(2400):
        w, y = [r.choice(some).encode() for _ in range(80)], r.random() < 0.5
        if y:
            w[40:42] = [some[3].encode(), some[7].encode()]
        sample.append((b" ".join(w), int(y)))
    m = compression.fit(sample[:2000], [1000, 1000])
    p = m.scores([t.decode() for t, _ in sample[2000:]])
    assert np.mean((p >= 0.3) == [y == 1 for _, y in sample[2000:]]) > 0.95


def test_op6_windows_are_compressed_together(monkeypatch):
    """One call takes the windows of many texts, and each is as long as if compressed by itself."""
    r = random.Random(4)
    some = ["w" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    texts = ["", " \n", "x", "a b", *(" ".join(r.choices(some, k=r.randint(1, 60))) for _ in range(200)), " ".join(r.choices(some, k=5000)), "y" * 30_000, "z"]
    ordinary, own = " ".join(some).encode(), " ".join(some[10:14]).encode()
    d = compression.Distance(ordinary, own + ordinary)
    single = [k.__self__.compress for k in d._compressors()]
    monkeypatch.setattr(compression, "PORTION", 20_000)
    calls = []
    d.pair = [lambda x, k=k: calls.append(len(x)) or k(x) for k in d._compressors()]
    got, total = d.features(map(compression.words, texts)), 0
    assert len(got) == len(texts)
    for t, row in zip(texts, got):
        w = t.lower().encode().split()
        cut = [b" " + b" ".join(w[i : i + 4]) + b" " if w else b" " for i in range(0, max(len(w) - 1, 1), 3)]
        diff = sorted((max(len(single[0](x + compression.PAD)) - len(single[1](x + compression.PAD)), 0) for x in cut), reverse=True)
        total += len(cut)
        counts = [sum(x >= n for x in diff) for n in compression.THRESHOLDS]
        assert row.tolist() == pytest.approx([*(diff + [0, 0, 0])[:3], *np.log1p(counts), np.log1p(len(w))])
    assert got[:, 0].max() > 0 and sum(calls) == 2 * total and len(calls) < total / 20
    assert len(compression.Model(d, np.zeros(10)).scores([])) == 0


def test_hinge_weights_solve_the_dual():
    """Dual coordinate descent against plain subgradient steps on the same objective."""
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 40, 12)) for _ in range(60)]
    y = np.array([int(3 in f or 7 in f) for f in rows])
    ratio, cost = np.zeros(1 << nbsvm.BITS), np.ones(60)
    ratio[:40] = r.normal(size=40)
    w, bias = nbsvm.hinge_weights(rows, y, ratio, cost, rounds=400)

    def loss(w, bias):
        m = np.array([(2 * k - 1) * (w[f] @ ratio[f] / np.sqrt(len(f)) + bias) for f, k in zip(rows, y)])
        return 0.5 * (w @ w + bias * bias) + np.maximum(0, 1 - m).sum()

    best, v, c = loss(w, bias), np.zeros_like(w), 0.0
    for step in range(1, 4000):
        g, h = v.copy(), c
        for f, k in zip(rows, y):
            x = ratio[f] / np.sqrt(len(f))
            if (2 * k - 1) * (v[f] @ x + c) < 1:
                g[f] -= (2 * k - 1) * x
                h -= 2 * k - 1
        v, c = v - g / (step + 20), c - h / (step + 20)
    assert best <= 1.001 * loss(v, c)  # the descent stops at steps of a thousandth


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_op5_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    near = base[:30] + 0.05 * r.normal(size=(30, 16))
    x = [v.tolist() for v in np.r_[base, near]] + [
        base[0].tolist(), base[0].tolist(), (2 * base[1]).tolist(), None, [0.0] * 16, [float("nan")] * 16,
        [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [],
    ]
    ids = [*range(5, 5 + len(x) - 1), None]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()}
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    n, comp = len(x), list(range(len(x)))
    link = [
        [
            i != j and ok[i] and ok[j] and len(x[i]) == len(x[j]) and np.dot(x[i], x[j]) / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.9 for j in range(n)
        ] for i in range(n)
    ]
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == {
        ids[i]: (sum(link[i]), ids[comp[i]], comp[i] == i and ids[i] is not None or (ids[i] is None and comp[i] == i)) for i in range(n)
    }


def test_op5_recall_of_a_forest(spark):
    """Trees of several levels, grown in two rounds: all links found are right, and nearly all are found."""
    r = np.random.default_rng(4)
    base = r.normal(size=(3000, 32))
    x = np.r_[base, base[:2500] + 0.4 * r.normal(size=(2500, 32))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {q.vec_id: q for q in forest.near_duplicates(df, leaf=64, chunk=300).collect()}
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    n = link.sum(1)
    assert n.sum() > 2000 and all(got[i].n_links <= n[i] for i in range(len(x)))
    assert sum(q.n_links for q in got.values()) >= 0.9 * n.sum()
    label = np.arange(len(x))
    for _ in range(20):
        label = np.minimum(label, np.where(link, label, len(x)).min(1))
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.9
    assert all(label[i] == label[q.component_id] for i, q in got.items())


def test_op5_in_passes_keeps_no_copies(spark, monkeypatch):
    """Many passes find what one finds; no table of vectors or of their leaves is left."""
    from pathlib import Path

    from vellum.sources.scratch import shared_dir

    x = np.random.default_rng(7).normal(size=(600, 16))
    x = np.r_[x, x + 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    top = Path(shared_dir(spark).removeprefix("file:"))

    def run():
        before = set(top.iterdir())
        rows = sorted(map(tuple, forest.near_duplicates(df, trees=2).collect()))
        return rows, {p.name.split("-")[1] for p in set(top.iterdir()) - before if list(p.glob("*.parquet"))}

    one, left = run()
    assert not left & {"vectors", "leaves", "listed", "trees"} and any(n for _, n, *_ in one)
    monkeypatch.setattr(forest, "PASS", 1, raising=False)
    assert run()[0] == one


def test_op5_lists_of_leaves_go_with_linked_vectors_only(spark, monkeypatch):
    """Copies of vectors without links carry no lists, and those with links only the leaves where they have one."""
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 24))
    x[1] = x[0] + 0.05 * r.normal(size=24)
    seen = []
    monkeypatch.setattr(forest, "_in_leaves", lambda rows, *a, real=forest._in_leaves: seen.append(rows) or real(rows, *a))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {q.vec_id: (q.n_links, q.component_id) for q in forest.near_duplicates(df).collect()}
    assert got == {i: (1, 0) if i < 2 else (0, i) for i in range(700)}
    assert len(seen) == 2 and seen[0].schema.names == ["id", "n", "dim", "v", "leaves"]
    u, side = forest.unit(x), np.arange(700) % 2
    want = (u @ u.T - np.eye(700) >= 0.9).any(axis=1)
    assert (forest.linked(u, np.zeros(700, int)) == want).all() and (forest.linked(u, side) == want).all() and want.sum() == 2


def test_op5_chunks_count_each_link_once():
    x = forest.unit(np.random.default_rng(0).normal(size=(200, 4)).tolist())
    one = forest.Tree(4, 2, 5).fit(x)
    row, leaf = one.leaves(x)
    pad = np.full((200, 4), -1, np.int64)
    for i in range(200):
        own = np.sort(leaf[row == i])
        pad[i, : len(own)] = own
    total = np.zeros(200, int)
    for k in range(4):
        m = row[leaf == k]
        links, _ = forest.compare(x[m], np.ones(len(m), int), pad[m], np.zeros(len(m), int), k)
        half = (np.arange(len(m)) % 2).astype(int)
        parts = [forest.compare(x[m[s]], np.ones(s.sum(), int), pad[m[s]], np.zeros(s.sum(), int), k)[0] for s in (half == 0, half == 1)]
        across = forest.compare(x[m], np.ones(len(m), int), pad[m], half, k)[0]
        for s, p in zip((half == 0, half == 1), parts):
            across[s] += p
        assert (across == links).all()
        np.add.at(total, m, links)
    same = (x @ x.T >= 0.9) & ~np.eye(200, dtype=bool)
    met = np.zeros((200, 200), bool)
    for k in range(4):
        m = row[leaf == k]
        met[np.ix_(m, m)] = True
    assert (total == (same & met).sum(1)).all()


def test_op7_brute_force(spark):
    import re

    rows = corpus(2)
    items = [(i, " ".join(t.split()[: 10 + i])) for i, (_, t) in enumerate(rows[:12])] + [
        (50, None), (51, "one two"), (52, "!!"), (53, "One, TWO"), (None, rows[3][1]),
    ]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")

    def sh(t):
        w = [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    docs = {}
    for d, t in rows:
        docs.setdefault(d, set()).update(sh(t))
    want = sorted(
        ((d, i, len(s), len(s & v)) for d, v in docs.items() for i, t in items for s in [sh(t)] if s and 10 * len(s & v) >= 8 * len(s)),
        key=repr,
    )
    got = sorted(
        ((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained(frame(spark, rows), bench).collect()),
        key=repr,
    )
    assert got == want
    clean = {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {w[0] for w in want}


def test_op7_sizes(spark):
    """Items of every size from 1 to 60 shingles in documents of every size; a document in two rows, and one just too short."""
    words = [f"w{i}" for i in range(3000)]
    items = [(n, " ".join(words[40 * n : 40 * n + n + 4])) for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 32)] + [(60, " ".join(words[2500:2564]))]
    rows = [(100 + n, t) for n, t in items] + [(300, " ".join(words))]
    rows += [(400, " ".join(words[2500:2530])), (400, " ".join(words[2526:2564]))]  # 26 and 34 of 60 in two rows
    rows += [(401, " ".join(words[2500:2552])), (402, " ".join(words[2500:2551]))]  # 48 and 47 of 60: 48 are needed
    found = decontaminate.contained(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_shared for r in found.collect()}

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    docs = {}
    for d, t in rows:
        docs.setdefault(d, set()).update(sh(t))
    want = {(d, i): len(sh(t) & v) for d, v in docs.items() for i, t in items if 10 * len(sh(t) & v) >= 8 * len(sh(t))}
    assert got == want and {(400, 60), (401, 60)} <= want.keys() and (402, 60) not in want


def test_clean_finds_short_items(spark):
    rows = [
        (1, "so One, two! it is"), (2, "one twofold"), (3, "phone two"), (4, "one two"), (5, "two one"), (6, None),
        (7, "a b c d e"), (None, "x y one z"),
    ]
    bench = spark.createDataFrame([(1, "one two"), (2, "b c d e"), (3, "!!"), (4, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()} == {2, 3, 5, 6, None}


def test_op9_round_trip(spark):
    """Ids, cut pieces and their starts are those of the tokenizer's own call on the whole text."""
    from tokenizers import Tokenizer

    rows = [
        *corpus(4, 20), (3000, "word " * 9000),
        (3001, "a b c\x1cd <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> İ ǅ é ́x"),
        (3002, "don't I'll 12 3.4 a'sB \"'re"), (3003, "Ünï×cödé÷ " * 3000), (3004, None),
    ]
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    out = packing.packed(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    one = {}
    for r in out:
        one.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in one.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 4096
    assert len(one) == -(-sum(w[3] for w in want) // 4096)


def test_op9_elements_equal_the_tokenizer():
    import pyarrow as pa

    r = random.Random(1)
    some = [
        *"abXY éÉß×÷ÿ'’sStd|<>.,-019\n\t\x0b\x1c\x85\u00a0\u0301İσΣς漢🙂\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "'s",
        "'ll", "don't", "  ", "K", "½", "٣",
    ]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    own = packing.tokens_of(packing.vocabulary_path())
    assert own.known
    got = [x.tolist() for x in own.encode(pa.array([*texts, None]))]
    plain = own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert got == [*(e.ids for e in plain), []]
    long = "".join(r.choice(some) for _ in range(3000)) * 4
    assert b"".join(packing.cut_at_spaces(long.encode(), 50)) == long.encode() and len(packing.cut_at_spaces(long.encode(), 50)) > 100
    keep, packing.LONG, packing.AT_ONCE = (packing.LONG, packing.AT_ONCE), 1000, 300
    try:
        (got,) = own.encode(pa.array([long]))
    finally:
        packing.LONG, packing.AT_ONCE = keep
    assert got.tolist() == own.tokenizer.encode(long, add_special_tokens=False).ids
    other = packing.Tokens(packing.vocabulary_path("byte_bpe_50k.json"))
    assert not other.known
    assert [x.tolist() for x in other.encode(pa.array(["a B", None]))] == [other.tokenizer.encode("a B", add_special_tokens=False).ids, []]


def test_op9_plan_is_fullest():
    r = random.Random(0)
    for _ in range(20):
        counts = {n: r.randint(1, 4) for n in r.sample(range(1, 60), 8)}
        best = packing.fullest(counts, 60)
        assert all(best.count(n) <= counts[n] for n in best) and sum(best) <= 60
        sums = {0}
        top = max(counts)
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c - (n == top) + 1)}
        assert sum(best) == max(s for s in sums if s <= 60 - top) + top
    assert packing.plan({}) == []


def test_op10_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", r"[\INST] <\\/s>", "", None, "<s>[ANS]x[/ANS]</s>", "[INST", "plain\ntext", "[[INST]]", "😀</s"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 9) for i, t in enumerate(hard)] + [
        (2, 0, None, "a", 9), (2, 0, None, "a", 9), (2, None, "[INST]", "b", 9), (None, 1, "user", "c", 9),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, out int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hard)]
    assert [(t.role, t.text) for t in got[2].turns] == [("[INST]", "b"), ("", "a"), ("", "a")]
    d = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    loss = "".join(t or "" for i, t in enumerate(hard) if i % 2)
    assert (d[1].n_turns, d[1].loss_chars, d[1].loss_sha256) == (len(hard), len(loss), hashlib.sha256(loss.encode()).hexdigest())


PAGE = '<html><body class="has-sidebar"><header>Site</header><nav><a href=/>home</a></nav><div class="post-{n}"><h1>T &amp; {n}</h1><p>First   paragraph of page {n}<p>Second <b>one</b><br>goes on<form><p>Email</p></form><div class="comments"><p>nice</p></div></div><aside>side</aside><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>'


def test_op2_pages(spark):
    rows = [(i, f"http://www.h{i % 2}.com/p", PAGE.format(n=i), "z") for i in range(6)] + [
        (10, "http://h0.com/q", None, "z"), (11, None, "just text", "z"), (12, "http://h0.com/r", "", "z"),
    ]
    got = {
        r.page_id: r for r in html_text.main_text(
            spark.createDataFrame(rows, "page_id long, url string, html string, host string")
        ).collect()
    }
    assert got[3].text == "T & 3\nFirst paragraph of page 3\nSecond one goes on"
    assert (got[10].text, got[12].text, got[11].text, got[10].n_chars) == ("", "", "just text", 0)
    assert len(got) == 9


def test_op2_long_threads_are_furniture():
    def text(html):
        p = html_text.Page(html)
        return p.text(p.votes()[0][0] if p.votes() else None)

    long = "<p>" + "many words said below the line " * 20 + "</p>"
    for name in ("comments", "ad", "page-comments", "sponsored"):
        assert text(f"<body><article><p>short and good</p><div class='{name}'>{long}</div></article></body>") == "short and good"
    for shape in ("div class='comment-body'", "section class='discussion'", "ol class='commentlist'", "div id='respond'", "div class='comments reviews'", "div class='post-comment-list'", "div class='replies-area'"):
        kind = shape.split()[0]
        assert text(f"<body><article><p>short and good</p><{shape}>{long}</{kind}></article></body>") == "short and good"
    assert "many words" in text(f"<body><div class='commentary'>{long}</div></body>")
    for name in ("has-comments", "post with-ads", "comments-open", "has-sidebar"):
        assert "many words" in text(f"<body><div class='{name}'>{long}</div><p>x</p></body>")
    assert "many words" in text(f"<body><div class='ad'><article>{long}</article></div></body>")


def test_op3_op6_learn_and_score(spark):
    r = random.Random(0)
    docs, labels = [], []
    for i in range(400):
        y = i % 2
        t = " ".join(r.choice(WORDS) for _ in range(40))
        docs.append((i, t + (" nasty vile" if y else "")))
        labels.append((i, y, y))
    docs += [(900, None), (901, ""), (902, "alpha " * 5000 + "vile nasty"), (None, "beta")]
    labels += [(5, None, None), (None, 1, 1), (7, 3, 3), (9999, 1, 1)]
    d = frame(spark, docs)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for op, at in ((nbsvm, 0.7), (compression, 0.3)):
        got = {x.doc_id: x for x in op.scored(d, l).collect()}
        assert len(got) == len(docs) and all(0 <= x.score <= 1 for x in got.values())
        assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.values())
        held = [x for x in got.values() if x.held_out and x.doc_id < 400]
        assert np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.95
        assert op.scored(d, l.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    kept = compression.without_toxic(d, l)
    assert kept.columns == d.columns


@pytest.mark.parametrize(
    "op",
    [
        suffix_array.dedup_substrings, phrases.dedup_phrases, simhash.near_duplicates, packing.packed,
        simhash.one_row_of_each, suffix_array.without_repeats,
    ],
)
def test_empty_tables(spark, op):
    assert op(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_empty_tables_of_others(spark):
    d, b = frame(spark, [(1, "x")]).limit(0), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(d, b).count() == 0
    assert decontaminate.clean(frame(spark, [(1, "x")]), b).count() == 1
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    l = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert nbsvm.scored(d, l).count() == compression.scored(d, l).count() == 0
