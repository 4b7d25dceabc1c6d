"""Links: references against the examples of RFC 3986, hops against a plain breadth-first search."""

import random

from pyspark.sql import functions as F

from vellum.operators import graph, links

# reference and address on a page at http://a/b/c/d;p?q, as RFC 3986 (5.4) gives them, fragments off
EXAMPLES = [
    ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g/"),
    ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q"), ("g#s", "http://a/b/c/g"),
    ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"),
    ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"),
    ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("mailto:x@y", None), ("HTTPS://Q/R", "https://q/R"),
]


def test_references_of_the_standard(spark):
    df = spark.createDataFrame(EXAMPLES, "ref string, want string")
    got = df.select("ref", "want", links.resolved(F.lit("http://a/b/c/d;p?q"), F.col("ref")).alias("got")).collect()
    assert [(r.ref, r.got) for r in got] == [(r.ref, r.want) for r in got]


def test_anchors_of_pages(spark):
    html = """<A class=x HREF='../a?b=1&amp;c=2'>x</A><a href=//h/z>y</a><area href="no"><a data-href="no">n</a><a href="javascript:x()">j</a><a href="/#t">r</a>"""
    rows = [(1, "http://S/p/q", html), (2, None, '<a href="http://x">k</a><a href="rel">l</a>'), (3, "http://s/", None)]
    got = links.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.target) for r in got} == {(1, "http://s/a?b=1&c=2"), (1, "http://h/z"), (1, "http://s/"), (2, "http://x/")}


def test_hops_from_both_ends(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)] + [("n0", f"n{i}") for i in range(20, 60)] + [("n1", None)]
    pairs = [(f"n{r.randrange(62)}", f"n{r.randrange(62)}") for _ in range(150)] + [("n3", "n3"), (None, "n1")]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def hops(a, b, longest):
        ball, front = {a}, {a}
        for n in range(longest + 1):
            if b in ball:
                return n
            front = {y for x in front for y in after.get(x, ()) if y} - ball
            ball |= front
        return None

    e, p = spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(pairs, "source string, target string")
    for longest, hub in ((7, 1_000_000), (2, 5)):
        got = {(x.source, x.target, x.hops) for x in graph.hops_between(e, p, longest, hub).collect()}
        want = {(a, b, hops(a, b, longest)) for a, b in pairs if a}
        assert got == {w for w in want if w[2] is not None}
