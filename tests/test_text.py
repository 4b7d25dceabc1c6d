import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as T

SAMPLES = ["", None, " a  b ", "Ёлка тест", "Короче говоря, блин.", "A. B! C? д. Е", "1.2.10", "1.a", "x" * 50]


def test_squeeze_and_fold(spark):
    got = [
        tuple(r) for r in spark.createDataFrame(
            [(i, s) for i, s in enumerate(SAMPLES)], "i int, s string",
        ).orderBy("i").select(T.squeeze("s"), T.folded("s")).collect()
    ]
    want = [(" ".join((s or "").split()), " ".join((s or "").lower().replace("ё", "е").split())) for s in SAMPLES]
    assert got == want


def test_sentences_match_python(spark):
    texts = [s or "" for s in SAMPLES] + ["Один. Два!  Три?\nЧетыре"]
    got = [
        r[0] for r in spark.createDataFrame(
            [(i, s) for i, s in enumerate(texts)], "i int, s string",
        ).orderBy("i").select(T.sentences("s")).collect()
    ]
    assert got == [[x.strip() for x in re.split(r"(?<=[.!?])\s+", s.strip()) if x.strip()] for s in texts]


def test_number_parts(spark):
    rows = [("1.2.10", [1, 2, 10]), ("1.a", []), ("", []), (None, []), ("3", [3]), ("²", [])]
    got = spark.createDataFrame(rows, "n string, want array<int>").select(T.number_parts("n"), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_number_key_orders_rules(spark):
    got = [r.n for r in spark.createDataFrame([("5.10",), ("5.2",), ("5",), ("x",)], "n string").orderBy(T.number_key("n")).collect()]
    assert got == ["x", "5", "5.2", "5.10"]


def test_replace_first(spark):
    r = spark.createDataFrame(
        [("Короче говоря, метод, блин.", "короче говоря", "таким образом")], "t string, a string, b string",
    ).select(T.replace_first(F.col("t"), F.col("a"), F.col("b"))).first()
    assert r[0] == "таким образом, метод, блин."


@pytest.mark.parametrize(
    "a,b,want",
    [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)],
)
def test_cosine_guards(spark, a, b, want):
    assert spark.createDataFrame(
        [(a, b)], "a array<double>, b array<double>",
    ).select(T.cosine(F.col("a"), F.col("b"))).first()[0] in (want, None if a is None else want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "3", "1.1", "1.2", "2.1", "3.1.1", ""]), min_size=1, max_size=8))
def test_sequence_gaps_equal_a_loop(spark, numbers):
    from vellum.operators import structure as S

    s = spark.createDataFrame(
        [("d", i, f"s{i}", n, "t", 1, "") for i, n in enumerate(numbers)],
        "doc_id string, ord int, section_id string, number string, title string, level int, text string",
    )
    p = spark.createDataFrame(
        [], "doc_id string, ord int, paragraph_id string, section_id string, text string, page int, paragraph_index int",
    )
    got = sorted(r.item_ord for r in S.sequence_gaps(S.structure_entries(s, p)).collect())
    last, want = {}, []
    for i, n in enumerate(numbers):
        if not n:
            continue
        parts = tuple(map(int, n.split(".")))
        up = parts[:-1]
        if (up in last and parts[-1] != last[up] + 1) or (up not in last and up and parts[-1] != 1):
            want.append(i)
        last[up] = parts[-1]
    assert got == want


def test_ascii_ids_by_compatibility_decomposition(spark):
    import unicodedata

    from vellum.operators.standards import ascii_folded

    names = ["ﬁle №5", "x² + ½", "Ｆｕｌｌ ｗｉｄｔｈ", "Généralités", "Straße", "ГОСТ 7", "Ⅳ ㎏ ™", "é", "", *("".join(chr(c) for c in range(a, a + 400) if not 0xD800 <= c < 0xE000) for a in range(0x80, 0xFFFF, 4000))]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", ascii_folded(F.col("name")).alias("a")).collect()
    assert {r.name: r.a for r in got} == {n: unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names}


def test_a_secret_is_no_formula(spark):
    from vellum.operators import parse

    texts = ["v = s / t", "token = 12 / b", "password=b7.", "Speed = s / t", "tokens = n", "api_key=abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse.looks_like_formula(F.col("t")).alias("f"))
    assert {r.t for r in df.collect() if r.f} == {"v = s / t", "Speed = s / t", "tokens = n"}
