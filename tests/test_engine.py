"""The whole jobs keep every issue apart and run every check."""

import pytest
from pyspark.sql import functions as F

from vellum.fixtures import fixture
from vellum.operators import report as R
from vellum.plans import engine as E


def texts(spark, *rows):
    return E.parse_texts(spark.createDataFrame(list(rows), "doc_id long, text string"))


def kept(c):
    """(doc_id, subtype, section_id, paragraph_id, paragraph_index) of the formatting issues after merging."""
    i = R.merged(E.run_agents(c)[0]).where("type = 'formatting'")
    return sorted((tuple(r) for r in i.select("doc_id", "subtype", "section_id", "paragraph_id", "paragraph_index").collect()), key=repr)


def laid_out(spark):
    fx = lambda n: fixture(spark, "fx_" + n)
    figures = spark.createDataFrame(
        [("d1", 1, "fig_1", "", 1, 3), ("d1", 2, "fig_2", "", 1, 5), ("d1", 3, "fig_3", "", 1, None)],
        fx("figures").schema,
    )
    sections = spark.createDataFrame(
        [("d1", i, f"s{i}", str(i) if i < 3 else "", f"Часть {i}", 1, "т") for i in range(1, 6)], fx("sections").schema,
    )
    formulas = spark.createDataFrame(
        [("d1", i, 10 * i if i < 3 else None, "a = b", "center", True, None, None, True, True, "", None) for i in range(1, 5)],
        fx("formulas").schema,
    )
    return E.Corpus(
        fx("docs").where("doc_id = 'd1'"), sections, fx("paragraphs"), figures, fx("tables"),
        {k: fx(k) for k in ("para_layout", "table_layout", "page_layout", "page_numbering", "heading_layout")} | {"formulas": formulas},
    )


def test_equal_faults_stay_apart(spark):
    c = laid_out(spark)
    got = kept(c)
    assert [x[3] for x in got if x[1] == "missing_figure_caption"] == ["fig_1", "fig_2", "fig_3"]
    assert [x[2] for x in got if x[1] == "missing_section_number"] == ["s3", "s4", "s5"]
    assert sum(x[1] == "missing_formula_number" for x in got) == 4
    row = E.analyze(c).first()
    assert row.total == len(set(row.issue_ids)) >= sum(x[0] == "d1" for x in got)


def test_equal_sections_stay_apart(spark):
    got = kept(texts(spark, (1, "1 Раз\n\nт\n\n1 Раз\n\nт\n\nПриложение А\n\nт\n\nРисунок 2 — А\n\nРисунок 5 — Б")))
    assert [x[3] for x in got if x[1] == "figure_numbering_error"] == ["fig_1", "fig_2"]


def test_every_check_without_layout(spark):
    got = {
        x[:4] for x in kept(
            texts(spark, (1, "1 Раз\n\nт\n\nРисунок 1 Схема\n\nТаблица 1 Данные\n\n• пункт\n\nПриложение А\n\nт"), (2, "Содержание"))
        )
    }
    doc = {x[1:] for x in got if x[0] == "1"}
    assert {
        ("invalid_figure_caption_format", None, "fig_1"), ("invalid_table_caption_format", None, "tbl_1"),
        ("missing_contents_section", "sec_appendix_а", None), ("missing_appendix_reference", "sec_appendix_а", None),
        ("missing_references_section", "sec_appendix_а", None),
    } <= doc
    assert "invalid_enumeration_marker" in {x[0] for x in doc}
    assert {x[1:] for x in got if x[0] == "2"} == {("missing_references_section", None, "p_1")}


def test_every_check_with_layout(spark):
    fx = lambda n: fixture(spark, "fx_" + n)
    names = ("para_layout", "table_layout", "page_layout", "page_numbering", "formulas", "heading_layout")
    got = kept(E.Corpus(fx("docs"), fx("sections"), fx("paragraphs"), fx("figures"), fx("tables"), {k: fx(k) for k in names}))
    said = {x[1] for x in got}
    assert {"missing_formula_reference", "missing_appendix_reference", "main_heading_indent_invalid", "missing_table_reference"} <= said


def test_issues_name_the_rules_of_their_standard(spark):
    fx = lambda n: fixture(spark, "fx_" + n)
    docs = fx("docs").selectExpr("*", "case when doc_id in ('d1', 'd6') then 'g' else 'other' end as standard_id")
    c = E.Corpus(docs, fx("sections"), fx("paragraphs"), fx("figures"), fx("tables"), rules=fx("rules"))
    got = R.merged(E.run_agents(c)[0]).where("type = 'formatting'").select("doc_id", "subtype", "rule_id", "quote").collect()
    assert {x.rule_id for x in got if x.doc_id == "d1" and x.subtype == "missing_figure_caption"} == {"r8"}
    assert {x.quote for x in got if x.doc_id == "d1" and x.subtype == "missing_figure_caption"} == {"Подпись обязательна, см. раздел 6"}
    # a standard without rules leaves out what needs one, and names no rule
    assert "missing_figure_reference" in {x.subtype for x in got if x.doc_id == "d6"}
    other = [x for x in got if x.doc_id == "d5"]
    assert other and all(x.quote is None for x in other) and "missing_figure_reference" not in {x.subtype for x in other}


def test_an_agent_that_fails_while_it_runs(spark):
    c = texts(spark, (1, "1 Раз\n\nкороче говоря, т"), (2, "текст"))
    c.figures = c.figures.selectExpr("*", "raise_error('broken') as b").where("b is null or true").drop("b").withColumn(
        "caption", F.when(F.raise_error(F.lit("broken")).isNull(), "x"),
    )
    rows = E.analyze(c).collect()
    assert {x.status for x in rows} == {"partial_success"} and len(rows) == 2


def test_the_fix_chain_adds_what_is_missing(spark):
    from vellum.sources import docx

    fx = lambda n: fixture(spark, "fx_" + n)
    c = E.Corpus(fx("docs"), fx("sections"), fx("paragraphs"), fx("figures"), fx("tables"), {"table_layout": fx("table_layout")})
    issues = spark.createDataFrame(
        [("d2", 1, "missing_required_section", "Нет раздела «Метод»")],
        "doc_id string, ord int, subtype string, evidence string",
    )
    lines = [x.text for x in docx.read_facts(E.corrected_files(c, fx("fixes"), issues)).where("doc_id = 'd2'").orderBy("i").collect()]
    assert "Заполните содержимое раздела." in lines and lines[-1] == "Таблица 1 - Сравнение показателей 1"


def test_bridged_questions(spark):
    fx = lambda n: fixture(spark, "fx_" + n)
    facts = spark.createDataFrame(
        [("bridge:x", "Икс", "рисунок связан с таблицей", "bridging_fact", "d1,d2")],
        "id string, entity string, content string, entry_type string, sources string",
    )
    entries = fx("nodes").selectExpr("id", "content as text", "type as entry_type").unionByName(
        facts.selectExpr("id", "content as text", "entry_type")
    )
    vecs = E.vectors.embedded(entries, "id").join(entries.select("id", "entry_type"), "id").where("size(embedding) > 0")
    got = E.ask_bridged(fx("queries"), vecs, fx("nodes"), fx("edges"), facts)
    said = {x.query_id: x.prompt for x in got["prompts"].collect()}
    assert set(said) == {1, 2, 3, 4} and "[RULE] Правило рисунков (number=1.1" in said[1] and "BRIDGING_FACT" in said[1]
    assert {x.entity for x in got["bridges"].collect()} == {"Икс"}
    assert all(x.content.endswith("...") for x in got["sources"].collect())


def test_a_failure_stays_with_its_document(spark):
    """Two poisoned documents of forty: all others have every agent's issues, as without the two."""
    rows = [(i, f"1 Раз\n\nкороче говоря, текст {i}\n\n3 Два") for i in range(40)]
    good = E.run_agents(texts(spark, *[x for x in rows if x[0] not in (7, 30)]))[0]
    c = texts(spark, *rows)
    c.paragraphs = c.paragraphs.withColumn("text", F.when(F.col("doc_id").isin(7, 30), F.raise_error(F.lit("poisoned"))).otherwise(F.col("text")))
    issues, agents = E.run_agents(c, ("structure_agent", "style_agent"))
    told = {(x.doc_id, x.agent): x.error for x in agents.collect()}
    assert len(told) == 80 and {k for k, v in told.items() if v} >= {(7, "style_agent"), (30, "style_agent")} and {k[0] for k, v in told.items() if v} == {7, 30}
    count = lambda df: {(x.doc_id, x.agent): x.n for x in df.where("agent in ('structure_agent', 'style_agent') and doc_id not in (7, 30)").groupBy("doc_id", "agent").agg(F.count("*").alias("n")).collect()}
    assert count(issues) == count(good) and len(count(good)) == 76


def test_many_unreadable_documents_take_one_search(spark, monkeypatch):
    """A third of the documents fails, with no search by halves; nulls, empty texts and a null doc_id stay what they are."""
    from vellum.sources import scratch

    rows = [(i, f"1 Раз\n\nкороче говоря, текст {i}") for i in range(60)]
    c, good = texts(spark, *rows), texts(spark, *[x for x in rows if x[0] % 3])
    c.paragraphs = c.paragraphs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.raise_error(F.lit("poisoned"))).otherwise(F.col("text")))
    ran, first = [], E.made()
    monkeypatch.setattr(E.style, "check_style", lambda s, p, f=E.style.check_style: ran.append(1) or f(s, p))
    issues, agents = E.run_agents(c, ("style_agent",))
    assert {x.doc_id for x in agents.collect() if x.error} == set(range(0, 60, 3)) and len(ran) == 2
    # results and the documents that failed are left
    assert len([p for p in scratch._MADE[first:] if p]) == 2 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert sorted(issues.drop("issue_id").collect()) == sorted(E.run_agents(good, ("style_agent",))[0].drop("issue_id").collect())
    odd = spark.createDataFrame([(1, "", None, 1.5, True), (None, None, 7, float("nan"), None), (2, "é\x00", -1, -0.0, False)], "doc_id long, `a``b.c` string, n int, x double, y boolean")
    same, bad = E._tried(odd, "odd")
    assert same.schema == odd.schema and not bad.count() and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    none = odd.withColumn("n", F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("x"))).otherwise(F.col("n")))
    left, bad = E.readable(E.Corpus(none, odd, odd, odd, odd), ("docs",))
    assert [(x.doc_id, x.error) for x in bad.collect()] == [(None, "docs can't be read: n")] and left.docs.count() == left.tables.count() == 2


def test_too_many_failures_end_the_search(spark):
    c = texts(spark, *[(i, "текст") for i in range(20)])
    done, failed = E.quarantined(c, lambda part: part.docs.select(F.raise_error(F.lit("broken")).cast("string").alias("x")), "none", splits=5)
    assert not done and len(failed) > 1


def test_style_by_a_model(spark, tmp_path):
    c = texts(spark, (1, "1 Раз\n\nтекст с ашибкой"), (2, "1 Два\n\nтекст"))
    said = '{"issues":[{"subtype":"spelling_error","paragraph_id":"p_1","severity":"","confidence":"high","before":"ашибкой","after":"ошибкой"}]}'
    got = E.model_issues(c, lambda prompt: said if "ашибкой" in prompt else "нет", str(tmp_path / "answers")).collect()
    assert [(x.doc_id, x.subtype, x.after) for x in got] == [(1, "spelling_error", "ошибкой")]


def test_rounds_of_paths_are_deleted(spark):
    """A chain of twelve nodes: the paths of the last round are all that is left of the rounds."""
    from vellum.operators import graph
    from vellum.sources import scratch

    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "source string, target string")
    before = scratch.made()
    got = graph.shortest_paths(edges, spark.createDataFrame([("0",)], "id string"))
    assert {r.id: r.hops for r in got.collect()} == {str(i): i for i in range(13)}
    assert len([p for p in scratch._MADE[before:] if p]) <= 3 < scratch.made() - before


def test_facts_of_bridges_equal_a_loop(spark):
    """Entities inside words, of one letter, phrases and spaces; a word with more facts than count; postings carry no texts."""
    from vellum.operators import retrieve as R

    texts = ["Alpha beta", "alphabet soup", "the big  cat", "the big cat", "a\nb", "Xyz", "no"] + [f"alpha {i}" for i in range(60)]
    rows = [(f"d{i % 9}", i % 9, i, f"f{i}", t) for i, t in enumerate(texts)]
    names = ["Alpha", "B", "big cat", "big  cat", "Cat", " ", "\n", "missing", "Soup of", "no"]
    got = R.bridge_akus(spark.createDataFrame([(n,) for n in names], "entity string"), spark.createDataFrame(rows, "doc_id string, doc_ord int, aku_ord int, id string, content string"))
    want = set()
    for n in names:
        hits = sorted((r for r in rows if n.lower() in r[4].lower()), key=lambda r: (r[1], r[2]))[:40]
        docs = sorted({r[1] for r in hits})
        want |= {(n, r[3]) for r in hits if len(docs) >= 2 and r[1] in docs[:5]}
    assert sorted((r.entity, r.id) for r in got.collect()) == sorted(want) and len(want) > 60
    assert {r.id: r.content for r in got.collect()} == {i: rows[int(i[1:])][4] for _, i in want}
    # texts aren't repeated for each place of a fact
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Generate explode(array_distinct(" in x and "content" in x.split(", false, [")[-1]]


def test_saved_standards_are_few_folders_and_replace_their_own(spark, tmp_path):
    """A save is one folder of each stage, however many standards it has; a standard that is saved again is the later one."""
    from pathlib import Path

    def lines(ids, text):
        return spark.createDataFrame(
            [(s, p, t) for s in ids for p, t in enumerate(["1 Общие положения", "", f"1.1 {text}", "", "Рисунки следует нумеровать."])],
            "standard_id string, pos int, line string",
        )

    root = str(tmp_path / "standards")
    ids = [f"g{i}" for i in range(60)]
    stages = ("parsed", "rules")
    wanted = lambda made: {k: made[k] for k in stages}
    E.save_standard(wanted(E.ingest_standard(lines(ids, "Рисунки нумеруют"))), root)
    assert len([x for x in Path(root, "rules").iterdir() if x.is_dir()]) == 1
    E.save_standard(wanted(E.ingest_standard(lines(["g7"], "Таблицы нумеруют"))), root)
    got = {r.standard_id: r.title for r in E.load_standard(spark, root, stages=stages)["rules"].collect()}
    assert got == {s: "Таблицы нумеруют" if s == "g7" else "Рисунки нумеруют" for s in ids}
    one = E.load_standard(spark, root, "g7", stages)
    assert {s: [r.standard_id for r in one[s].select("standard_id").distinct().collect()] for s in stages} == {s: ["g7"] for s in stages}
    with pytest.raises(FileNotFoundError):
        E.load_standard(spark, root, "g60", stages)


def test_a_standard_saved_without_rules_has_none(spark, tmp_path):
    root = str(tmp_path / "standards")
    for text in ("1.1 Рисунки нумеруют", "Рисунки нумеруют"):
        rows = [("g", p, t) for p, t in enumerate(["1 Общие положения", "", text])]
        made = E.ingest_standard(spark.createDataFrame(rows, "standard_id string, pos int, line string"))
        E.save_standard({"rules": made["rules"], "parsed": made["parsed"]}, root)
    assert E.load_standard(spark, root, "g", ("rules",))["rules"].count() == 0


def test_a_long_heading_is_cut_in_one_pass(spark):
    """Work grows with the words; a title of 20,000 of them took their square."""
    from time import monotonic

    from vellum.operators.standards import heading_tail

    df = spark.createDataFrame([("ИТОГ " * 20_000 + "слово Конец строки",)], "t string")
    began = monotonic()
    h = df.select(heading_tail(F.col("t")).alias("h")).first().h
    assert h.tail == "Конец строки" and len(h.title) == 5 * 20_000 + 5
    assert monotonic() - began < 20


def test_rules_are_not_dealt_by_their_few_objects(spark):
    """Most rules are about one of a few objects: a join dealt by these would read most of them in one task."""
    from vellum.operators.formatting import rule_pick

    rules = spark.range(1000).selectExpr(
        "concat('g', id % 10) standard_id", "CAST(id AS INT) ord", "concat('r', id) rule_id", "'1.1' number", "'s' section_id", "'t' title",
        "'c' content", "IF(id % 20 < 10, 'figure', 'table') object_type", "'numbering' constraint_type",
    )
    wanted = spark.createDataFrame([("figure", "numbering")], "object_type string, constraint_type string")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rules were many
    try:
        got = rule_pick(rules, wanted)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "hashpartitioning(object_type" not in plan
    assert got.count() == 10


def test_relations_that_many_checks_read_are_worked_out_once(spark):
    c = E._settled(laid_out(spark))
    assert all(df.inputFiles() for df in (c.sections, c.paragraphs, c.figures, c.tables))
    assert all(c.more[k].inputFiles() for k in E.OFTEN if k in c.more)
