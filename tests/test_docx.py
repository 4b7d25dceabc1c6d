import io
import zipfile

from vellum.sources import docx

XML = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:jc w:val="center"/><w:ind w:firstLine="709"/><w:spacing w:line="360"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/><w:color w:val="FF0000"/></w:rPr><w:t>Заголовок.</w:t></w:r></w:p>
<w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>ячейка</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>где: x</w:t></w:r></w:p>
<w:p><w:r><w:drawing/><w:t>Рисунок.</w:t></w:r></w:p>
<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:left="1701" w:right="851" w:top="1134" w:bottom="1134"/></w:sectPr></w:body></w:document>"""


def file(xml=XML):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_facts(spark):
    rows = docx.read_facts(spark.createDataFrame([("d", file()), ("bad", b"x")], "doc_id string, content binary")).collect()
    head = next(r for r in rows if r.kind == "paragraph" and r.i == 1)
    assert (
        head.text, head.alignment, head.first_line_indent_mm, head.line_spacing, head.font_size_pt, head.bold,
        head.non_black,
    ) == ("Заголовок.", "center", 12.5, 1.5, 14.0, True, True)
    assert [r.i for r in rows if r.kind == "cell"] == [10000]
    page = next(r for r in rows if r.kind == "section")
    assert (page.width_mm, page.height_mm, page.left_mm) == (210.0, 297.0, 30.0)
    assert [r.doc_id for r in rows if r.kind == "error"] == ["bad"]


def test_build_and_text():
    assert docx.document_text(docx.build(["a & b", "<c>"]))[0] == "a & b\n<c>"
    assert docx.build(["x"]) == docx.build(["x"])


def test_edits_keep_drawings(spark):
    plan = spark.createDataFrame(
        [
            ("d", 1, "strip_period", None, 3), ("d", 3, "where_without_colon", None, 2),
            ("d", 4, "strip_period", None, 1), ("d", 1, "align", "left", 4), ("d", None, "set_page", None, 5),
        ],
        "doc_id string, paragraph_index int, op string, arg string, step int",
    )
    out = docx.edited(spark.createDataFrame([("d", file())], "doc_id string, content binary"), plan).first().content
    by = {f["i"]: f for f in docx.facts(out) if f["kind"] == "paragraph"}
    assert (by[1]["text"], by[1]["alignment"], by[3]["text"], by[4]["text"]) == ("Заголовок", "left", "где x", "Рисунок.")


def test_formulas_captions_and_page_numbers():
    xml = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Итого.</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    <w:p><w:r><w:t>Таблица 1 - Данные</w:t></w:r></w:p><w:p><w:r><w:t>Сумма равно y = kx + b, где k - число</w:t></w:r></w:p><w:sectPr/></w:body></w:document>"""
    ops = [
        ("move_caption_above", 1, None), ("split_formula", 2, "1"), ("strip_header_period", None, None),
        ("add_page_field", None, None), ("add_page_field", None, None),
    ]
    out = docx.edit(file(xml), [{"op": o, "paragraph_index": i, "arg": a} for o, i, a in ops])
    f = docx.facts(out)
    assert [x["text"] for x in f if x["kind"] != "section"] == [
        "Таблица 1 - Данные", "", "Итого", "Сумма равно", "y = kx + b (1)", "где k - число",
    ]
    assert [x["page_field"] for x in f if x["kind"] == "section"] == [True]


def laid(i, text, **more):
    return {"i": i, "sub": 1, "kind": "p", "text": text, **more}


def test_page_parts_and_layout_come_back(spark):
    page = {"width_mm": 210.0, "height_mm": 297.0, "left_mm": 30.0, "right_mm": 15.0, "top_mm": 20.0, "bottom_mm": None, "page_field": True, "footer_alignment": "right", "header_field": False, "first_field": True, "title_page": True, "page_start": 5}
    content = docx.compose([laid(1, "1 Введение", style="heading 1", alignment="center"), laid(2, "a & <b>", alignment="justify", first_line_indent_mm=12.5, line_spacing=1.5, font_size_pt=14.0, font_family="Arial", bold=True, non_black=True), laid(3, "", drawing=True)], page)
    assert content == docx.compose([laid(1, "1 Введение", style="heading 1", alignment="center"), laid(2, "a & <b>", alignment="justify", first_line_indent_mm=12.5, line_spacing=1.5, font_size_pt=14.0, font_family="Arial", bold=True, non_black=True), laid(3, "", drawing=True)], page)
    rows = docx.facts(content)
    section = rows[-1]
    assert {k: section[k] for k in ("page_field", "footer_alignment", "header_field", "first_field", "title_page", "page_start", "bottom_mm")} == {"page_field": True, "footer_alignment": "right", "header_field": False, "first_field": True, "title_page": True, "page_start": 5, "bottom_mm": None}
    assert (rows[1]["text"], rows[1]["alignment"], rows[1]["font_family"], rows[1]["bold"], rows[1]["non_black"], rows[2]["drawing"]) == ("a & <b>", "justify", "Arial", True, True, True)


def test_a_section_has_the_parts_of_the_one_before(spark):
    xml = XML.replace('<w:sectPr>', '<w:p><w:pPr><w:sectPr><w:footerReference xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" w:type="even" r:id="e"/></w:sectPr></w:pPr></w:p><w:sectPr>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/settings.xml", f'<w:settings xmlns:w="{docx.W[1:-1]}"><w:evenAndOddHeaders/></w:settings>')
        z.writestr("word/f.xml", docx._field_part("ftr", "center"))
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="e" Type="x" Target="f.xml"/></Relationships>')
    sections = [r for r in docx.facts(out.getvalue()) if r["kind"] == "section"]
    assert [(s["page_field"], s["footer_alignment"]) for s in sections] == [(True, "center"), (True, "center")]


def test_edits_find_their_paragraph_by_text():
    content = docx.build(["one.", "two.", "three.", "two."])
    edits = [
        {"paragraph_index": 1, "op": "insert_before", "arg": "new", "text": "one."}, {"paragraph_index": 1, "op": "strip_period", "text": "two."},
        {"paragraph_index": 3, "op": "strip_period", "text": "three."}, {"paragraph_index": 9, "op": "strip_period", "text": "nowhere."},
    ]
    assert docx.document_text(docx.edit(content, edits))[0] == "new\none.\ntwo\nthree\ntwo."


def test_appendix_line_is_split():
    assert docx.document_text(docx.edit(docx.build(["Приложение А Материалы"]), [{"paragraph_index": 1, "op": "split_appendix"}]))[0] == "Приложение А\nМатериалы"


def test_files_as_a_corpus(spark):
    """Running sections, captions of drawings and tables, formulas' neighbours, repeated numbers, a broken file."""
    from vellum.plans import engine

    items = [
        laid(1, "Введение", style="heading 1"), laid(2, "слова " * 3), laid(3, "", drawing=True), laid(4, "Рисунок 1 — Вид"), laid(5, "2 Метод", style="heading 1"), laid(6, ""),
        laid(7, "y = kx (1)"), laid(8, "где k — число, которое известно заранее"), laid(9, "Таблица 1 — Данные"), {"i": 9, "sub": 2, "kind": "table", "text": "Год"}, laid(10, "2 Метод снова", style="heading 1"), laid(11, "", drawing=True),
        laid(12, "Приложение А Прочее"), {"i": 12, "sub": 2, "kind": "table", "text": "Сумма."},
    ]
    c = engine.read_files(spark.createDataFrame([("d", docx.compose(items, {})), ("bad", b"x"), ("empty", docx.build([]))], "doc_id string, content binary"))
    got = lambda df, *cols: [tuple(r[k] for k in cols) for r in df.orderBy("doc_id", df.columns[1]).collect()]
    assert {r.doc_id: r.error is not None for r in c.docs.collect()} == {"d": False, "bad": True, "empty": False}
    assert got(c.sections, "section_id", "number", "title") == [("sec_auto_1", "", "Введение"), ("sec_2", "2", "Метод"), ("sec_2_at_3", "2", "Метод снова"), ("sec_auto_2", "", "Приложение А Прочее")]
    assert got(c.figures, "caption", "paragraph_index") == [("Рисунок 1 — Вид", 4), ("", 11)]
    assert got(c.tables, "caption", "paragraph_index") == [("Таблица 1 — Данные", 9), ("", 12)]
    assert got(c.more["table_layout"], "caption_position", "header_text", "appendix_letter") == [("above", "Год", None), ("missing", "Сумма.", "А")]
    assert got(c.more["formulas"], "equation_number", "prev_blank", "next_blank", "next_text") == [("1", True, False, "где k — число, которое известно заранее")]
    assert got(c.paragraphs, "section_id", "paragraph_index") == [("sec_auto_1", 2), ("sec_2", 8)]
    report = {r.doc_id: r.total for r in engine.analyze_files(spark.createDataFrame([("d", docx.compose(items, {}))], "doc_id string, content binary")).collect()}
    assert report["d"] > 5


class Taken:
    """Stands for files; keeps the function that is given to mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run


def test_files_are_handed_on_a_few_at_a_time(spark):
    import pyarrow as pa

    files = Taken()
    docx.read_facts(files)
    rows = [(str(n), docx.build([f"line {n} {i}" for i in range(1000)])) for n in range(20)] + [("bad", b"x")]
    given = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "content"])
    got = list(files.run(iter([given])))
    assert max(b.num_rows for b in got) < docx.MOST_ROWS + 1000 and sum(b.num_rows for b in got) == 20_001
    assert pa.Table.from_batches(got).column("doc_id").to_pylist() == [r[0] for r in rows[:-1] for _ in range(1000)] + ["bad"]
    made = list(docx._made(iter([pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x"] * 9)], ["doc_id", "text"])]), lambda t: b"0" * (docx.MOST_BYTES // 2)))
    assert [b.num_rows for b in made] == [2, 2, 2, 2, 1] and made[0].schema.field(0).type == pa.int64()


def test_body_text_is_justified_line_by_line(spark):
    """The issue names a document; its edits name every long line that isn't justified, but for one that is centred for itself."""
    from vellum.operators import fix

    long = "слово " * 20
    issues = spark.createDataFrame([("d", None, "body_text_not_justified"), ("d", 5, "formula_not_centered")], "doc_id string, paragraph_index int, subtype string")
    rows = [("d", 1, long, "left"), ("d", 2, long, None), ("d", 3, long, "justify"), ("d", 4, long, "center"), ("d", 5, long, "left"), ("d", 6, "short", "left"), ("e", 1, long, "left")]
    layout = spark.createDataFrame(rows, "doc_id string, paragraph_index int, text string, alignment string")
    forms = spark.createDataFrame([], "doc_id string, ord int, paragraph_index int, text string, equation_number string, raw_equation_number string, appendix_letter string, is_standalone boolean, next_text string")
    plan = fix.edits_of(issues, layout, forms).select("doc_id", "paragraph_index", "op", "arg")
    assert sorted(map(tuple, plan.collect())) == [("d", 1, "align", "justify"), ("d", 2, "align", "justify"), ("d", 5, "align", "center")]


def test_rows_are_placed_by_one_sort_and_one_squeeze(spark, capsys):
    """Starts of lines tell what whole lines would; a text is squeezed in one column, and a formula looks ahead once."""
    from pyspark.sql import functions as F

    from vellum.functions.text import squeeze
    from vellum.operators import assemble, parse

    said = [
        "Приложение А " + "слово " * 20, "приложение Б", "Приложениеб", "Приложение Аб", "Рисунок 7 — " + "вид " * 30, "рис.12", "Рисунки", "Таблица\t\tА.1 " + "х" * 40, "таблица 2", "Таблица А",
        "  Введение ", "Список  использованных\nисточников", "1.2 " + "Т" * 196, "1.2 " + "Т" * 197, "y = kx + 1 (2)", "y = x", "текст", "", None, " ",
    ]
    facts = spark.createDataFrame([("d", "paragraph", i, t) for i, t in enumerate(said, 1)], "doc_id string, kind string, i int, text string")
    facts = facts.selectExpr("doc_id", "kind", "i", "text", *(f"cast(null as {t}) as {n}" for n, t in (x.split() for x in docx.FACTS.split(", ")) if n not in ("doc_id", "kind", "i", "text")))
    x = assemble.placed(facts.fillna(False, ["drawing", "has_math"]))
    for p in (parse.APPENDIX, parse.FIGURE, parse.TABLE):
        assert x.where(F.left("t", F.lit(assemble.LONGEST_START)).rlike(p) != squeeze("text").rlike(p)).count() == 0
    kinds = [r.kind for r in x.orderBy("pos").collect()]
    assert kinds == ["heading"] * 2 + ["para"] * 2 + ["figure"] * 2 + ["para"] + ["table"] * 2 + ["para"] + ["heading"] * 3 + ["para"] + ["formula"] * 2 + ["para"] + ["blank"] * 3
    x.explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1
    x.explain("extended")
    assert capsys.readouterr().out.split("== Optimized")[1].split("== Physical")[0].count("regexp_replace(") <= 2
    assemble.corpus(facts.fillna(False, ["drawing", "has_math"]))["formulas"].explain()
    assert "unboundedfollowing" not in capsys.readouterr().out


def test_a_footer_is_read_once_for_equal_files():
    page = {"page_field": True, "footer_alignment": "right"}
    content = docx.compose([{"text": "слово"}], page)
    docx._remembered.cache_clear()
    rows = [[f for f in docx.facts(content) if f["kind"] == "section"][0] for _ in range(3)]
    assert docx._remembered.cache_info().misses == 1 and all(r["page_field"] and r["footer_alignment"] == "right" for r in rows)


def test_files_are_read_and_checked_once(spark, monkeypatch):
    """Issues are those of all checks at once; what relations were made from goes, and nothing is read again for the edits."""
    from vellum.operators import formatting as K
    from vellum.plans import engine as E
    from vellum.sources import scratch

    lines = [(d, n, t) for d in (1, 2) for n, t in enumerate(["1 Введение", "Текст короче говоря", "Рисунок 1 - Схема.", "Таблица 1 - Данные", "y = kx + 5 (1)"])]
    files = docx.written(spark.createDataFrame(lines, "doc_id long, line int, text string"))
    want = E.formatting_issues(E.read_files(files)).select("issue_id", "subtype").collect()
    first, read = scratch.made(), []
    monkeypatch.setattr(docx, "read_facts", lambda f, real=docx.read_facts: read.append(1) or real(f))
    checked = E.checked_files(files)
    assert sorted(map(tuple, checked[1].select("issue_id", "subtype").collect())) == sorted(map(tuple, want)) and len(want) > 4
    left = [p for p in scratch._MADE[first:] if p]
    assert not [p for p in left if "vellum-facts" in p or "vellum-placed" in p]
    fixed, plan = E.fixed_files(files, checked)
    assert fixed.count() == 2 and plan.count() and len(read) == 1
    assert {len(x) for x in (K.CONTENTS, K.REFERENCES)} and K.missing_contents(*E._relations(checked[0])[:3], checked[0].more["para_layout"]).count() == 2
