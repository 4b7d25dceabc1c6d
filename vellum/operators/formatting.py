"""Formatting checks over captions, layout, numbering and formulas.

A base relation is read once: its predicates become an array of subtypes that is exploded, not a scan per check.
Issue rows are (doc_id, ord, section_id, paragraph_id, paragraph_index, page, subtype, severity); ord is the item's
place in its relation, the next four its place in the document (a figure's or table's id is its paragraph_id), null
where the relation doesn't have them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import blank, folded, number_key, squeeze

# Patterns of captions and titles, words of a title page, tolerances in millimetres and points.
FIGURE = r"(?iu)^(?:рисунок|рисуно|рис\.?)\s*\d+(?:\.\d+)*\s*[—–-]?\s*(.*)$"
NUMBER = r"(\d+(?:\.\d+)*)"
TABLE = r"^Таблица\s+(?:[А-ЯЁA-Z]\.)?\d+(?:\.\d+)*\s*[—–-]\s*(.+)$"
DASH = r" [-—–] "
APPENDIX = r"(?iu)^приложение(\s+[А-ЯЁA-Z](?![\p{L}]))?(\s*[-–—]\s*.+|\s+.+)?$"
STRUCTURAL = [
    "содержание", "оглавление", "реферат", "список использованных источников", "список литературы",
    "библиографический список", "источники и литература",
]
CONTENTS = ["содержание", "оглавление"]
REFERENCES = ["список использованных источников", "список литературы", "библиограф", "библиографический список", "источники и литература"]
TITLE_ORGANISATION = ["министерство", "университет", "институт", "академия", "кафедра", "факультет", "колледж"]
TITLE_DOCUMENT = [
    "отчет", "пояснительная записка", "курсовая работа", "дипломная работа", "выпускная квалификационная работа",
    "лабораторная работа", "проект",
]
TITLE_SIGNATURE = ["выполнил", "проверил", "руководитель", "нормоконтроль", "студент", "группа"]
TITLE_CENTRE = ["отчет", "тема", "работа", "проект"]
TITLE_KEYWORDS = ["отчет", "тема", "выполнил", "проверил", "руководитель", "университет", "кафедра"]
TITLE_YEAR = r"(?<![\p{L}\p{N}_])(?:19|20)\d{2}(?![\p{L}\p{N}_])"
GENERIC = ["рисунок", "таблица", "приложение"]
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\.?\s+[А-ЯЁA-Z].+$"
WRONG_MARKER = r"^(?:[•●▪*]|\d+\.|[A-Za-zА-Яа-яЁё]\.)\s+"
MARKER = r"(?iu)^(?:[-–—]|\d+\)|[а-яёa-z]\))\s+"
EXPLANATION = r"^[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9_]*\s*[—–-]\s*.+$"
BREAK = r"([=+*/-])\s*$"
MARGINS = [("left_margin_mm", 30.0), ("right_margin_mm", 15.0), ("top_margin_mm", 20.0), ("bottom_margin_mm", 20.0)]
MARGIN_TOLERANCE, PAGE_TOLERANCE = 1.5, 3.0
PAGES = [(210.0, 297.0), (297.0, 420.0)]
INDENT, INDENT_TOLERANCE, SPACING, SPACING_TOLERANCE, LEAST_FONT = 12.5, 1.5, 1.5, 0.15, 12.0


#: Fixed: the (object type, constraint type) of the rule that each issue is about; a second one stands in for a rule that is missing.
_CAPTION, _TABLE, _HEADING, _REPORT = ("figure", "caption_required"), ("table", "caption_required"), ("heading", "optional_allowed"), ("report", "formatting")
_FORMULA, _FORMULA_NUMBER, _FORMULA_WHERE, _APPENDIX = ("formula", "any"), ("formula", "numbering"), ("formula", "generic"), ("appendix", "formatting")
RULE_OF = {
    "missing_figure_caption": [_CAPTION],
    "invalid_figure_caption_format": [_CAPTION],
    "figure_caption_trailing_period": [_CAPTION],
    "figure_caption_not_centered": [_CAPTION],
    "missing_figure_reference": [("figure", "reference_required")],
    "figure_numbering_error": [("figure", "numbering")],
    "missing_table_caption": [_TABLE],
    "invalid_table_caption_format": [_TABLE],
    "table_caption_below_table": [_TABLE],
    "invalid_table_header_punctuation": [_TABLE],
    "table_header_alignment": [_TABLE],
    "missing_table_reference": [("table", "reference_required")],
    "appendix_table_caption_format": [_APPENDIX, _TABLE],
    "formula_not_standalone": [_FORMULA],
    "formula_not_centered": [_FORMULA],
    "formula_missing_blank_lines": [_FORMULA],
    "formula_break_invalid": [_FORMULA],
    "formula_number_format_error": [_FORMULA_NUMBER],
    "missing_formula_number": [_FORMULA_NUMBER],
    "appendix_formula_numbering_error": [_FORMULA_NUMBER],
    "invalid_formula_reference_format": [_FORMULA_NUMBER],
    "missing_formula_reference": [_FORMULA_NUMBER],
    "formula_numbering_error": [_FORMULA_NUMBER],
    "formula_where_colon": [_FORMULA_WHERE],
    "formula_explanation_format_error": [_FORMULA_WHERE],
    "missing_contents_section": [("contents", "required_presence")],
    "missing_title_page": [("title_page", "required_presence")],
    "body_text_not_justified": [("title_page", "formatting")],
    "invalid_page_size": [_REPORT, _APPENDIX],
    "invalid_page_margins": [_REPORT, _APPENDIX],
    **{
        k: [_REPORT, ("report", "any")] for k in (
            "missing_page_numbering", "page_number_not_centered", "page_number_in_header", "title_page_number_visible",
            "page_numbering_restart",
        )
    },
    **{
        k: [_REPORT, _APPENDIX] for k in (
            "invalid_first_line_indent", "invalid_line_spacing", "invalid_font_size", "invalid_font_family",
            "invalid_font_color", "unexpected_bold_text",
        )
    },
    "invalid_enumeration_marker": [_REPORT],
    "enumeration_indent_invalid": [_REPORT],
    "missing_references_section": [("references", "required_presence")],
    "empty_references_section": [("references", "formatting"), ("references", "required_presence")],
    "heading_trailing_period": [("heading", "generic"), _HEADING],
    **{
        k: [_HEADING] for k in (
            "empty_section_heading", "appendix_heading_not_centered", "appendix_heading_single_line",
            "structural_heading_numbered", "structural_heading_not_uppercase", "structural_heading_not_centered",
            "structural_heading_has_indent", "structural_heading_invalid_font_color", "main_heading_centered",
            "main_heading_indent_invalid", "heading_invalid_font_color",
        )
    },
    "missing_section_number": [("section", "numbering")],
    "invalid_appendix_heading": [_APPENDIX],
    "missing_appendix_reference": [("appendix", "reference_required")],
}
#: Checks that need a rule of the standard.
GATED = ("missing_figure_reference", "missing_table_reference", "missing_appendix_reference")


PLACE = {"section_id": "string", "paragraph_id": "string", "paragraph_index": "int", "page": "int"}


def place(df: DataFrame) -> list[Column]:
    """The columns that say where an item of df is."""
    def one(c: str) -> Column:
        c = "item_id" if c == "paragraph_id" and c not in df.columns else c
        return F.col(c) if c in df.columns else F.lit(None)

    return [one(c).cast(t).alias(c) for c, t in PLACE.items()]


def issue(df: DataFrame, subtype: str, severity: str) -> DataFrame:
    """Every row of df as an issue."""
    return df.select("doc_id", "ord", *place(df), F.lit(subtype).alias("subtype"), F.lit(severity).alias("severity"))


def found(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """Rows of df times the checks (subtype, severity, predicate) that hold."""
    every = F.array_compact(
        F.array(
            *[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(s).alias("subtype"), F.lit(v).alias("severity"))) for s, v, p in checks]
        )
    )
    return df.select("doc_id", "ord", *place(df), F.explode(every).alias("x")).select("doc_id", "ord", *PLACE, "x.subtype", "x.severity")


def rule_pick(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each standard and wanted (object_type, constraint_type): the rule of the object with the smallest number, among those with the constraint if there are any."""
    own = [c for c in ("standard_id",) if c in rules.columns]
    # what is wanted is a list of the program; dealt by the few types of objects, most rules would meet in one task
    j = F.broadcast(wanted).join(rules, "object_type").withColumn("soft", rules["constraint_type"] == wanted["constraint_type"])
    w = W.partitionBy(*own, "object_type", wanted["constraint_type"]).orderBy(F.col("soft").desc(), number_key("number"), "ord")
    j = j.withColumn("n", F.row_number().over(w)).where("n = 1")
    quote = F.substring(squeeze(F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.col("title"))), 1, 280)
    return j.select(*own, "object_type", wanted["constraint_type"].alias("constraint_type"), "rule_id", "number", quote.alias("quote"))


def rules_of_issues(rules: DataFrame) -> DataFrame:
    """(standard_id, subtype, rule_id, quote): the rule that each kind of issue is about; a row for each of both at most."""
    pairs = [(subtype, i, *pair) for subtype, some in RULE_OF.items() for i, pair in enumerate(some)]
    wanted = rules.sparkSession.createDataFrame(pairs, "subtype string, turn int, object_type string, constraint_type string")
    picked = rule_pick(rules, wanted.select("object_type", "constraint_type").distinct())
    j = F.broadcast(wanted).join(picked, ["object_type", "constraint_type"])
    w = W.partitionBy("standard_id", "subtype").orderBy("turn")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("standard_id", "subtype", "rule_id", "quote")


def with_rules(issues: DataFrame, docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues with the rule_id and quote of their document's standard; those that need a rule go where it has none."""
    j = issues.join(docs.select("doc_id", "standard_id"), "doc_id", "left").join(
        rules_of_issues(rules), ["standard_id", "subtype"], "left",
    ).drop("standard_id")
    return j.where(~F.col("subtype").isin(*GATED) | F.col("rule_id").isNotNull())


def _titled(c: Column, pattern: str, word: str) -> Column:
    """Is c a caption: the word, a dash between spaces, and a title beyond marks?"""
    return F.lower(c).startswith(word) & c.rlike(DASH) & c.rlike(pattern) & (F.btrim(F.regexp_extract(c, pattern, 1), F.lit(" .-—–")) != "")


def figures(figs: DataFrame, layout: DataFrame) -> DataFrame:
    at = layout.where("paragraph_index is not null").groupBy("doc_id", "paragraph_index").agg(F.max("alignment").alias("alignment"))
    f = figs.join(at, ["doc_id", "paragraph_index"], "left")
    none = blank("caption")
    return found(f, [
        ("missing_figure_caption", "warning", none),
        ("invalid_figure_caption_format", "warning", ~none & ~_titled(squeeze("caption"), FIGURE, "рисунок")),
        ("figure_caption_trailing_period", "info", ~none & squeeze("caption").endswith(".")),
        ("figure_caption_not_centered", "info", ~none & F.col("alignment").isNotNull() & (F.col("alignment") != "center")),
    ])


def figure_numbering(figs: DataFrame) -> DataFrame:
    """Numbers that repeat, or aren't the one after the last whole number (and what came since)."""
    n = figs.withColumn("number", F.regexp_extract("caption", NUMBER, 1)).where("number <> ''")
    n = n.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "number").orderBy("ord")))
    firsts = n.where("copy = 1")
    by = W.partitionBy("doc_id").orderBy("ord")
    firsts = firsts.withColumn("i", F.row_number().over(by)).withColumn(
        "whole", F.when(F.col("number").rlike(r"^\d+$"), F.col("number").cast("int")),
    )
    past = by.rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("whole").isNotNull(), F.struct("whole", "i")), True).over(past)
    firsts = firsts.withColumn("expected", F.coalesce(last["whole"], F.lit(0)) + F.col("i") - F.coalesce(last["i"], F.lit(0)))
    bad = firsts.where(F.col("number") != F.col("expected").cast("string")).select("doc_id", "ord", *place(n), "number")
    return n.where("copy > 1").select("doc_id", "ord", *place(n), "number").unionByName(bad).withColumn(
        "subtype", F.lit("figure_numbering_error"),
    ).withColumn("severity", F.lit("warning"))


def _said(docs_: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, t): all paragraphs and section texts, lower-cased."""
    return paragraphs.select("doc_id", F.lower(squeeze("text")).alias("t")).unionByName(
        sections.select("doc_id", F.lower(squeeze("text")).alias("t"))
    )


def unmentioned(items: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Items (doc_id, ord, fragments) that their document's text doesn't refer to.

    It does if it holds a fragment of 8 characters or more, or one of the words of GENERIC that a fragment holds.
    """
    f = items.withColumn("f", F.transform("fragments", lambda x: F.lower(squeeze(x))))
    asked = F.concat(
        F.filter("f", lambda x: F.length(x) >= 8),
        F.filter(F.array(*map(F.lit, GENERIC)), lambda w: F.exists(F.col("f"), lambda x: F.contains(x, w))),
    )
    f = f.withColumn("asked", F.array_distinct(asked))
    hit = f.select("doc_id", "ord", "asked").join(_said(items, sections, paragraphs), "doc_id").where(
        F.exists("asked", lambda a: F.contains(F.col("t"), a))
    )
    return f.join(hit.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_anti").drop("f", "asked")


def figure_references(figs: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Figures with a caption that nothing refers to: no text before them names a figure and their number; those without a place are judged on the whole document."""
    f = figs.where(~blank("caption")).withColumn("number", F.regexp_extract(squeeze("caption"), NUMBER, 1))
    p = paragraphs.where("paragraph_index is not null").select(
        "doc_id", F.col("paragraph_index").alias("at"), F.lower(squeeze("text")).alias("t"),
    )
    j = f.where("paragraph_index is not null").join(p, "doc_id").where("at < paragraph_index")
    g = j.groupBy("doc_id", "ord").agg(
        F.max(F.contains("t", F.lit("рис"))).alias("word"),
        F.max((F.col("number") == "") | F.contains("t", "number")).alias("numbered"),
    )
    placed = f.where("paragraph_index is not null").join(g.where("word and numbered"), ["doc_id", "ord"], "left_anti").drop("number")
    loose = f.where("paragraph_index is null").drop("number").withColumn(
        "fragments", F.array(F.lit("рисунок"), F.lit("рис."), F.lit("рис"), F.col("caption")),
    )
    return issue(placed.unionByName(unmentioned(loose, sections, paragraphs).drop("fragments")), "missing_figure_reference", "info")


def table_references(tabs: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    t = tabs.where(~blank("caption")).withColumn("fragments", F.array(F.lit("таблица"), F.col("caption")))
    return issue(unmentioned(t, sections, paragraphs), "missing_table_reference", "info")


def tables(tabs: DataFrame, layout: DataFrame) -> DataFrame:
    """Captions, with the layout found by the caption's index, else by the table's place in the document."""
    t = tabs.withColumn("i", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1)
    l1 = layout.select(
        "doc_id", F.col("caption_paragraph_index").alias("paragraph_index"),
        F.struct("caption_position", "header_text", "header_alignment", "appendix_letter").alias("a"),
    )
    l2 = layout.select(
        "doc_id", F.col("table_index").alias("i"),
        F.struct("caption_position", "header_text", "header_alignment", "appendix_letter").alias("b"),
    )
    t = t.join(l1, ["doc_id", "paragraph_index"], "left").join(l2, ["doc_id", "i"], "left").withColumn("l", F.coalesce("a", "b"))
    none = blank("caption")
    return found(t, [
        ("missing_table_caption", "warning", none),
        ("invalid_table_caption_format", "warning", ~none & ~_titled(squeeze("caption"), TABLE, "таблица")),
        ("table_caption_below_table", "warning", ~none & (F.col("l.caption_position") == "below")),
        ("invalid_table_header_punctuation", "warning", ~none & squeeze("l.header_text").endswith(".")),
        ("table_header_alignment", "info", ~none & (F.col("l.header_alignment") != "center")),
        (
            "appendix_table_caption_format", "warning",
            ~none & F.col("l.appendix_letter").isNotNull() & ~F.regexp(
                squeeze("caption"),
                F.concat(F.lit(r"(?iu)^таблица\s+"), F.col("l.appendix_letter"), F.lit(r"\.\d+\s*[—–-]\s*.+$")),
            ),
        ),
    ])


def _formula_ids(forms: DataFrame) -> DataFrame:
    """Formulas are known by their paragraph_index; those without one get an id by their place."""
    return forms.withColumn("paragraph_id", F.when(F.col("paragraph_index").isNull(), F.concat(F.lit("formula_"), "ord")))


def formulas(forms: DataFrame) -> DataFrame:
    number = F.coalesce("equation_number", F.lit(""))
    k = F.row_number().over(W.partitionBy("doc_id", "appendix_letter").orderBy("ord"))
    want = forms.where("equation_number is not null and appendix_letter is not null").select(
        "doc_id", "ord", F.concat("appendix_letter", F.lit("."), k).alias("want"),
    )
    f = _formula_ids(forms.join(want, ["doc_id", "ord"], "left"))
    after, own = squeeze("next_text"), squeeze("text")
    where = F.lower(after).startswith("где")
    sign = F.regexp_extract(own, BREAK, 1)
    below = F.coalesce("next_blank", F.lit(False)) | where
    return found(f, [
        ("formula_not_standalone", "warning", ~F.coalesce("is_standalone", F.lit(False))),
        ("formula_not_centered", "info", F.coalesce("alignment", F.lit("")) != "center"),
        ("formula_missing_blank_lines", "info", ~(F.coalesce("prev_blank", F.lit(False)) & below)),
        ("formula_number_format_error", "warning", (number == "") & (F.coalesce("raw_equation_number", F.lit("")) != "")),
        ("missing_formula_number", "warning", (number == "") & (F.coalesce("raw_equation_number", F.lit("")) == "")),
        ("appendix_formula_numbering_error", "warning", F.col("want").isNotNull() & (number != F.col("want"))),
        ("formula_where_colon", "info", after.startswith("где:")),
        # an explanation begins with "где"; a formula that breaks after a sign goes on with the same sign
        ("formula_explanation_format_error", "warning", ~where & after.rlike(EXPLANATION)),
        ("formula_break_invalid", "warning", (sign != "") & (after != "") & ~where & ~F.startswith(after, sign)),
    ])


def formula_numbering(forms: DataFrame) -> DataFrame:
    """Among whole numbers, of which there must be two: repeats, and those that aren't one more than the last."""
    n = forms.where(F.col("equation_number").rlike(r"^\d+$")).withColumn("n", F.col("equation_number").cast("int"))
    by = W.partitionBy("doc_id")
    n = n.withColumn("many", F.count(F.lit(1)).over(by)).withColumn(
        "copy", F.row_number().over(W.partitionBy("doc_id", "n").orderBy("ord")),
    ).withColumn("before", F.coalesce(F.lag("n").over(by.orderBy("ord")), F.lit(0)))
    return issue(
        _formula_ids(n.where((F.col("many") >= 2) & ((F.col("copy") > 1) | (F.col("n") != F.col("before") + 1)))),
        "formula_numbering_error", "warning",
    )


def formula_references(forms: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """ok, invalid (a number without parentheses) or missing: how the text before a formula refers to it."""
    f = forms.where("equation_number is not null").select("doc_id", "ord", "paragraph_index", "equation_number")
    p = paragraphs.select("doc_id", F.col("paragraph_index").alias("at"), F.lower("text").alias("t"))
    num = F.replace("equation_number", F.lit("."), F.lit(r"\."))
    ok = F.regexp(F.col("t"), F.concat(F.lit(r"(?iu)формул\p{L}*\s*\("), num, F.lit(r"\)")))
    bare = F.regexp(F.col("t"), F.concat(F.lit(r"(?iu)формул\p{L}*\s*"), num, F.lit(r"(?!\d)")))
    j = f.join(p, "doc_id", "left").withColumn("t", F.when(F.col("at") < F.col("paragraph_index"), F.col("t")))
    g = j.groupBy("doc_id", "ord").agg(
        F.max(F.coalesce(ok, F.lit(False)).cast("int")).alias("ok"),
        F.max(F.coalesce(bare, F.lit(False)).cast("int")).alias("bare"),
    )
    return g.select(
        "doc_id", "ord",
        F.when(F.col("ok") == 1, "ok").when(F.col("bare") == 1, "invalid").otherwise("missing").alias("status"),
    )


def _pool(sections: DataFrame, paragraphs: DataFrame, layout: DataFrame | None) -> DataFrame:
    p = sections.select("doc_id", folded("title").alias("t")).unionByName(paragraphs.select("doc_id", folded("text").alias("t")))
    if layout is not None:
        first = layout.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("paragraph_index"))).where("n <= 40")
        p = p.unionByName(first.select("doc_id", folded("text").alias("t")))
    return p


def _says(c: Column, words: list[str]) -> Column:
    """Whether one of the words occurs: by one pattern, for c is worked out again for each test that is pushed down to its text."""
    return c.rlike("|".join(f"\\Q{w}\\E" for w in words))


def missing_contents(docs: DataFrame, sections: DataFrame, paragraphs: DataFrame, layout: DataFrame) -> DataFrame:
    have = _pool(sections, paragraphs, layout).where(_says(F.col("t"), CONTENTS)).select("doc_id").distinct()
    return issue(docs.join(have, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("ord")), "missing_contents_section", "warning")


def title_pages(layout: DataFrame) -> DataFrame:
    """doc_id of the documents whose first 30 lines look like a title page.

    They score for an organisation, a kind of document, a signature, a centred title word, a signature on the right and
    a year, and for four of the usual words; or they have six lines, some centred or on the right, and one of these.
    """
    l = layout.withColumn(
        "n", F.row_number().over(W.partitionBy("doc_id").orderBy("paragraph_index")),
    ).where("n <= 30").where(~blank("text")).withColumn("t", F.lower(squeeze("text")))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    t, mid, right = F.col("t"), F.col("alignment") == "center", F.col("alignment") == "right"
    g = l.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(mid).alias("centred"), F.count_if(right).alias("righted"),
        flag(_says(t, TITLE_ORGANISATION)).alias("org"), flag(_says(t, TITLE_DOCUMENT)).alias("kind"), flag(_says(t, TITLE_SIGNATURE)).alias("signed"),
        flag(mid & _says(t, TITLE_CENTRE)).alias("mid"), flag(
            right & _says(t, TITLE_SIGNATURE)
        ).alias("side"), flag(t.rlike(TITLE_YEAR)).alias("year"),
        *(flag(F.contains("t", F.lit(w))).alias(f"w{i}") for i, w in enumerate(TITLE_KEYWORDS)),
    )
    words = sum((F.col(f"w{i}") for i in range(len(TITLE_KEYWORDS))), F.lit(0))
    total = sum((F.col(c) for c in ("org", "kind", "signed", "mid", "side", "year")), (words >= 4).cast("int"))
    core = F.greatest("org", "kind", "signed")
    shaped = (F.col("lines") >= 6) & ((F.col("centred") >= 2) | (F.col("righted") >= 1)) & (F.greatest(core, "year") == 1)
    return g.where(((core == 1) & (total >= 3)) | shaped).select("doc_id")


def missing_title_page(docs: DataFrame, layout: DataFrame) -> DataFrame:
    return issue(
        docs.join(title_pages(layout), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("page")),
        "missing_title_page", "warning",
    )


def body_lines(layout: DataFrame) -> DataFrame:
    """Long lines that aren't centred or right."""
    return layout.where((F.length("text") >= 80) & ~F.coalesce("alignment", F.lit("")).isin("center", "right"))


def not_justified(layout: DataFrame) -> DataFrame:
    """Documents with a title page in which many long lines that aren't centred or right, three at least, are not justified."""
    l = body_lines(layout.join(title_pages(layout), "doc_id", "left_semi"))
    g = l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("alignment", F.lit("")) != "justify").alias("bad"))
    g = g.where(F.col("bad") >= F.greatest(F.lit(3), F.expr("n div 2"))).select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("page"))
    return issue(g, "body_text_not_justified", "info")


def page_size(pages: DataFrame) -> DataFrame:
    a, b = F.least("page_width_mm", "page_height_mm"), F.greatest("page_width_mm", "page_height_mm")
    ok = F.lit(False)
    for w, h in PAGES:
        ok = ok | ((F.abs(a - w) <= PAGE_TOLERANCE) & (F.abs(b - h) <= PAGE_TOLERANCE))
    known = F.col("page_width_mm").isNotNull() & F.col("page_height_mm").isNotNull()
    return found(
        pages.withColumn("ord", F.col("section_index")).withColumn("page", F.lit(1)),
        [("invalid_page_size", "warning", known & ~ok)],
    )


def margins(pages: DataFrame) -> DataFrame:
    """A margin off its measure; one that is missing before ends the test."""
    bad = F.lit(False)
    for c, mm in reversed(MARGINS):
        bad = F.when(F.col(c).isNull(), False).when(F.abs(F.col(c) - mm) > MARGIN_TOLERANCE, True).otherwise(bad)
    return found(pages.withColumn("ord", F.col("section_index")).withColumn("page", F.lit(1)), [("invalid_page_margins", "warning", bad)])


def page_numbering(numbering: DataFrame) -> DataFrame:
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    first = F.min_by(F.struct("different_first_page", "first_footer_field"), "section_index")
    g = numbering.groupBy("doc_id").agg(
        yes(F.col("footer_field")).alias("any"), yes(
            F.col("footer_field") & (F.col("footer_alignment") != "center")
        ).alias("off"), yes(F.col("header_field")).alias("head"), first.alias("first"),
        yes((F.col("section_index") > 0) & F.col("page_number_start").isNotNull() & (F.col("page_number_start") != 0)).alias("restart"),
    ).withColumn("ord", F.lit(0)).withColumn("page", F.lit(1))
    some = F.col("any") | F.col("head")
    return found(g, [
        ("missing_page_numbering", "warning", ~some),
        ("page_number_not_centered", "warning", some & F.col("off")),
        ("page_number_in_header", "warning", F.col("head")),
        (
            "title_page_number_visible", "warning",
            some & (~F.coalesce("first.different_first_page", F.lit(False)) | F.coalesce("first.first_footer_field", F.lit(False))),
        ),
        ("page_numbering_restart", "warning", some & F.col("restart")),
    ])


def typography(paragraphs: DataFrame, layout: DataFrame) -> DataFrame:
    """The first offender of each kind among a document's body paragraphs."""
    p = paragraphs.where("section_id is not null and paragraph_index is not null").where(F.length("text") >= 20)
    p = p.select("doc_id", "ord", *place(p))
    j = p.join(layout, ["doc_id", "paragraph_index"])
    every = found(j, [
        ("invalid_first_line_indent", "warning", F.abs(F.col("first_line_indent_mm") - INDENT) > INDENT_TOLERANCE),
        ("invalid_line_spacing", "warning", F.abs(F.col("line_spacing") - SPACING) > SPACING_TOLERANCE),
        ("invalid_font_size", "warning", F.col("font_size_pt_min") < LEAST_FONT),
        ("invalid_font_family", "warning", F.lower("font_family") != "times new roman"),
        ("invalid_font_color", "warning", F.col("has_non_black_text")),
        ("unexpected_bold_text", "info", F.col("has_bold_text")),
    ])
    return every.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "subtype").orderBy("ord"))).where("n = 1").drop("n")


def enumerations(paragraphs: DataFrame, layout: DataFrame, heading_layout: DataFrame | None = None) -> DataFrame:
    """Markers of enumerations; headings are none, and neither are lines that look like numbered ones."""
    p = paragraphs
    if heading_layout is not None:
        p = p.join(
            heading_layout.select("doc_id", "paragraph_index").where("paragraph_index is not null").distinct(),
            ["doc_id", "paragraph_index"], "left_anti",
        )
    p = p.join(layout.select("doc_id", "paragraph_index", "first_line_indent_mm"), ["doc_id", "paragraph_index"], "left")
    t = squeeze("text")
    free = ~t.rlike(NUMBERED_HEADING)
    wrong, right = free & t.rlike(WRONG_MARKER), free & t.rlike(MARKER)
    return found(
        p,
        [
            ("invalid_enumeration_marker", "warning", wrong),
            ("enumeration_indent_invalid", "info", ~wrong & right & (F.abs(F.col("first_line_indent_mm") - INDENT) > INDENT_TOLERANCE)),
        ],
    )


def reference_section(
    docs: DataFrame, sections: DataFrame, paragraphs: DataFrame | None = None, layout: DataFrame | None = None,
) -> DataFrame:
    """Documents without a list of sources, or with an empty one; one that only a paragraph mentions counts as empty."""
    s = sections.where(_says(F.lower(squeeze("title")), REFERENCES)).groupBy("doc_id").agg(
        F.min_by("text", "ord").alias("text"), F.min_by("section_id", "ord").alias("section_id"),
        F.min("ord").alias("ord"),
    )
    d = docs.select("doc_id").join(s, "doc_id", "left")
    said = None
    for df in (paragraphs, layout):
        if df is not None:
            one = df.where(_says(F.lower(squeeze("text")), REFERENCES)).select("doc_id")
            said = one if said is None else said.unionByName(one)
    said = d.select("doc_id").where(F.lit(False)) if said is None else said
    d = d.join(said.distinct().withColumn("said", F.lit(True)), "doc_id", "left")
    absent, said_only = F.col("ord").isNull(), F.col("ord").isNull() & F.coalesce("said", F.lit(False))
    d = d.withColumn("none", absent & ~said_only).withColumn("bare", said_only | ~absent & (F.length(squeeze("text")) < 20))
    d = d.withColumn(
        "section_id", F.when(said_only, "sec_references_detected").otherwise(F.col("section_id")),
    ).withColumn("ord", F.coalesce("ord", F.lit(0)))
    return found(d, [("missing_references_section", "warning", F.col("none")), ("empty_references_section", "warning", F.col("bare"))])


def _placed(s: DataFrame) -> DataFrame:
    """Sections with the index of their heading: their own, else that of the layout (at)."""
    return s.withColumn("paragraph_index", F.coalesce("paragraph_index", "at") if "paragraph_index" in s.columns else F.col("at"))


def headings(sections: DataFrame, heading_layout: DataFrame) -> DataFrame:
    s = _placed(
        sections.join(
            heading_layout.select("doc_id", "section_id", "alignment", F.col("paragraph_index").alias("at")),
            ["doc_id", "section_id"], "left",
        )
    )
    t = squeeze("title")
    structural, appendix = folded("title").isin(STRUCTURAL), folded("title").startswith("приложение")
    known = F.col("alignment").isNotNull()
    return found(s, [
        ("empty_section_heading", "warning", t == ""),
        ("heading_trailing_period", "info", t.endswith(".")),
        ("appendix_heading_single_line", "warning", t.rlike(r"(?iu)^приложение\s+[а-яёa-z](?:\s*[—–-]\s*\S|\s+\S)")),
        ("appendix_heading_not_centered", "info", appendix & known & (F.col("alignment") != "center")),
        ("structural_heading_numbered", "warning", structural & (F.coalesce("number", F.lit("")) != "")),
        ("structural_heading_not_uppercase", "info", structural & (t != F.upper(t))),
        ("structural_heading_not_centered", "info", structural & known & (F.col("alignment") != "center")),
        ("main_heading_centered", "info", (t != "") & ~structural & ~appendix & (F.col("alignment") == "center")),
        ("invalid_appendix_heading", "warning", F.contains(folded("title"), F.lit("прилож")) & ~t.rlike(APPENDIX)),
    ])


def heading_layouts(sections: DataFrame, heading_layout: DataFrame, layout: DataFrame) -> DataFrame:
    """Indent and colour of headings, from the layout of their paragraph."""
    at = layout.select("doc_id", "paragraph_index", "first_line_indent_mm", "has_non_black_text")
    s = sections.drop("paragraph_index").join(
        heading_layout.select("doc_id", "section_id", "paragraph_index"), ["doc_id", "section_id"],
    ).join(at, ["doc_id", "paragraph_index"])
    structural, appendix = folded("title").isin(STRUCTURAL), folded("title").startswith("приложение")
    indent = F.col("first_line_indent_mm")
    return found(s, [
        ("structural_heading_has_indent", "info", structural & (F.abs(indent) > 0.5)),
        ("structural_heading_invalid_font_color", "info", structural & F.col("has_non_black_text")),
        (
            "main_heading_indent_invalid", "info",
            (squeeze("title") != "") & ~structural & ~appendix & F.coalesce(F.abs(indent - INDENT) > INDENT_TOLERANCE, F.lit(True)),
        ),
        ("heading_invalid_font_color", "info", (squeeze("title") != "") & ~structural & ~appendix & F.col("has_non_black_text")),
    ])


def appendix_references(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Appendices that no text refers to."""
    a = sections.where(F.contains(folded("title"), F.lit("прилож"))).withColumn("fragments", F.array(F.col("title"), F.lit("приложение")))
    return issue(unmentioned(a, sections, paragraphs), "missing_appendix_reference", "info")


def missing_numbers(sections: DataFrame) -> DataFrame:
    """Sections without a number on a level where two others have one; structural parts need none."""
    some = F.count_if(F.coalesce("number", F.lit("")) != "").over(W.partitionBy("doc_id", "level")) >= 2
    s = sections.withColumn("some", some)
    free = folded("title").isin(STRUCTURAL)
    return found(s, [("missing_section_number", "warning", F.col("some") & (F.coalesce("number", F.lit("")) == "") & ~free)])


def fallback_location(sections: DataFrame, paragraphs: DataFrame, docs: DataFrame) -> DataFrame:
    """Where an issue without a place goes: the last section, else the last paragraph."""
    s, p = sections.groupBy("doc_id").agg(
        F.max_by("section_id", "ord").alias("section_id")
    ), paragraphs.groupBy("doc_id").agg(F.max_by("paragraph_id", "ord").alias("last"))
    j = docs.select("doc_id").join(s, "doc_id", "left").join(p, "doc_id", "left")
    return j.select("doc_id", "section_id", F.when(F.col("section_id").isNull(), F.col("last")).alias("paragraph_id"))


def issue_id(df: DataFrame) -> DataFrame:
    """A stable id from the issue's signature in place of a random one."""
    return df.withColumn(
        "issue_id",
        F.concat(F.lit("issue_rag_"), F.substring(F.sha2(F.concat_ws("|", "doc_id", "subtype", F.col("ord").cast("string")), 256), 1, 8)),
    )


#: The layout relations that the checks read; a corpus may have none of them.
LAYOUT = {
    "para_layout": "paragraph_index int, text string, alignment string, first_line_indent_mm double, line_spacing double, font_size_pt_min double, font_family string, has_bold_text boolean, has_non_black_text boolean",
    "table_layout": "table_index int, caption_paragraph_index int, caption_position string, header_text string, header_alignment string, appendix_letter string",
    "page_layout": "section_index int, page_width_mm double, page_height_mm double, left_margin_mm double, right_margin_mm double, top_margin_mm double, bottom_margin_mm double",
    "page_numbering": "section_index int, different_first_page boolean, footer_field boolean, footer_alignment string, header_field boolean, first_footer_field boolean, page_number_start int",
    "formulas": "ord int, paragraph_index int, text string, alignment string, is_standalone boolean, equation_number string, raw_equation_number string, prev_blank boolean, next_blank boolean, next_text string, appendix_letter string",
    "heading_layout": "section_id string, paragraph_index int, alignment string",
}


def no_layout(docs: DataFrame, name: str) -> DataFrame:
    """The relation of a corpus without it: no rows, which the optimizer knows."""
    cols = [c.split() for c in LAYOUT[name].split(", ")]
    return docs.where(F.lit(False)).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in cols])


def every_check(
    docs, sections, paragraphs, figs, tabs, layout, table_layout, page_layout, numbering, forms, heading_layout,
) -> list[DataFrame]:
    """What each check of check_formatting() finds."""
    forms = _formula_ids(forms)
    laid = docs.join(layout.select("doc_id").distinct(), "doc_id", "left_semi")
    absent = missing_contents(docs, sections, paragraphs, layout).unionByName(reference_section(docs, sections, paragraphs, layout))
    end = fallback_location(sections, paragraphs, docs).select("doc_id", F.col("section_id").alias("s"), F.col("paragraph_id").alias("p"))
    absent = absent.join(end, "doc_id", "left").withColumn(
        "paragraph_id", F.when(F.col("section_id").isNull(), F.col("p")),
    ).withColumn("section_id", F.coalesce("section_id", "s")).drop("s", "p")
    refs = formula_references(forms, paragraphs).where("status <> 'ok'").join(
        forms.select("doc_id", "ord", *place(forms)), ["doc_id", "ord"],
    )
    refs = refs.select(
        "doc_id", "ord", *PLACE,
        F.when(F.col("status") == "invalid", "invalid_formula_reference_format").otherwise("missing_formula_reference").alias("subtype"),
        F.lit("info").alias("severity"),
    )
    return [
        refs, figures(figs, layout), figure_numbering(figs).drop("number"), figure_references(figs, sections, paragraphs), tables(tabs, table_layout), table_references(tabs, sections, paragraphs), formulas(forms), formula_numbering(forms), absent,
        missing_title_page(laid, layout), not_justified(layout), page_size(page_layout), margins(page_layout), page_numbering(numbering), typography(paragraphs, layout), enumerations(
            paragraphs, layout, heading_layout,
        ), headings(sections, heading_layout), heading_layouts(
            sections, heading_layout, layout,
        ), appendix_references(sections, paragraphs), missing_numbers(sections),
    ]


def all_of(parts: list[DataFrame], docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Some checks' findings as issues."""
    every = reduce(DataFrame.unionByName, parts)
    return issue_id(every if rules is None else with_rules(every, docs, rules))


def check_formatting(docs: DataFrame, *relations: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every check. A title page is looked for where a document has a layout; what the whole document lacks is put at its end.

    With rules (and docs.standard_id) issues name the rule of their document's standard, and checks that need one are
    left out where it has none; without, all run. relations: sections, paragraphs, figures, tables and those of LAYOUT.
    """
    return all_of(every_check(docs, *relations), docs, rules)
