"""Corrections: text replacements, renumbering, captions, headings, and the plan of edits for a source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import blank, folded, squeeze
from .formatting import STRUCTURAL, body_lines

#: Titles that are counted without a number.
FREE = [*STRUCTURAL, "введение", "заключение", "термины и определения"]
# What an issue's subtype asks a paragraph to become.
ALIGN = {
    "figure_caption_not_centered": "center", "formula_not_centered": "center",
    "structural_heading_not_centered": "center", "appendix_heading_not_centered": "center",
    "main_heading_centered": "left", "body_text_not_justified": "justify",
}
EDITS = {
    "invalid_first_line_indent": "set_indent", "invalid_line_spacing": "set_spacing", "invalid_font_size": "set_font", "invalid_font_family": "set_font", "invalid_font_color": "set_color", "unexpected_bold_text": "clear_bold", "invalid_page_margins": "set_margins", "invalid_page_size": "set_page",
    "missing_page_numbering": "add_page_field", "page_number_not_centered": "center_page_field", "table_header_alignment": "center_header", "page_number_in_header": "clear_header_field", "title_page_number_visible": "hide_first_page", "page_numbering_restart": "clear_restart", "invalid_enumeration_marker": "fix_marker", "enumeration_indent_invalid": "set_indent", "heading_trailing_period": "strip_period",
    "figure_caption_trailing_period": "strip_period", "appendix_heading_single_line": "split_appendix", "main_heading_indent_invalid": "set_indent", "structural_heading_has_indent": "clear_indent", "heading_invalid_font_color": "set_color", "structural_heading_invalid_font_color": "set_color", "structural_heading_not_uppercase": "upper", "structural_heading_numbered": "strip_number", "table_caption_below_table": "move_caption_above", "invalid_table_header_punctuation": "strip_header_period", "formula_not_standalone": "split_formula", "missing_formula_number": "number_formula", "formula_number_format_error": "number_formula", "formula_numbering_error": "number_formula", "formula_where_colon": "where_without_colon", "missing_formula_reference": "insert_reference",
}


def apply_replacements(targets: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, target, text): each fix in order replaces the first `before`; a text without it becomes `after`."""
    f = fixes.groupBy("doc_id", "target").agg(F.array_sort(F.collect_list(F.struct("ord", "before", "after"))).alias("fixes"))

    def step(text: Column, x: Column) -> Column:
        at = F.call_function("locate", x["before"], text)
        return F.when(
            at > 0, F.concat(F.substr(text, F.lit(1), at - 1), x["after"], F.substr(text, at + F.length(x["before"]))),
        ).otherwise(x["after"])

    j = targets.join(f, ["doc_id", "target"], "left")
    return j.select(
        "doc_id", "target",
        F.when(F.col("fixes").isNull(), F.col("text")).otherwise(F.aggregate("fixes", F.col("text"), step)).alias("text"),
    )


def renumbered(sections: DataFrame) -> DataFrame:
    """Sections counted anew by level: structural titles and appendices lose their number; a level is at most one deeper than the last."""
    free = folded("title").isin(FREE) | folded("title").startswith("приложение")
    s = sections.select(
        "doc_id",
        F.struct("ord", "section_id", "title", F.coalesce("level", F.lit(1)).alias("level"), free.alias("free")).alias("s"),
    )
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    start = F.struct(
        F.array().cast("array<int>").alias("c"),
        F.array().cast("array<struct<section_id:string,number:string,level:int>>").alias("out"),
    )

    def step(a: Column, x: Column) -> Column:
        depth = F.least(x["level"], F.size(a["c"]) + 1)
        counted = F.concat(
            F.slice(a["c"], F.lit(1), F.greatest(depth - 1, F.lit(0))),
            F.array(F.coalesce(F.get(a["c"], depth - 1), F.lit(0)) + 1),
        )
        row = lambda n, lv: F.struct(x["section_id"].alias("section_id"), n.alias("number"), lv.cast("int").alias("level"))
        number = F.array_join(counted.cast("array<string>"), ".")
        return F.when(
            x["free"], F.struct(a["c"].alias("c"), F.array_append(a["out"], row(F.lit(""), F.lit(1))).alias("out")),
        ).otherwise(F.struct(counted.alias("c"), F.array_append(a["out"], row(number, depth)).alias("out")))

    r = g.select("doc_id", F.posexplode(F.aggregate("all", start, step)["out"]).alias("i", "r"))
    return r.select("doc_id", (F.col("i") + 1).alias("ord"), "r.section_id", "r.number", "r.level")


def added_sections(missing: DataFrame, sections: DataFrame) -> DataFrame:
    """Required sections that an issue's evidence names in «...» and the document lacks, numbered after its last top-level one."""
    name = F.regexp_extract("evidence", "«([^»]+)»", 1)
    have = sections.select("doc_id", folded("title").alias("t"))
    m = missing.select(
        "doc_id", "item_ord", name.alias("title"),
    ).where("title <> ''").withColumn("t", folded("title")).join(have, ["doc_id", "t"], "left_anti")
    top = sections.where(F.col("number").rlike(r"^\d+$")).groupBy("doc_id").agg(F.max(F.col("number").cast("int")).alias("top"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("item_ord"))
    return m.join(top, "doc_id", "left").select("doc_id", "title", (F.coalesce("top", F.lit(0)) + n).cast("string").alias("number"))


# What a caption's number and title are, and titles of captions without one.
FIGURE = r"(?iu)^(?:рисуно(?:к)?|рис\.?)\s*(\d+(?:\.\d+)*)\s*[—–-]?\s*(.*)$"
TABLE = r"(?iu)^таблиц(?:а)?\s+(?:[А-ЯЁA-Z]\.)?(\d+(?:\.\d+)*)\s*[—–-]?\s*(.*)$"
FIGURE_TITLE, TABLE_TITLE, APPENDIX_TITLE = "Иллюстрация ", "Сравнение показателей ", "Таблица приложения "


def _title(pattern: str, otherwise: Column) -> Column:
    found = F.btrim(F.regexp_extract(squeeze("caption"), pattern, 2), F.lit(" -—–"))
    return F.trim(F.rtrim(F.when(found != "", found).otherwise(otherwise), F.lit(".")))


def _number(pattern: str, place: Column) -> Column:
    """A caption's whole number, else the item's place."""
    return F.coalesce(F.regexp_extract(squeeze("caption"), pattern, 1).try_cast("int"), place)


def figure_captions(figs: DataFrame, anew: bool = True) -> DataFrame:
    """'Рисунок n - title', counted anew by place or with the caption's own number; blank captions stay."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))
    f = figs.withColumn("n", place if anew else _number(FIGURE, place))
    title = _title(FIGURE, F.concat(F.lit(FIGURE_TITLE), "n"))
    return f.select(
        "doc_id", "ord",
        F.when(squeeze("caption") == "", F.lit("")).otherwise(F.concat(F.lit("Рисунок "), "n", F.lit(" - "), title)).alias("caption"),
    )


def table_captions(tabs: DataFrame, layout: DataFrame) -> DataFrame:
    """'Таблица n - title' with the caption's own number, else the table's place; 'X.k' counted for each appendix; a caption without a title gets a made-up one."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))
    t = tabs.withColumn("i", place - 1).join(
        layout.select("doc_id", F.col("table_index").alias("i"), "appendix_letter"), ["doc_id", "i"], "left",
    )
    k = F.row_number().over(W.partitionBy("doc_id", "appendix_letter").orderBy("ord"))
    own = F.col("appendix_letter").isNull()
    t = t.withColumn("n", F.when(own, _number(TABLE, F.col("i") + 1).cast("string")).otherwise(F.concat("appendix_letter", F.lit("."), k)))
    title = _title(TABLE, F.when(own, F.concat(F.lit(TABLE_TITLE), "n")).otherwise(F.concat(F.lit(APPENDIX_TITLE), "appendix_letter")))
    return t.select("doc_id", "ord", F.concat(F.lit("Таблица "), "n", F.lit(" - "), title).alias("caption"))


def fixed_headings(sections: DataFrame) -> DataFrame:
    """Trailing periods go; structural titles are upper-cased and lose their number."""
    t = F.regexp_replace(squeeze("title"), r"\.+$", "")
    structural = folded(t).isin(STRUCTURAL)
    return sections.select(
        "doc_id", "ord", "section_id", F.when(structural, F.upper(t)).otherwise(t).alias("title"),
        F.when(structural, "").otherwise(F.col("number")).alias("number"),
    )


def formula_numbers(forms: DataFrame) -> DataFrame:
    """The number each formula should have, counted over all: n, or X.k in an appendix; and its normal text."""
    k = F.row_number().over(W.partitionBy("doc_id", "appendix_letter").orderBy("ord"))
    want = F.when(F.col("appendix_letter").isNull(), k.cast("string")).otherwise(F.concat("appendix_letter", F.lit("."), k))
    bare = F.trim(
        F.regexp_replace(F.regexp_replace("text", r"\s*\((?:[А-ЯЁA-Z]\.)?\d+(?:\.\d+)*\)\s*$", ""), r"(?<=\S)\s+\d+(?:\.\d+)*\s*$", "")
    )
    return forms.select("doc_id", "ord", want.alias("number"), F.concat(bare, F.lit(" ("), want, F.lit(")")).alias("text"))


def where_fixed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?u)^(\s*)([Гг]де):", "$1$2")


def marker_fixed(c: Column) -> Column:
    """'1. item' and 'а. item' get parentheses; bullets become a dash."""
    t = F.regexp_replace(c, r"^(\s*(?:\d+|[а-яё]))\.\s+", "$1) ")
    return F.regexp_replace(t, r"^(\s*)[•●▪*]\s*", "$1- ")


def reference_inserted(prev: Column, number: Column) -> Column:
    """The paragraph before a formula with a reference to it: as it is, with parentheses added, completed, or with a sentence more."""
    ok = F.regexp(prev, F.concat(F.lit(r"(?iu)формул\p{L}*\s*\("), number, F.lit(r"\)")))
    bare = F.regexp(prev, F.concat(F.lit(r"(?iu)формул\p{L}*\s+"), number, F.lit(r"(?!\d)")))
    added = F.regexp_replace(prev, F.concat(F.lit(r"(?iu)(формул\p{L}*)\s+("), number, F.lit(r")(?!\d)")), F.lit("$1 ($2)"))
    open_ = prev.rlike(r"(?iu)по формуле:\s*$")
    return F.when(ok, prev).when(bare, added).when(
        open_, F.regexp_replace(prev, F.lit(r"(?u):\s*$"), F.concat(F.lit(" ("), number, F.lit("):"))),
    ).otherwise(F.concat(F.trim(prev), F.lit(" Расчет ведут по формуле ("), number, F.lit(").")))


def refreshed_sections(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Section texts from their paragraphs in order; a section with an empty text stays empty."""
    p = paragraphs.groupBy("doc_id", "section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("body")
    )
    j = sections.join(p, ["doc_id", "section_id"], "left")
    return j.select(
        "doc_id", "ord", "section_id",
        F.when(F.coalesce("text", F.lit("")) == "", F.lit("")).otherwise(F.coalesce("body", "text")).alias("text"),
    )


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def edit_plan(issues: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """(doc_id, paragraph_index, op, arg, step): the edits that issues ask for, formulas from the end backwards so that inserts don't move later targets; paragraphs with drawings are left alone."""
    op, arg = _mapped(F.col("subtype"), EDITS), _mapped(F.col("subtype"), ALIGN)
    e = issues.select(
        "doc_id", "paragraph_index", F.when(arg.isNotNull(), "align").otherwise(op).alias("op"), arg.alias("arg"),
        "subtype",
    ).where("op is not null")
    if drawings is not None:
        e = e.join(drawings.select("doc_id", "paragraph_index"), ["doc_id", "paragraph_index"], "left_anti")
    e = e.select("doc_id", "paragraph_index", "op", "arg").distinct()
    return e.withColumn(
        "step",
        F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("paragraph_index").desc_nulls_last(), "op", "arg")),
    )


#: Edits whose argument is the number that a formula should have.
NUMBERING = ("number_formula", "split_formula", "insert_reference")


def _by_line(issues: DataFrame, layout: DataFrame) -> DataFrame:
    """Issues, with that of a document's body text as one for each line that the check counts; a line keeps an alignment that it is asked for itself."""
    body = (F.col("subtype") == "body_text_not_justified") & F.col("paragraph_index").isNull()
    lines = body_lines(layout).where(F.coalesce("alignment", F.lit("")) != "justify").select("doc_id", "paragraph_index")
    own = issues.where(F.col("subtype").isin(*ALIGN) & F.col("paragraph_index").isNotNull()).select("doc_id", "paragraph_index")
    each = issues.where(body).drop("paragraph_index").join(lines, "doc_id").join(own, ["doc_id", "paragraph_index"], "left_anti")
    return issues.where(~body).unionByName(each)


def edits_of(issues: DataFrame, layout: DataFrame, forms: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """edit_plan() with what an editor needs besides: the text that stands at the target now, and formulas' numbers counted anew.

    An edit finds its paragraph by its index and, where another text stands there, by this text.
    """
    plan = edit_plan(_by_line(issues, layout), drawings)
    plan = plan.join(layout.select("doc_id", "paragraph_index", "text"), ["doc_id", "paragraph_index"], "left")
    want = formula_numbers(forms).join(forms.select("doc_id", "ord", "paragraph_index"), ["doc_id", "ord"]).select("doc_id", "paragraph_index", "number")
    plan = plan.join(want, ["doc_id", "paragraph_index"], "left")
    return plan.withColumn("arg", F.when(F.col("op").isin(*NUMBERING), F.col("number")).otherwise(F.col("arg"))).drop("number")


def docx_lines(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, line, text): what a new file holds, one line each: headings with their number, then their paragraphs."""
    h = sections.select(
        "doc_id", F.col("ord").alias("s"), F.lit(0).alias("p"),
        F.trim(F.concat_ws(" ", F.nullif("number", F.lit("")), "title")).alias("text"),
    )
    b = paragraphs.join(
        sections.select("doc_id", "section_id", F.col("ord").alias("s")), ["doc_id", "section_id"],
    ).select("doc_id", "s", F.col("ord").alias("p"), "text")
    every = h.unionByName(b).where("text <> ''")
    return every.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("s", "p")).alias("line"), "text")


# What is added where an issue says that it is missing.
BODY = "Заполните содержимое раздела."
SOURCES = ("СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ", "1. Добавьте используемые источники.")
SENTENCES = [
    ("missing_figure_reference", "На рисунке 1 представлена ключевая схема решения."),
    ("missing_table_reference", "В таблице 1 приведены основные сравнительные показатели."),
    ("missing_appendix_reference", "Дополнительные материалы приведены в приложении А."),
]


def sections_to_add(issues: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, n, number, title, text): required sections that issues name and the document lacks, then a list of sources where one is missing."""
    lacking = issues.where("subtype = 'missing_required_section'").withColumn("item_ord", F.col("ord"))
    named = added_sections(lacking, sections).groupBy("doc_id", "title").agg(F.min(F.col("number").cast("int")).alias("turn")).select(
        "doc_id", F.lit(0).alias("late"), "turn", "title", F.lit(BODY).alias("text"),
    )
    have = sections.where(F.lower("title").rlike("источ|литератур")).select("doc_id")
    listed = issues.where("subtype = 'missing_references_section'").select("doc_id").distinct().join(have, "doc_id", "left_anti").select(
        "doc_id", F.lit(1).alias("late"), F.lit(0).alias("turn"), F.lit(SOURCES[0]).alias("title"),
        F.lit(SOURCES[1]).alias("text"),
    )
    # a list of sources that was asked for by name is there already
    asked = named.where(F.lower("title").rlike("источ|литератур")).select("doc_id")
    new = named.unionByName(listed.join(asked, "doc_id", "left_anti"))
    top = sections.where(F.col("number").rlike(r"^[0-9]+$")).groupBy("doc_id").agg(F.max(F.col("number").cast("int")).alias("top"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("late", "turn", "title"))
    return new.withColumn("n", n).join(top, "doc_id", "left").select(
        "doc_id", "n", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("string").alias("number"), "title", "text",
    )


def sentences_to_add(issues: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, n, text): sentences that refer to what nothing refers to, unless the first section has them."""
    first = sections.groupBy("doc_id").agg(F.min_by(F.struct("section_id", "text"), "ord").alias("s"))
    table = F.lit(None).cast("string")
    for subtype, sentence in SENTENCES:
        table = F.when(F.col("subtype") == subtype, F.lit(sentence)).otherwise(table)
    order = F.array_position(F.array(*(F.lit(x) for x, _ in SENTENCES)), F.col("subtype"))
    asked = issues.where(F.col("subtype").isin([x for x, _ in SENTENCES])).select(
        "doc_id", order.alias("turn"), table.alias("text"),
    ).distinct().join(first, "doc_id")
    asked = asked.where(~F.contains(F.coalesce("s.text", F.lit("")), F.col("text")))
    return asked.select("doc_id", "s.section_id", F.row_number().over(W.partitionBy("doc_id").orderBy("turn")).alias("n"), "text")


def completed(issues: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs) with the sections and sentences that issues ask for; what is there already isn't added again."""
    new, said = sections_to_add(issues, sections), sentences_to_add(issues, sections)
    size = lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("have"), F.max("ord").alias("last"))
    many = lambda c: F.coalesce(c, F.lit(0))
    placed = new.join(size(sections), "doc_id", "left").withColumn("k", many("have") + F.col("n"))
    placed = placed.select(
        "doc_id", "n", (many("last") + F.col("n")).cast("int").alias("ord"),
        F.concat(F.lit("sec_auto_"), "k").alias("section_id"), "number", "title", F.lit(1).alias("level"), "text",
    )
    body = said.groupBy("doc_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("more"))  # three at most
    grown = sections.join(body, ["doc_id", "section_id"], "left")
    text = F.when(F.col("more").isNull(), F.col("text")).when(blank("text"), F.col("more")).otherwise(
        F.concat("text", F.lit("\n\n"), "more")
    )
    s = grown.withColumn("text", text).select(sections.columns).unionByName(placed.select(sections.columns))
    lines = placed.select("doc_id", F.lit(0).alias("late"), "n", "section_id", "text").unionByName(
        said.select("doc_id", F.lit(1).alias("late"), "n", "section_id", "text")
    )
    lines = lines.withColumn(
        "n", F.row_number().over(W.partitionBy("doc_id").orderBy("late", "n")),
    ).join(size(paragraphs), "doc_id", "left")
    k = (many("have") + F.col("n")).cast("int")
    lines = lines.select(
        "doc_id", (many("last") + F.col("n")).cast("int").alias("ord"),
        F.concat(F.lit("p_auto_"), k).alias("paragraph_id"), "section_id", "text",
        F.lit(None).cast("int").alias("page"), k.alias("paragraph_index"),
    )
    return s, paragraphs.unionByName(lines.select(paragraphs.columns))


def missing_captions(items: DataFrame, fixed: DataFrame) -> DataFrame:
    """(doc_id, n, caption): captions that items got where they had none, in order, for lines at the document's end."""
    j = items.where(blank("caption")).select("doc_id", "ord").join(
        fixed.select("doc_id", "ord", "caption"), ["doc_id", "ord"],
    ).where(~blank("caption"))
    return j.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")).alias("n"), "caption")
