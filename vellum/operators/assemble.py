"""A collection of files as the relations that the checks read: sections, captions, formulas, layouts and page parts.

Facts of all files (sources.docx.read_facts) are rows with a place in their file. What a row belongs to is found by
windows over that place, one partitioning for all: the running section, a drawing's caption, a table's nearest caption,
a formula's neighbours. Nothing is collected but the paragraphs of one section to its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import folded, squeeze
from ..sources import docx
from ..sources.scratch import written
from . import parse

#: Fixed value: styles of headings.
HEADING_STYLE = r"(?iu)^(heading|заголовок)"
#: Facts of page parts, which no paragraph or table has.
OF_PAGES = [x.split()[0] for x in docx.PAGE.split(", ")]
#: More characters of a squeezed text than decide whether it is a caption or an appendix.
LONGEST_START = 24


def _numbered(c: Column) -> tuple[Column, Column]:
    """(number, title) of a heading's text; an appendix and a bare title have no number."""
    number = F.regexp_extract(c, parse.HEADING, 1)
    return number, F.when(number != "", F.regexp_extract(c, parse.HEADING, 2)).otherwise(c)


def placed(facts: DataFrame) -> DataFrame:
    """Paragraphs and tables of the bodies in order (pos), each with its kind and its running section (sec).

    Kinds: heading (by style, canonical title, number or appendix), figure and table (captions), drawing (without words), formula,
    grid (a table itself), blank, para.
    """
    by = W.partitionBy("doc_id").orderBy("i", "grid", "table_index")
    x = facts.where("kind in ('paragraph', 'table')").drop("row_index", "cell_index", "error", *OF_PAGES).withColumn("grid", F.col("kind") == "table")
    x = x.withColumn("pos", F.row_number().over(by)).withColumn("t", squeeze(F.coalesce("text", F.lit(""))))
    # below, t is a column of its own, squeezed once for all patterns; starts are told by a line's first characters, t has no other space than " "
    t, start = F.col("t"), F.left(F.col("t"), F.lit(LONGEST_START))
    styled = F.coalesce("style", F.lit("")).rlike(HEADING_STYLE)
    head = styled | (F.length(t) <= 40) & folded(t).isin(parse.UNNUMBERED) | start.rlike(parse.APPENDIX) | (F.length(t) <= 200) & t.rlike(parse.HEADING)
    kind = F.when(F.col("grid"), "grid").when((t == "") & F.col("drawing"), "drawing").when((t == "") & F.col("has_math"), "formula").when(t == "", "blank")
    kind = kind.when(styled, "heading").when(start.rlike(parse.FIGURE), "figure").when(start.rlike(parse.TABLE), "table")
    kind = kind.when(F.col("has_math") | parse.squeezed_formula(t) & parse.squeezed_standalone(t), "formula").when(head, "heading").otherwise("para")
    # the same order as that of pos: rows are sorted once
    return x.withColumn("kind", kind).withColumn("sec", F.sum((F.col("kind") == "heading").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))


def sections(x: DataFrame) -> DataFrame:
    """Sections of placed rows; a number that was used before doesn't give the same id again."""
    number, title = _numbered(F.col("t"))
    h = x.where("kind = 'heading'").withColumn("number", number).withColumn("title", title)
    auto = F.sum((F.col("number") == "").cast("int")).over(W.partitionBy("doc_id").orderBy("sec"))
    copy = F.row_number().over(W.partitionBy("doc_id", "number").orderBy("sec"))
    own = F.concat(F.lit("sec_"), F.replace("number", F.lit("."), F.lit("_")))
    h = h.withColumn("auto", auto).withColumn("copy", copy).select(
        "doc_id", "sec", "i", "number", "title", "alignment",
        F.when(F.col("number") == "", F.concat(F.lit("sec_auto_"), "auto")).when(F.col("copy") == 1, own).otherwise(F.concat(own, F.lit("_at_"), "sec")).alias("section_id"),
        F.when(F.col("number") == "", 1).otherwise(F.size(F.split("number", r"\."))).alias("level"), parse.appendix_letter(F.col("t")).alias("letter"),
    )
    body = x.where("sec > 0 and kind not in ('heading', 'grid', 'blank', 'drawing')").groupBy("doc_id", "sec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n\n").alias("text")
    )
    return h.join(body, ["doc_id", "sec"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def corpus(facts: DataFrame) -> dict[str, DataFrame]:
    """docs, sections, paragraphs, figures, tables and the layout relations of formatting.LAYOUT; a broken file has docs.error.

    Placed rows and sections are written to the shared folder, for every relation reads them.
    """
    x = written(placed(facts), "placed")
    s = written(sections(x), "sections")
    x = x.join(s.select("doc_id", "sec", "section_id", "letter"), ["doc_id", "sec"], "left")
    by = W.partitionBy("doc_id").orderBy("pos")
    nth = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("pos"))
    none = F.lit(None).cast("int").alias("page")
    after = x.withColumn("next_kind", F.lead("kind").over(by)).withColumn("before_kind", F.lag("kind").over(by))
    # a drawing without a caption right below or above it is a figure without one
    bare = (F.col("kind") == "drawing") & ~F.coalesce(F.col("next_kind") == "figure", F.lit(False)) & ~F.coalesce(F.col("before_kind") == "figure", F.lit(False))
    figures = after.where((F.col("kind") == "figure") | bare).withColumn("n", F.row_number().over(by))
    grids = x.withColumn("kind", F.when(F.col("kind") == "grid", "table").when(F.col("kind") == "table", "caption").otherwise(F.col("kind")))
    near = parse.table_captions(grids).join(x.where("kind = 'grid'").select("doc_id", "pos", "table_index", "i", "letter"), ["doc_id", "pos"])
    said = x.where("kind = 'table'").select("doc_id", F.col("pos").alias("caption_pos"), F.col("i").alias("at"), F.col("text").alias("caption"))
    near = near.join(said, ["doc_id", "caption_pos"], "left").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    first = facts.where("kind = 'cell' and row_index = 0").groupBy("doc_id", "table_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", squeeze("text").alias("t")))), lambda c: c["t"]), " ").alias("header_text"),
        F.min_by("alignment", "i").alias("header_alignment"),
    )
    near = near.join(first, ["doc_id", "table_index"], "left")
    around = x.where("kind <> 'grid'").withColumn("prev", F.lag("kind").over(by)).withColumn("next", F.lead("kind").over(by))
    # one look ahead for each row; a frame of all later rows would be read again for each
    later = F.expr("lead(CASE WHEN t <> '' THEN t END) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY pos)")
    forms = around.withColumn("next_text", F.coalesce(later, F.lit(""))).where("kind = 'formula'").withColumn("n", nth)
    forms = parse.formula_numbers(forms.withColumn("text", F.col("t")))
    pages = facts.where("kind = 'section'")
    error = facts.groupBy("doc_id").agg(F.max("error").alias("error"))
    return {
        "docs": error,
        "sections": s.select("doc_id", F.col("sec").cast("int").alias("ord"), "section_id", "number", "title", "level", "text"),
        "paragraphs": x.where("kind = 'para'").withColumn("n", nth).select("doc_id", F.col("n").alias("ord"), F.concat(F.lit("p_"), "n").alias("paragraph_id"), "section_id", "text", none, F.col("i").alias("paragraph_index")),
        "figures": figures.select("doc_id", F.col("n").alias("ord"), F.concat(F.lit("fig_"), "n").alias("item_id"), F.coalesce("text", F.lit("")).alias("caption"), none, F.col("i").alias("paragraph_index")),
        "tables": near.select("doc_id", F.col("n").alias("ord"), F.concat(F.lit("tbl_"), "n").alias("item_id"), F.coalesce("caption", F.lit("")).alias("caption"), none, F.coalesce("at", "i").alias("paragraph_index")),
        "para_layout": x.where("kind <> 'grid' and t <> ''").select(
            "doc_id", F.col("i").alias("paragraph_index"), "text", "alignment", "first_line_indent_mm", "line_spacing", F.col("font_size_pt").alias("font_size_pt_min"),
            "font_family", F.col("bold").alias("has_bold_text"), F.col("non_black").alias("has_non_black_text"),
        ),
        "table_layout": near.select("doc_id", "table_index", F.col("at").alias("caption_paragraph_index"), F.col("position").alias("caption_position"), "header_text", "header_alignment", F.col("letter").alias("appendix_letter")),
        "page_layout": pages.select(
            "doc_id", F.col("i").alias("section_index"), F.col("width_mm").alias("page_width_mm"), F.col("height_mm").alias("page_height_mm"), F.col("left_mm").alias("left_margin_mm"),
            F.col("right_mm").alias("right_margin_mm"), F.col("top_mm").alias("top_margin_mm"), F.col("bottom_mm").alias("bottom_margin_mm"),
        ),
        "page_numbering": pages.select(
            "doc_id", F.col("i").alias("section_index"), F.col("title_page").alias("different_first_page"), F.col("page_field").alias("footer_field"), "footer_alignment",
            "header_field", F.col("first_field").alias("first_footer_field"), F.col("page_start").alias("page_number_start"),
        ),
        "formulas": forms.select(
            "doc_id", F.col("n").alias("ord"), F.col("i").alias("paragraph_index"), "text", "alignment", parse.is_standalone_formula(F.col("t")).alias("is_standalone"), "equation_number",
            F.when(F.col("equation_number").isNull(), F.col("raw_equation_number")).alias("raw_equation_number"), F.coalesce(F.col("prev") == "blank", F.lit(False)).alias("prev_blank"), F.coalesce(F.col("next") == "blank", F.lit(False)).alias("next_blank"),
            "next_text", F.col("letter").alias("appendix_letter"),
        ),
        "heading_layout": s.select("doc_id", "section_id", F.col("i").alias("paragraph_index"), "alignment"),
    }
