"""Queries of the formatting operators, with their oracle SQL, over the inline Russian relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formatting as K
from ..operators.joins import containing
from ..sources.scratch import written
from .planted import ctes, planted

Q: dict = {}


def _fx(spark, d, *names):
    return [planted(spark, d, n) for n in names]


def _three(df):
    return df.select("doc_id", "ord", "subtype")


def _sql(with_: str, base: str, checks: list[tuple[str, str]]) -> str:
    """doc_id, ord, subtype of the checks that hold for the rows of base."""
    cases = ", ".join(f"CASE WHEN {p} THEN '{s}' END" for s, p in checks)
    return f"WITH {with_}, base AS ({base}) SELECT doc_id, ord, s AS subtype FROM (SELECT doc_id, ord, unnest([{cases}]) AS s FROM base) WHERE s IS NOT NULL"


def _items_in(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return items, containing(items, spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))


def _absent_items(spark, d):
    items, found = _items_in(spark, d)
    return items.select(F.col("id").alias("item_id")).join(found.select(F.col("pattern").alias("item_id")), "item_id", "left_anti")


_T = "trim(coalesce({0}, ''))"
_FOLD = "trim(regexp_replace(replace(lower(coalesce({0}, '')), 'ё', 'е'), '\\s+', ' ', 'g'))"

Q["figure_checks"] = (
    lambda spark, d: _three(K.figures(*_fx(spark, d, "fx_figures", "fx_para_layout"))),
    _sql(ctes(
        "fx_figures", "fx_para_layout",
    ), "SELECT f.*, alignment, trim(coalesce(caption, '')) AS c FROM fx_figures f LEFT JOIN fx_para_layout l ON f.doc_id = l.doc_id AND f.paragraph_index = l.paragraph_index", [
        ("missing_figure_caption", "c = ''"), (
            "invalid_figure_caption_format",
            r"c <> '' AND NOT (starts_with(lower(c), 'рисунок') AND regexp_matches(c, ' [-—–] ') AND trim(regexp_extract(c, '(?i)^рисунок\s*\d+(?:\.\d+)*\s*[-—–]?\s*(.*)$', 1), ' .-—–') <> '')",
        ), ("figure_caption_trailing_period", "c <> '' AND ends_with(c, '.')"), (
            "figure_caption_not_centered", "c <> '' AND alignment <> 'center'",
        ),
    ]),
)
_NUM = r"regexp_extract(caption, '(\d+(?:\.\d+)*)', 1)"
Q["figure_numbering"] = (
    lambda spark, d: K.figure_numbering(planted(spark, d, "fx_figures")).select("doc_id", "ord", "number"),
    f"""WITH {ctes("fx_figures")}, n AS (SELECT doc_id, ord, {_NUM} AS number FROM fx_figures WHERE {_NUM} <> ''),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY ord) AS copy FROM n),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, TRY_CAST(number AS INTEGER) AS raw, regexp_full_match(number, '\\d+') AS whole FROM c WHERE copy = 1),
    g AS (SELECT *, last_value(CASE WHEN whole THEN raw END IGNORE NULLS) OVER w AS lastn, last_value(CASE WHEN whole THEN i END IGNORE NULLS) OVER w AS lasti FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, ord, number FROM c WHERE copy > 1 UNION ALL SELECT doc_id, ord, number FROM g WHERE number <> CAST(coalesce(lastn, 0) + i - coalesce(lasti, 0) AS VARCHAR)""",
)
Q["figure_reference_before"] = (
    lambda spark, d: _three(K.figure_references(*_fx(spark, d, "fx_figures", "fx_sections", "fx_paragraphs"))),
    f"""WITH {ctes("fx_figures", "fx_sections", "fx_paragraphs")}, f AS (SELECT *, {_NUM} AS number FROM fx_figures WHERE trim(coalesce(caption, '')) <> ''),
    before AS (SELECT f.doc_id, f.ord, string_agg(lower(p.text), ' ' ORDER BY p.ord) AS t FROM f JOIN fx_paragraphs p ON p.doc_id = f.doc_id AND p.paragraph_index < f.paragraph_index GROUP BY ALL),
    whole AS (SELECT doc_id, string_agg(lower(text), ' ') AS t FROM (SELECT doc_id, text FROM fx_paragraphs UNION ALL SELECT doc_id, text FROM fx_sections) GROUP BY doc_id)
    SELECT doc_id, ord, 'missing_figure_reference' AS subtype FROM f LEFT JOIN before USING (doc_id, ord) WHERE paragraph_index IS NOT NULL AND NOT coalesce(contains(t, 'рис') AND (number = '' OR contains(t, number)), false)
    UNION ALL SELECT doc_id, ord, 'missing_figure_reference' FROM f LEFT JOIN whole USING (doc_id) WHERE paragraph_index IS NULL AND NOT coalesce(contains(t, 'рисунок') OR (length(caption) >= 8 AND contains(t, lower(trim(caption)))) OR (contains(lower(caption), 'таблица') AND contains(t, 'таблица')) OR (contains(lower(caption), 'приложение') AND contains(t, 'приложение')), false)""",
)
Q["table_checks"] = (
    lambda spark, d: _three(K.tables(*_fx(spark, d, "fx_tables", "fx_table_layout"))),
    _sql(ctes("fx_tables", "fx_table_layout"), """SELECT t.*, trim(coalesce(caption, '')) AS c, coalesce(a.caption_position, b.caption_position) AS pos, CASE WHEN a.doc_id IS NOT NULL THEN a.header_text ELSE b.header_text END AS head,
      CASE WHEN a.doc_id IS NOT NULL THEN a.header_alignment ELSE b.header_alignment END AS mid, CASE WHEN a.doc_id IS NOT NULL THEN a.appendix_letter ELSE b.appendix_letter END AS letter
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM fx_tables) t LEFT JOIN fx_table_layout a ON a.doc_id = t.doc_id AND a.caption_paragraph_index = t.paragraph_index LEFT JOIN fx_table_layout b ON b.doc_id = t.doc_id AND b.table_index = t.i""", [
        ("missing_table_caption", "c = ''"), (
            "invalid_table_caption_format",
            r"c <> '' AND NOT (regexp_matches(c, ' [-—–] ') AND regexp_matches(c, '^Таблица\s+([А-ЯЁA-Z]\.)?\d+(\.\d+)*\s*[-—–]\s*.*[^ .—–-]'))",
        ), ("table_caption_below_table", "c <> '' AND pos = 'below'"), (
            "invalid_table_header_punctuation", "c <> '' AND ends_with(trim(head), '.')",
        ),
        ("table_header_alignment", "c <> '' AND mid <> 'center'"), (
            "appendix_table_caption_format",
            r"c <> '' AND letter IS NOT NULL AND NOT regexp_matches(c, '(?i)^таблица\s+' || letter || '\.\d+\s*[—–-]\s*.+$')",
        ),
    ]),
)
Q["formula_checks"] = (
    lambda spark, d: _three(K.formulas(planted(spark, d, "fx_formulas"))),
    _sql(ctes("fx_formulas"), """SELECT f.*, coalesce(equation_number, '') AS num, lower(trim(coalesce(next_text, ''))) AS nxt, CASE WHEN equation_number IS NOT NULL AND appendix_letter IS NOT NULL THEN appendix_letter || '.' || sum(CASE WHEN equation_number IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, appendix_letter ORDER BY ord) END AS want FROM fx_formulas f""", [
        ("formula_not_standalone", "NOT coalesce(is_standalone, false)"), ("formula_not_centered", "coalesce(alignment, '') <> 'center'"), (
            "formula_missing_blank_lines", "NOT (prev_blank AND (next_blank OR starts_with(nxt, 'где')))",
        ), ("formula_number_format_error", "num = '' AND raw_equation_number IS NOT NULL"),
        ("missing_formula_number", "num = '' AND raw_equation_number IS NULL"), (
            "appendix_formula_numbering_error", "want IS NOT NULL AND num <> want",
        ), ("formula_where_colon", "starts_with(trim(next_text), 'где:')"),
        (
            "formula_explanation_format_error",
            r"NOT starts_with(nxt, 'где') AND regexp_matches(trim(next_text), '^[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9_]*\s*[—–-]\s*.+$')",
        ),
        (
            "formula_break_invalid",
            r"regexp_matches(trim(text), '[=+*/-]\s*$') AND nxt <> '' AND NOT starts_with(nxt, 'где') AND NOT starts_with(nxt, right(trim(text), 1))",
        ),
    ]),
)
Q["formula_numbering"] = (
    lambda spark, d: _three(K.formula_numbering(planted(spark, d, "fx_formulas"))),
    f"""WITH {ctes("fx_formulas")}, n AS (SELECT doc_id, ord, CAST(equation_number AS INTEGER) AS n FROM fx_formulas WHERE regexp_full_match(equation_number, '\\d+')),
    w AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS many, row_number() OVER (PARTITION BY doc_id, n ORDER BY ord) AS copy, coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS before FROM n)
    SELECT doc_id, ord, 'formula_numbering_error' AS subtype FROM w WHERE many >= 2 AND (copy > 1 OR n <> before + 1)""",
)
Q["formula_reference_status"] = (
    lambda spark, d: K.formula_references(*_fx(spark, d, "fx_formulas", "fx_paragraphs")),
    f"""WITH {ctes("fx_formulas", "fx_paragraphs")} SELECT doc_id, ord, CASE WHEN EXISTS (SELECT 1 FROM fx_paragraphs p WHERE p.doc_id = f.doc_id AND p.paragraph_index < f.paragraph_index AND regexp_matches(lower(p.text), 'формул\\p{{L}}*\\s*\\(' || replace(equation_number, '.', '\\.') || '\\)')) THEN 'ok'
      WHEN EXISTS (SELECT 1 FROM fx_paragraphs p WHERE p.doc_id = f.doc_id AND p.paragraph_index < f.paragraph_index AND regexp_matches(lower(p.text), 'формул\\p{{L}}*\\s*' || replace(equation_number, '.', '\\.') || '($|\\D)')) THEN 'invalid' ELSE 'missing' END AS status
    FROM fx_formulas f WHERE equation_number IS NOT NULL""",
)
Q["missing_contents"] = (
    lambda spark, d: K.missing_contents(
        *_fx(spark, d, "fx_docs", "fx_sections", "fx_paragraphs", "fx_para_layout")
    ).select("doc_id", "subtype"),
    f"""WITH {ctes("fx_docs", "fx_sections", "fx_paragraphs", "fx_para_layout")}, pool AS (SELECT doc_id, title AS t FROM fx_sections UNION ALL SELECT doc_id, text FROM fx_paragraphs UNION ALL SELECT doc_id, text FROM fx_para_layout QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) <= 40)
    SELECT doc_id, 'missing_contents_section' AS subtype FROM fx_docs d WHERE NOT EXISTS (SELECT 1 FROM pool WHERE pool.doc_id = d.doc_id AND (contains(lower(t), 'содержание') OR contains(lower(t), 'оглавление')))""",
)
_TITLE = f"""{ctes("fx_docs", "fx_para_layout")}, l AS (SELECT *, lower(text) AS t, coalesce(alignment, '') AS al FROM fx_para_layout QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) <= 30),
    g AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (al = 'center') AS centred, count(*) FILTER (al = 'right') AS righted,
      max(CAST(regexp_matches(t, 'министерство|университет|институт|академия|кафедра|факультет|колледж') AS INTEGER)) AS org,
      max(CAST(regexp_matches(t, 'отчет|пояснительная записка|курсовая работа|дипломная работа|выпускная квалификационная работа|лабораторная работа|проект') AS INTEGER)) AS kind,
      max(CAST(regexp_matches(t, 'выполнил|проверил|руководитель|нормоконтроль|студент|группа') AS INTEGER)) AS signed,
      max(CAST(al = 'center' AND regexp_matches(t, 'отчет|тема|работа|проект') AS INTEGER)) AS mid,
      max(CAST(al = 'right' AND regexp_matches(t, 'выполнил|проверил|руководитель|нормоконтроль|студент|группа') AS INTEGER)) AS side,
      max(CAST(regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(19|20)\\d\\d($|[^\\p{{L}}\\p{{N}}_])') AS INTEGER)) AS year,
      max(CAST(contains(t, 'отчет') AS INTEGER)) + max(CAST(contains(t, 'тема') AS INTEGER)) + max(CAST(contains(t, 'выполнил') AS INTEGER)) + max(CAST(contains(t, 'проверил') AS INTEGER)) + max(CAST(contains(t, 'руководитель') AS INTEGER)) + max(CAST(contains(t, 'университет') AS INTEGER)) + max(CAST(contains(t, 'кафедра') AS INTEGER)) AS words
      FROM l WHERE trim(text) <> '' GROUP BY doc_id),
    title AS (SELECT doc_id FROM g WHERE (greatest(org, kind, signed) = 1 AND org + kind + signed + mid + side + year + CAST(words >= 4 AS INTEGER) >= 3) OR (lines >= 6 AND (centred >= 2 OR righted >= 1) AND greatest(org, kind, signed, year) = 1))"""
Q["missing_title_page"] = (
    lambda spark, d: K.missing_title_page(*_fx(spark, d, "fx_docs", "fx_para_layout")).select("doc_id", "subtype"),
    f"WITH {_TITLE} SELECT doc_id, 'missing_title_page' AS subtype FROM fx_docs WHERE doc_id NOT IN (SELECT doc_id FROM title)",
)
Q["body_not_justified"] = (
    lambda spark, d: K.not_justified(planted(spark, d, "fx_para_layout")).select("doc_id", "subtype"),
    f"WITH {_TITLE} SELECT doc_id, 'body_text_not_justified' AS subtype FROM fx_para_layout WHERE doc_id IN (SELECT doc_id FROM title) AND length(text) >= 80 AND coalesce(alignment, '') NOT IN ('center', 'right') GROUP BY doc_id HAVING count(*) FILTER (coalesce(alignment, '') <> 'justify') >= greatest(3, count(*) // 2)",
)
Q["page_format"] = (
    lambda spark, d: _three(K.page_size(planted(spark, d, "fx_page_layout"))),
    f"WITH {ctes('fx_page_layout')}, b AS (SELECT *, least(page_width_mm, page_height_mm) AS a, greatest(page_width_mm, page_height_mm) AS h FROM fx_page_layout WHERE page_width_mm IS NOT NULL AND page_height_mm IS NOT NULL) SELECT doc_id, section_index AS ord, 'invalid_page_size' AS subtype FROM b WHERE NOT ((abs(a - 210) <= 3 AND abs(h - 297) <= 3) OR (abs(a - 297) <= 3 AND abs(h - 420) <= 3))",
)
Q["page_margins"] = (
    lambda spark, d: _three(K.margins(planted(spark, d, "fx_page_layout"))),
    f"""WITH {ctes('fx_page_layout')} SELECT doc_id, section_index AS ord, 'invalid_page_margins' AS subtype FROM fx_page_layout WHERE CASE WHEN left_margin_mm IS NULL THEN false WHEN abs(left_margin_mm - 30) > 1.5 THEN true WHEN right_margin_mm IS NULL THEN false WHEN abs(right_margin_mm - 15) > 1.5 THEN true
      WHEN top_margin_mm IS NULL THEN false WHEN abs(top_margin_mm - 20) > 1.5 THEN true WHEN bottom_margin_mm IS NULL THEN false ELSE abs(bottom_margin_mm - 20) > 1.5 END""",
)
Q["page_numbering"] = (
    lambda spark, d: K.page_numbering(planted(spark, d, "fx_page_numbering")).select("doc_id", "subtype"),
    f"""WITH {ctes('fx_page_numbering')}, g AS (SELECT doc_id, 0 AS ord, bool_or(footer_field) AS f, bool_or(footer_field AND footer_alignment <> 'center') AS off, bool_or(header_field) AS head, arg_min(different_first_page, section_index) AS diff, arg_min(first_footer_field, section_index) AS ff,
      bool_or(section_index > 0 AND coalesce(page_number_start, 0) <> 0) AS restart FROM fx_page_numbering GROUP BY doc_id)
    SELECT doc_id, s AS subtype FROM (SELECT doc_id, unnest([CASE WHEN NOT (f OR head) THEN 'missing_page_numbering' END, CASE WHEN off THEN 'page_number_not_centered' END, CASE WHEN head THEN 'page_number_in_header' END, CASE WHEN (f OR head) AND (NOT diff OR ff) THEN 'title_page_number_visible' END, CASE WHEN (f OR head) AND restart THEN 'page_numbering_restart' END]) AS s FROM g) WHERE s IS NOT NULL""",
)
Q["typography_first_offender"] = (
    lambda spark, d: _three(K.typography(*_fx(spark, d, "fx_paragraphs", "fx_para_layout"))),
    f"""WITH {ctes('fx_paragraphs', 'fx_para_layout')}, j AS (SELECT p.doc_id, p.ord, l.* EXCLUDE (doc_id, text) FROM fx_paragraphs p JOIN fx_para_layout l ON p.doc_id = l.doc_id AND p.paragraph_index = l.paragraph_index WHERE section_id IS NOT NULL AND length(p.text) >= 20),
    x AS (SELECT doc_id, ord, unnest([CASE WHEN abs(first_line_indent_mm - 12.5) > 1.5 THEN 'invalid_first_line_indent' END, CASE WHEN abs(line_spacing - 1.5) > 0.15 THEN 'invalid_line_spacing' END, CASE WHEN font_size_pt_min < 12 THEN 'invalid_font_size' END, CASE WHEN lower(font_family) <> 'times new roman' THEN 'invalid_font_family' END, CASE WHEN has_non_black_text THEN 'invalid_font_color' END, CASE WHEN has_bold_text THEN 'unexpected_bold_text' END]) AS subtype FROM j)
    SELECT doc_id, ord, subtype FROM x WHERE subtype IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, subtype ORDER BY ord) = 1""",
)
Q["enumerations"] = (
    lambda spark, d: _three(K.enumerations(*_fx(spark, d, "fx_paragraphs", "fx_para_layout", "fx_heading_layout"))),
    _sql(ctes('fx_paragraphs', 'fx_para_layout', 'fx_heading_layout'), r"""SELECT p.*, trim(p.text) AS t, l.first_line_indent_mm AS ind, NOT regexp_matches(trim(p.text), '^\d+(\.\d+)*\.?\s+[А-ЯЁA-Z].+$') AS free, regexp_matches(trim(p.text), '^([•●▪*]|\d+\.|[A-Za-zА-Яа-яЁё]\.)\s+') AS marked
      FROM fx_paragraphs p LEFT JOIN fx_para_layout l ON p.doc_id = l.doc_id AND p.paragraph_index = l.paragraph_index WHERE NOT EXISTS (SELECT 1 FROM fx_heading_layout h WHERE h.doc_id = p.doc_id AND h.paragraph_index = p.paragraph_index)""", [
        ("invalid_enumeration_marker", "free AND marked"), (
            "enumeration_indent_invalid",
            r"free AND NOT marked AND regexp_matches(t, '(?i)^([-–—]|\d+\)|[а-яёa-z]\))\s+') AND abs(ind - 12.5) > 1.5",
        )]),
)
_REF = "(contains(f, 'список использованных источников') OR contains(f, 'список литературы') OR contains(f, 'библиограф') OR contains(f, 'источники и литература'))"
Q["reference_section"] = (
    lambda spark, d: K.reference_section(
        *_fx(spark, d, "fx_docs", "fx_sections", "fx_paragraphs", "fx_para_layout")
    ).select("doc_id", "subtype"),
    f"""WITH {ctes('fx_docs', 'fx_sections', 'fx_paragraphs', 'fx_para_layout')}, s AS (SELECT doc_id, arg_min(coalesce(text, ''), ord) AS text FROM (SELECT *, lower(title) AS f FROM fx_sections) WHERE {_REF} GROUP BY doc_id),
    said AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, lower(text) AS f FROM fx_paragraphs UNION ALL SELECT doc_id, lower(text) FROM fx_para_layout) WHERE {_REF})
    SELECT d.doc_id, CASE WHEN s.doc_id IS NULL AND d.doc_id NOT IN (SELECT doc_id FROM said) THEN 'missing_references_section' ELSE 'empty_references_section' END AS subtype FROM fx_docs d LEFT JOIN s USING (doc_id) WHERE s.doc_id IS NULL OR length(trim(s.text)) < 20""",
)
_STRUCT = "f IN ('содержание', 'оглавление', 'реферат', 'список использованных источников', 'список литературы', 'библиографический список', 'источники и литература')"
Q["headings"] = (
    lambda spark, d: _three(K.headings(*_fx(spark, d, "fx_sections", "fx_heading_layout"))),
    _sql(ctes(
        'fx_sections', 'fx_heading_layout',
    ), f"SELECT s.*, trim(title) AS t, {_FOLD.format('title')} AS f, l.alignment FROM fx_sections s LEFT JOIN fx_heading_layout l ON s.doc_id = l.doc_id AND s.section_id = l.section_id", [
        ("empty_section_heading", "t = ''"), ("heading_trailing_period", "ends_with(t, '.')"), (
            "appendix_heading_not_centered", "starts_with(f, 'приложение') AND alignment <> 'center'",
        ), ("structural_heading_numbered", f"{_STRUCT} AND number <> ''"), (
            "structural_heading_not_uppercase", f"{_STRUCT} AND t <> upper(t)",
        ),
        ("structural_heading_not_centered", f"{_STRUCT} AND alignment <> 'center'"), (
            "main_heading_centered",
            f"t <> '' AND NOT {_STRUCT} AND NOT starts_with(f, 'приложение') AND alignment = 'center'",
        ), ("appendix_heading_single_line", "regexp_matches(f, '^приложение\\s+[а-яa-z](\\s*[-–—]\\s*\\S|\\s+\\S)')"), (
            "invalid_appendix_heading",
            "contains(f, 'прилож') AND NOT regexp_matches(lower(t), '^приложение(\\s+[а-яёa-z]([^\\p{L}]|$).*|\\s*[-–—]\\s*.+|\\s+.+)?$')",
        ),
    ]),
)
Q["heading_layouts"] = (
    lambda spark, d: _three(K.heading_layouts(*_fx(spark, d, "fx_sections", "fx_heading_layout", "fx_para_layout"))),
    _sql(ctes(
        'fx_sections', 'fx_heading_layout', 'fx_para_layout',
    ), f"SELECT s.*, {_FOLD.format('title')} AS f, l.first_line_indent_mm AS ind, l.has_non_black_text AS color, l.text AS line FROM fx_sections s JOIN fx_heading_layout h ON s.doc_id = h.doc_id AND s.section_id = h.section_id JOIN fx_para_layout l ON l.doc_id = h.doc_id AND l.paragraph_index = h.paragraph_index", [
        (
            "structural_heading_has_indent", f"{_STRUCT} AND abs(ind) > 0.5",
        ), ("structural_heading_invalid_font_color", f"{_STRUCT} AND color"), (
            "main_heading_indent_invalid",
            f"f <> '' AND NOT {_STRUCT} AND NOT starts_with(f, 'приложение') AND coalesce(abs(ind - 12.5) > 1.5, true)",
        ), ("heading_invalid_font_color", f"f <> '' AND NOT {_STRUCT} AND NOT starts_with(f, 'приложение') AND color"),
    ]),
)
_HAY = "hay AS (SELECT doc_id, string_agg(lower(text), ' ') AS t FROM (SELECT doc_id, text FROM fx_paragraphs UNION ALL SELECT doc_id, text FROM fx_sections) GROUP BY doc_id)"
Q["appendix_references"] = (
    lambda spark, d: _three(K.appendix_references(*_fx(spark, d, "fx_sections", "fx_paragraphs"))),
    f"""WITH {ctes('fx_sections', 'fx_paragraphs')}, {_HAY} SELECT doc_id, ord, 'missing_appendix_reference' AS subtype FROM fx_sections LEFT JOIN hay USING (doc_id)
    WHERE contains(lower(title), 'прилож') AND NOT coalesce(contains(t, 'приложение') OR (length(title) >= 8 AND contains(t, lower(trim(title)))), false)""",
)
Q["missing_section_numbers"] = (
    lambda spark, d: _three(K.missing_numbers(planted(spark, d, "fx_sections"))),
    f"WITH {ctes('fx_sections')}, s AS (SELECT *, {_FOLD.format('title')} AS f, count(*) FILTER (number <> '') OVER (PARTITION BY doc_id, level) AS n FROM fx_sections) SELECT doc_id, ord, 'missing_section_number' AS subtype FROM s WHERE n >= 2 AND number = '' AND NOT {_STRUCT}",
)
Q["fallback_location"] = (
    lambda spark, d: K.fallback_location(*_fx(spark, d, "fx_sections", "fx_paragraphs", "fx_docs")),
    f"WITH {ctes('fx_docs', 'fx_sections', 'fx_paragraphs')} SELECT d.doc_id, (SELECT arg_max(section_id, ord) FROM fx_sections s WHERE s.doc_id = d.doc_id) AS section_id, CASE WHEN NOT EXISTS (SELECT 1 FROM fx_sections s WHERE s.doc_id = d.doc_id) THEN (SELECT arg_max(paragraph_id, ord) FROM fx_paragraphs p WHERE p.doc_id = d.doc_id) END AS paragraph_id FROM fx_docs d",
)
_WANT = [
    ("figure", "numbering"), ("figure", "placement"), ("figure", "color"), ("table", "reference_required"),
    ("formula", "numbering"), ("page", "size"),
]
Q["rule_pick"] = (
    lambda spark, d: K.rule_pick(planted(spark, d, "fx_rules"), spark.createDataFrame(_WANT, "object_type string, constraint_type string")),
    f"""WITH {ctes('fx_rules')}, w AS (SELECT * FROM (VALUES {', '.join(map(str, _WANT))}) AS v(object_type, wanted))
    SELECT standard_id, w.object_type, wanted AS constraint_type, rule_id, number, content[:280] AS quote FROM w JOIN fx_rules r ON r.object_type = w.object_type
    QUALIFY row_number() OVER (PARTITION BY standard_id, w.object_type, wanted ORDER BY constraint_type = wanted DESC, list_transform(string_split(number, '.'), lambda x: CAST(x AS INTEGER)), ord) = 1""",
)
Q["unreferenced_tables"] = (
    lambda spark, d: _three(K.table_references(*_fx(spark, d, "fx_tables", "fx_sections", "fx_paragraphs"))),
    f"""WITH {ctes('fx_tables', 'fx_sections', 'fx_paragraphs')}, {_HAY}
    SELECT doc_id, ord, 'missing_table_reference' AS subtype FROM fx_tables LEFT JOIN hay USING (doc_id) WHERE trim(coalesce(caption, '')) <> ''
      AND NOT coalesce(contains(t, 'таблица') OR (length(caption) >= 8 AND contains(t, lower(trim(caption)))), false)""",
)
_NAMED = [("missing_figure_caption", "figure", "caption_required"), ("figure_numbering_error", "figure", "numbering"), ("missing_table_reference", "table", "reference_required"), ("missing_formula_number", "formula", "numbering")]
Q["issue_rules"] = (
    # the rule that each kind of issue names, by every standard's rules
    lambda spark, d: K.rules_of_issues(planted(spark, d, "fx_rules")).where(F.col("subtype").isin(*[s for s, *_ in _NAMED])).select("standard_id", "subtype", "rule_id"),
    f"""WITH {ctes('fx_rules')}, w AS (SELECT * FROM (VALUES {', '.join(map(str, _NAMED))}) AS v(subtype, object_type, wanted))
    SELECT standard_id, subtype, rule_id FROM w JOIN fx_rules r ON r.object_type = w.object_type
    QUALIFY row_number() OVER (PARTITION BY standard_id, subtype ORDER BY constraint_type = wanted DESC, list_transform(string_split(number, '.'), lambda x: CAST(x AS INTEGER)), ord) = 1""",
)
Q["benchmark_references"] = (
    # the same containment over the corpus: benchmark items whose text no document holds
    lambda spark, d: _absent_items(spark, d),
    "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
)
Q["benchmark_containment"] = (
    # every benchmark item with the documents that hold it, word for word
    lambda spark, d: _items_in(spark, d)[1].select(F.col("pattern").alias("item_id"), F.col("text").alias("doc_id")),
    "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
_PARTS = [
    "figure_checks", "figure_reference_before", "table_checks", "unreferenced_tables", "formula_checks",
    "formula_numbering", "page_format", "page_margins", "typography_first_offender", "enumerations", "headings",
    "heading_layouts", "appendix_references", "missing_section_numbers", "missing_contents", "body_not_justified",
    "page_numbering", "reference_section",
]
_EVERY = " UNION ALL ".join(
    [f"SELECT doc_id, subtype FROM ({Q[n][1]})" for n in _PARTS]
    + [
        f"SELECT doc_id, 'figure_numbering_error' FROM ({Q['figure_numbering'][1]})",
        f"SELECT doc_id, CASE status WHEN 'invalid' THEN 'invalid_formula_reference_format' ELSE 'missing_formula_reference' END FROM ({Q['formula_reference_status'][1]}) WHERE status <> 'ok'",
    ]
    # a title page is looked for only where there is a layout
    + [f"SELECT doc_id, subtype FROM ({Q['missing_title_page'][1]}) WHERE doc_id IN (WITH {ctes('fx_para_layout')} SELECT doc_id FROM fx_para_layout)"]
)
Q["formatting_issues"] = (
    # the whole run finds what the checks find one by one
    lambda spark, d: K.check_formatting(
        *_fx(spark, d, "fx_docs"), *(written(x, "checked") for x in _fx(spark, d, "fx_sections", "fx_paragraphs", "fx_figures", "fx_tables", "fx_para_layout")),
        *_fx(spark, d, "fx_table_layout", "fx_page_layout", "fx_page_numbering"), *(written(x, "checked") for x in _fx(spark, d, "fx_formulas", "fx_heading_layout")),
    ).groupBy("doc_id", "subtype").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT doc_id, subtype, count(*) AS n FROM ({_EVERY}) GROUP BY ALL",
)
#: SQL of all issues one by one, for other queries.
ALL_ISSUES = _EVERY
