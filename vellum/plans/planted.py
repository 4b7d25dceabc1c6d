"""The relations that structure, style, formatting, parsing and fixing read, made from the given documents.

Every line of every document takes part: some lines head sections, some caption figures and tables or stand for formulas, the others are
paragraphs, by the line's place and the document's number. Numbers, titles and layouts come from the same two and from
the line itself, and a known part of them breaks each rule of the checks. A relation is one SELECT over the lines in SQL
that Spark and DuckDB read alike, so the oracle has the same rows; what the operators find in them it works out by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import docx

_ROLE = """CASE WHEN d % 17 = 16 AND (i = 1 OR (i + d) % 6 = 0) THEN 'para' WHEN i = 1 OR (i + d) % 6 = 0 THEN 'heading'
  WHEN (i + d) % 6 = 2 AND i > 2 THEN 'figure' WHEN (i + d) % 6 = 3 AND i > 2 AND d % 3 = 0 THEN 'table' WHEN (i + d) % 6 = 4 AND d % 3 = 1 THEN 'formula' ELSE 'para' END"""
#: Lines with their roles; h: the headings so far, o: the place among the lines of the role.
_LINES = f"""SELECT *, CAST(sum(CASE WHEN role = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i) AS INT) AS h,
  CAST(row_number() OVER (PARTITION BY d, role ORDER BY i) AS INT) AS o
FROM (SELECT d, concat('d', d) AS doc_id, lang, i, text, {_ROLE} AS role FROM split_lines) x"""

_CHAPTER = "CAST(floor((o - 1) / 3) AS INT) + 1"
#: name -> (columns with their types, the SELECT).
RELATIONS: dict[str, tuple[str, str]] = {
    "fx_docs": (
        "doc_id string, title string, language string",
        "SELECT concat('d', doc_id) AS doc_id, substr(text, 1, 30) AS title, lang AS language FROM documents",
    ),
    "fx_sections": (
        "doc_id string, ord int, section_id string, number string, title string, level int, text string",
        f"""SELECT doc_id, o AS ord, concat('s', o) AS section_id,
  CASE CASE WHEN d % 9 = 1 AND o < 3 THEN 12 ELSE (3 * d + o) % 14 END WHEN 2 THEN '' WHEN 4 THEN concat({_CHAPTER}) WHEN 6 THEN concat({_CHAPTER}, '.', (o - 1) % 3 + 2) WHEN 8 THEN '5.2.1'
    WHEN 10 THEN concat({_CHAPTER}, '.a') WHEN 12 THEN concat({_CHAPTER} + o - 1) ELSE CASE WHEN d % 7 = 3 THEN '' WHEN o % 3 = 1 THEN concat({_CHAPTER}) ELSE concat({_CHAPTER}, '.', (o - 1) % 3) END END AS number,
  CASE CASE WHEN d % 9 = 1 AND o = 1 THEN 2 WHEN d % 9 = 1 AND o = 2 THEN 0 ELSE (d + 5 * o) % 13 END WHEN 0 THEN 'Введение' WHEN 1 THEN 'Основная часть' WHEN 2 THEN 'Заключение' WHEN 3 THEN 'Список литературы' WHEN 4 THEN concat('Приложение А ', substr(text, 1, 10))
    WHEN 5 THEN 'Содержание' WHEN 6 THEN 'ВЫВОДЫ' WHEN 7 THEN 'Приложение Материалы' WHEN 8 THEN '' WHEN 9 THEN concat(substr(text, 1, 20), '.') WHEN 10 THEN concat('Ещё ', substr(text, 1, 12)) ELSE substr(text, 1, 40) END AS title,
  CASE WHEN o % 3 = 1 THEN 1 ELSE 2 END AS level, CASE WHEN (d + o) % 5 = 0 THEN '' WHEN (d + o) % 5 = 1 THEN concat('См. рисунок 1 и формула (2). ', text) ELSE text END AS text FROM lines WHERE role = 'heading'""",
    ),
    "fx_paragraphs": (
        "doc_id string, ord int, paragraph_id string, section_id string, text string, page int, paragraph_index int",
        """SELECT doc_id, o AS ord, concat('p_', o) AS paragraph_id, CASE WHEN h > 0 THEN concat('s', h) END AS section_id,
  CASE (5 * d + i) % 19 WHEN 0 THEN concat('На рисунке ', i % 5 + 1, ' показана схема. ', text) WHEN 1 THEN concat('Короче говоря, ', text, ' Блин.') WHEN 2 THEN concat('• ', text) WHEN 3 THEN concat('1. ', text)
    WHEN 4 THEN concat('б) ', text) WHEN 5 THEN concat('Расчет по формуле (', i % 3 + 1, '). ', text) WHEN 6 THEN concat('По формуле 1 видно. ', text) WHEN 7 THEN concat('Таблица 1 – Данные. ', text)
    WHEN 8 THEN concat('Содержание: ', text) WHEN 9 THEN concat('В конце есть список литературы. ', text) WHEN 10 THEN concat('Эта фигня не работает. Тупой подход! Жесть. ', text) WHEN 11 THEN concat('Фигнягенератор тут ни при чём. ', text)
    WHEN 12 THEN concat('Приложение содержит пример. ', text) WHEN 13 THEN concat('Ну короче, КАПЕЦ как быстро. ', text) ELSE text END AS text,
  CAST(floor(i / 30) AS INT) + 1 AS page, CASE WHEN (d + i) % 23 <> 5 THEN i END AS paragraph_index FROM lines WHERE role = 'para'""",
    ),
    "fx_figures": (
        "doc_id string, ord int, item_id string, caption string, page int, paragraph_index int",
        """SELECT doc_id, o AS ord, concat('fig_', o) AS item_id, CASE (7 * d + i) % 11 WHEN 1 THEN concat('Рис. ', o, ' - ', substr(text, 1, 20), '.') WHEN 2 THEN '' WHEN 3 THEN concat('Рисунок 1 – ', substr(text, 1, 15)) WHEN 4 THEN concat('Рисунок 1.', o, ' — Вид')
    WHEN 5 THEN 'Схема 7 без слова' WHEN 6 THEN concat('Рисунок ', o + 1, '-Слитно') WHEN 7 THEN concat('Рисунок ', o, ' - ...') WHEN 8 THEN concat('Таблица на рисунке, ', substr(text, 1, 9)) ELSE concat('Рисунок ', o, ' — ', substr(text, 1, 25)) END AS caption,
  CAST(floor(i / 30) AS INT) + 1 AS page, CASE WHEN (d + i) % 7 <> 6 THEN i END AS paragraph_index FROM lines WHERE role = 'figure'""",
    ),
    "fx_tables": (
        "doc_id string, ord int, item_id string, caption string, page int, paragraph_index int",
        """SELECT doc_id, o AS ord, concat('tbl_', o) AS item_id, CASE (d + 2 * i + o) % 8 WHEN 1 THEN 'Таблица без номера' WHEN 2 THEN '' WHEN 3 THEN concat('Таблица ', o, '-Слитно') WHEN 4 THEN concat('таблица ', o, ' - ', substr(text, 1, 15)) WHEN 5 THEN concat('Таблица А.', o, ' — Прочее')
    ELSE concat('Таблица ', o, ' — ', substr(text, 1, 25)) END AS caption, CAST(floor(i / 30) AS INT) + 1 AS page, i AS paragraph_index FROM lines WHERE role = 'table'""",
    ),
    "fx_para_layout": (
        "doc_id string, paragraph_index int, text string, alignment string, first_line_indent_mm double, line_spacing double, font_size_pt_min double, font_family string, has_bold_text boolean, has_non_black_text boolean",
        """SELECT doc_id, i AS paragraph_index, CASE WHEN i = 1 AND d % 3 = 0 THEN concat('Министерство образования. Отчет о работе ', 2000 + d % 30, '. ', text) WHEN i = 2 AND d % 3 = 0 THEN concat('Выполнил: студент группы ', d % 50, '. ', text) ELSE text END AS text,
  CASE (d + 3 * i) % 7 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN NULL ELSE CASE WHEN d % 2 = 0 THEN 'justify' ELSE 'left' END END AS alignment,
  CASE (d + i) % 9 WHEN 0 THEN 0.0 WHEN 1 THEN 10.9 WHEN 2 THEN 14.0 WHEN 3 THEN NULL ELSE 12.5 END AS first_line_indent_mm, CASE (2 * d + i) % 10 WHEN 0 THEN 1.7 WHEN 1 THEN 1.65 WHEN 2 THEN 1.0 WHEN 3 THEN NULL ELSE 1.5 END AS line_spacing,
  CASE (3 * d + i) % 12 WHEN 0 THEN 11.5 WHEN 1 THEN 12.0 WHEN 2 THEN NULL ELSE 14.0 END AS font_size_pt_min, CASE (4 * d + i) % 15 WHEN 0 THEN 'Arial' WHEN 1 THEN NULL ELSE 'Times New Roman' END AS font_family,
  (5 * d + i) % 13 = 0 AS has_bold_text, (6 * d + i) % 14 = 0 AS has_non_black_text FROM lines WHERE d % 5 <> 4""",
    ),
    "fx_page_layout": (
        "doc_id string, section_index int, page_width_mm double, page_height_mm double, left_margin_mm double, right_margin_mm double, top_margin_mm double, bottom_margin_mm double",
        """SELECT doc_id, i - 1 AS section_index, CASE (d + i) % 6 WHEN 0 THEN 216.0 WHEN 1 THEN 420.0 WHEN 2 THEN 213.1 WHEN 3 THEN NULL ELSE 210.0 END AS page_width_mm, CASE (d + i) % 7 WHEN 0 THEN 279.0 ELSE 297.0 END AS page_height_mm, CASE d % 5 WHEN 0 THEN 25.0 WHEN 1 THEN 31.6 WHEN 2 THEN NULL ELSE 30.0 END AS left_margin_mm,
  CASE (d + i) % 8 WHEN 0 THEN NULL WHEN 1 THEN 16.5 WHEN 2 THEN 17.0 ELSE 15.0 END AS right_margin_mm, CASE d % 11 WHEN 3 THEN 18.5 WHEN 4 THEN 25.0 ELSE 20.0 END AS top_margin_mm, CASE d % 13 WHEN 5 THEN 25.0 WHEN 6 THEN NULL ELSE 20.0 END AS bottom_margin_mm FROM lines WHERE i <= 2 AND d % 5 <> 4""",
    ),
    "fx_page_numbering": (
        "doc_id string, section_index int, different_first_page boolean, footer_field boolean, footer_alignment string, header_field boolean, first_footer_field boolean, page_number_start int",
        """SELECT doc_id, i - 1 AS section_index, d % 2 = 0 AS different_first_page, d % 3 <> 0 AS footer_field, CASE d % 4 WHEN 1 THEN 'right' WHEN 2 THEN 'unspecified' ELSE 'center' END AS footer_alignment, (d + i) % 6 = 0 AS header_field, d % 7 = 0 AS first_footer_field, CASE (d + i) % 5 WHEN 0 THEN 5 WHEN 1 THEN 0 END AS page_number_start FROM lines WHERE i <= 2 AND d % 5 <> 4""",
    ),
    "fx_table_layout": (
        "doc_id string, table_index int, caption_paragraph_index int, caption_position string, header_text string, header_alignment string, appendix_letter string",
        """SELECT doc_id, o - 1 AS table_index, CASE WHEN (d + o) % 4 <> 1 THEN i END AS caption_paragraph_index, CASE (d + o) % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'below' ELSE 'above' END AS caption_position, CASE WHEN d % 5 = 0 THEN 'Итого.' ELSE substr(text, 1, 8) END AS header_text, CASE WHEN d % 4 = 0 THEN 'left' ELSE 'center' END AS header_alignment,
  CASE WHEN (d + o) % 6 = 0 THEN 'А' END AS appendix_letter FROM lines WHERE role = 'table' AND d % 5 <> 4""",
    ),
    "fx_formulas": (
        "doc_id string, ord int, paragraph_index int, text string, alignment string, is_standalone boolean, equation_number string, raw_equation_number string, prev_blank boolean, next_blank boolean, next_text string, appendix_letter string",
        """SELECT doc_id, o AS ord, i AS paragraph_index, CASE (d + i) % 7 WHEN 0 THEN concat('v = s / ', length(text), ' ', o) WHEN 1 THEN concat('a = b + ') WHEN 2 THEN concat('q = ', length(text)) ELSE concat('y = kx + ', length(text), ' (', n, ')') END AS text, CASE d % 4 WHEN 0 THEN 'left' WHEN 1 THEN NULL ELSE 'center' END AS alignment,
  (d + i) % 5 <> 0 AS is_standalone, CASE WHEN (d + i) % 7 > 1 AND (d + i) % 7 <> 2 THEN n END AS equation_number, CASE WHEN (d + i) % 7 = 0 THEN concat(o) END AS raw_equation_number, i % 3 <> 0 AS prev_blank, i % 4 <> 0 AS next_blank,
  CASE (2 * d + i) % 6 WHEN 0 THEN concat('где k - ', substr(text, 1, 10)) WHEN 1 THEN concat('где: x - ', substr(text, 1, 10)) WHEN 2 THEN 'v — скорость' WHEN 3 THEN '' WHEN 4 THEN '+ c' ELSE text END AS next_text, letter AS appendix_letter
FROM (SELECT *, CASE (d + i) % 9 WHEN 0 THEN 'А.2' WHEN 1 THEN concat(o + 1) ELSE concat(o) END AS n, CASE WHEN (d + i) % 9 = 0 THEN 'А' END AS letter FROM lines WHERE role = 'formula') x""",
    ),
    "fx_heading_layout": (
        "doc_id string, section_id string, paragraph_index int, alignment string",
        "SELECT doc_id, concat('s', o) AS section_id, i AS paragraph_index, CASE (d + o) % 3 WHEN 0 THEN 'center' ELSE 'left' END AS alignment FROM lines WHERE role = 'heading' AND d % 5 <> 4 AND (d + i) % 10 <> 7",
    ),
    "fx_issues": (
        "doc_id string, ord int, issue_id string, type string, subtype string, severity string, message string, section_id string, paragraph_id string, paragraph_index int, page int, evidence string, rule_id string, quote string, suggestion string, agent string",
        # several issues a place, of which one stays
        """SELECT doc_id, i AS ord, concat('i', i) AS issue_id, CASE d % 5 WHEN 0 THEN 'structure' WHEN 1 THEN 'style' WHEN 2 THEN 'formatting' WHEN 3 THEN 'logic' ELSE 'odd' END AS type, CASE WHEN i % 5 = 0 THEN '' ELSE 'numbering_error' END AS subtype, CASE (d + i) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'note' END AS severity,
  concat('m', i % 2) AS message, CASE WHEN h > 0 THEN concat('s', h) END AS section_id, CASE WHEN i % 7 = 0 THEN concat('p', i % 3) END AS paragraph_id, CAST(NULL AS INT) AS paragraph_index, CAST(floor(i / 30) AS INT) + 1 AS page, substr(text, 1, CAST(length(text) % 20 AS INT)) AS evidence, 'r1' AS rule_id, substr(text, 1, i % 4) AS quote, CASE WHEN i % 3 = 0 THEN 'fix' WHEN i % 3 = 1 THEN '' END AS suggestion, 'style_agent' AS agent FROM lines""",
    ),
    "fx_agents": (
        "doc_id string, agent string, error string",
        """SELECT doc_id, CASE i WHEN 1 THEN 'structure_agent' WHEN 2 THEN 'rag_agent' ELSE 'style_agent' END AS agent, CASE WHEN (d + i) % 6 = 0 THEN 'no parsed standard' END AS error FROM lines WHERE i <= 3""",
    ),
    "fx_chat": (
        "doc_id string, response string",
        """SELECT doc_id, CASE d % 4 WHEN 0 THEN concat('{"issues":[{"subtype":"spelling_error","paragraph_id":"p_1","severity":"","confidence":"high","before":"а","after":"', length(text), '"},{"subtype":"long_sentence","paragraph_id":"p_2","severity":"info","confidence":"low","before":"","after":""}]}')
    WHEN 1 THEN concat('Ответ: {"issues":[{"subtype":"other","paragraph_id":"p_1","severity":"info","confidence":"high","before":"x","after":"y"},{"subtype":"long_sentence","paragraph_id":"p_3","severity":"info","confidence":"medium","before":"x","after":"', length(text), '"}]}') WHEN 2 THEN '{"issues":[{"subtype":' ELSE 'нет ошибок' END AS response FROM lines WHERE i = 1""",
    ),
    "fx_raw": (
        "doc_id string, text string",
        # blocks by blank lines, headings and captions as the line's role says
        """SELECT doc_id, string_join(CASE role WHEN 'heading' THEN CASE o % 4 WHEN 0 THEN 'Приложение А Материалы' ELSE concat(o, ' ', substr(text, 1, 40)) END WHEN 'figure' THEN concat('Рис. ', o, ' ', substr(text, 1, 30)) WHEN 'table' THEN concat('Таблица ', o, ' - ', substr(text, 1, 30)) ELSE text END) AS text FROM lines GROUP BY doc_id""",
    ),
    "fx_rules": (
        # a document as a standard, a line as a rule; rules cite the one before, the one after or a section
        "standard_id string, ord int, rule_id string, number string, section_id string, title string, content string, object_type string, constraint_type string",
        """SELECT concat('g', d) AS standard_id, i AS ord, concat('r', d, '_', i) AS rule_id, concat(5 + i % 3, '.', i) AS number, concat('s', d, '_', 5 + i % 3) AS section_id,
  CASE (d + i) % 4 WHEN 0 THEN 'Рисунки следует нумеровать' WHEN 1 THEN 'Название таблицы' WHEN 2 THEN 'Формулы и ссылки' ELSE 'Общее' END AS title,
  CASE (2 * d + i) % 5 WHEN 0 THEN concat('Нумеруют в соответствии с ', 5 + (i - 1) % 3, '.', i - 1) WHEN 1 THEN concat('На все должны быть ссылки, см. ', 5 + (i + 1) % 3, '.', i + 1) WHEN 2 THEN concat('Подпись обязательна, см. раздел ', 5 + (i + 1) % 3) WHEN 3 THEN concat('Приводят строку: ', lower(lang)) ELSE 'Подпись располагают по центру страницы' END AS content,
  CASE (d + i) % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' ELSE 'generic' END AS object_type,
  CASE (d + 2 * i) % 6 WHEN 0 THEN 'numbering' WHEN 1 THEN 'placement' WHEN 2 THEN 'reference_required' WHEN 3 THEN 'required_presence' WHEN 4 THEN 'caption_required' ELSE 'generic' END AS constraint_type FROM lines""",
    ),
    "fx_lines": (
        # a document as a standard: blank lines between its blocks, which are section heads, rules and texts
        "standard_id string, pos int, line string",
        """SELECT concat('g', d) AS standard_id, 2 * i - k AS pos, CASE WHEN k = 1 THEN '' ELSE CASE role WHEN 'heading' THEN concat(o, ' Раздел документа') WHEN 'figure' THEN concat(h, '.', i, ' Рисунки следует нумеровать') ELSE concat('Текст строки: ', text, '.') END END AS line
  FROM lines CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) b""",
    ),
    "fx_hits": (
        "query_id int, rank int, id string, entry_type string",
        "SELECT d AS query_id, i AS rank, concat('h', i) AS id, CASE WHEN (d + i) % 3 <> 0 THEN 'bridging_fact' ELSE 'aku' END AS entry_type FROM lines",
    ),
    "fx_fixes": (
        # the first e of a paragraph replaced, then a word that most don't have
        "doc_id string, target string, ord int, before string, after string",
        """SELECT doc_id, concat('p_', o) AS target, k AS ord, CASE k WHEN 1 THEN 'e' ELSE 'idiot' END AS before, CASE k WHEN 1 THEN 'E' ELSE concat('Новый текст ', i) END AS after FROM lines CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) b
  WHERE role = 'para' AND (k = 1 AND o % 3 <> 2 OR k = 2 AND o % 3 = 1)""",
    ),
    "fx_akus": (
        "doc_id string, response string",
        """SELECT doc_id, CASE WHEN d % 5 = 4 THEN 'none' ELSE concat('text {"akus":[{"question":"Что?","answer":"', length(text), '"},{"question":" ","answer":"x"},{"question":"Где?","answer":"', lang, '"}]} end') END AS response FROM lines WHERE i = 1""",
    ),
    "fx_markdown": (
        "doc_id string, text string",
        # a title line for each heading, the lines below it; every third section has none
        """SELECT doc_id, string_join(CASE WHEN role = 'heading' THEN concat(CASE WHEN o % 2 = 0 THEN '## ' ELSE '# ' END, substr(text, 1, 20)) ELSE CASE WHEN h % 3 = 2 THEN ' ' ELSE text END END) AS text FROM lines GROUP BY doc_id""",
    ),
    "fx_blocks": (
        "doc_id string, pos int, kind string, text string",
        "SELECT doc_id, i AS pos, CASE role WHEN 'figure' THEN 'caption' WHEN 'formula' THEN 'table' ELSE role END AS kind, text FROM lines",
    ),
}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    some = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select(F.col("doc_id").alias("d"), "lang", F.posexplode(some).alias("i", "text")).withColumn("i", F.col("i") + 1)


def planted(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The relation of this name over the documents of folder d."""
    sql = RELATIONS[name][1]
    made = "lines AS (" + _LINES.replace("split_lines", "{split_lines}") + ")"
    # one text of all lines, in order
    sql = _joined(sql, "array_join(transform(array_sort(collect_list(struct(i, {0} AS t))), x -> x.t), '\n\n')")
    kinds = [c.rsplit(" ", 1) for c in RELATIONS[name][0].split(", ")]
    cast = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in kinds)
    given = {}
    if " documents" in sql:
        sql, given = sql.replace("FROM documents", "FROM {documents}"), {"documents": spark.read.parquet(f"{d}/documents.parquet")}
        return spark.sql(f"SELECT {cast} FROM ({_braced(sql)}) r", **given)
    return spark.sql(f"WITH {_braced(made)} SELECT {cast} FROM ({_braced(sql)}) r", split_lines=_lines(spark, d))


def over_lines(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """Any SELECT over the lines of all documents."""
    made = "lines AS (" + _LINES.replace("split_lines", "{split_lines}") + ")"
    return spark.sql(f"WITH {_braced(made)} {_braced(sql)}", split_lines=_lines(spark, d))


def _braced(sql: str) -> str:
    """Braces of JSON texts doubled; those of parameters stay."""
    kept = sql.replace("{split_lines}", "\0").replace("{documents}", "\1")
    return kept.replace("{", "{{").replace("}", "}}").replace("\0", "{split_lines}").replace("\1", "{documents}")


def _joined(sql: str, form: str) -> str:
    if "string_join(" not in sql:
        return sql
    head, rest = sql.split("string_join(", 1)
    inner, tail = rest.split(" END) AS text", 1)
    return head + form.replace("{0}", inner + " END") + " AS text" + tail


_KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
_SPLIT = """split_lines AS (SELECT d, lang, text, CAST(i AS INTEGER) AS i FROM (SELECT doc_id AS d, lang, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))"""


def _definition(n: str, sql: str) -> str:
    cast = ", ".join(f"CAST({c} AS {_KINDS[k]}) AS {c}" for c, k in (x.rsplit(" ", 1) for x in RELATIONS[n][0].split(", ")))
    return f"{n} AS (SELECT {cast} FROM ({_joined(sql, 'string_agg({0}, chr(10) || chr(10) ORDER BY i)')}) r)"


def ctes(*names: str) -> str:
    """CTE definitions of the relations for DuckDB, without the leading WITH."""
    return ",\n".join([_SPLIT, f"lines AS ({_LINES})", *(_definition(n, RELATIONS[n][1]) for n in names)])


# --- files -----------------------------------------------------------------------------------------------------------

#: Every line as a laid out paragraph of a DOCX file, its faults planted: t is what the paragraph says.
_LAID = """SELECT *, CASE (d + 3 * i) % 7 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'unspecified' ELSE CASE WHEN d % 2 = 0 THEN 'justify' ELSE 'left' END END AS alignment,
  CASE (d + i) % 9 WHEN 0 THEN 0.0 WHEN 1 THEN 10.9 WHEN 2 THEN 14.0 WHEN 3 THEN NULL ELSE 12.5 END AS first_line_indent_mm, CASE (2 * d + i) % 10 WHEN 0 THEN 1.7 WHEN 1 THEN 1.65 WHEN 2 THEN 1.0 WHEN 3 THEN NULL ELSE 1.5 END AS line_spacing,
  CASE (3 * d + i) % 12 WHEN 0 THEN 11.5 WHEN 1 THEN 12.0 WHEN 2 THEN NULL ELSE 14.0 END AS font_size_pt, CASE (4 * d + i) % 15 WHEN 0 THEN 'Arial' WHEN 1 THEN NULL ELSE 'Times New Roman' END AS font_family, (5 * d + i) % 13 = 0 AS bold, (6 * d + i) % 14 = 0 AS non_black,
  CASE role WHEN 'heading' THEN concat(CASE WHEN (d + o) % 7 = 0 THEN '' ELSE concat(o, ' ') END, CASE (d + 5 * o) % 6 WHEN 0 THEN 'Введение' WHEN 1 THEN 'Заключение' WHEN 2 THEN 'Содержание' WHEN 3 THEN 'Приложение Материалы' ELSE 'Раздел о деле' END, CASE WHEN (d + o) % 5 = 0 THEN '.' ELSE '' END)
    WHEN 'figure' THEN CASE (7 * d + i) % 5 WHEN 1 THEN concat('Рисунок ', o, '-Слитно') WHEN 2 THEN concat('Рисунок ', o, ' — Вид.') WHEN 4 THEN '' ELSE concat('Рисунок ', o, ' — Схема работы') END WHEN 'table' THEN concat('Таблица ', o, ' — Данные о деле')
    WHEN 'formula' THEN concat('y = kx + ', length(text), CASE (d + i) % 7 WHEN 0 THEN concat(' ', o) WHEN 1 THEN '' ELSE concat(' (', o, ')') END) ELSE concat('Основной текст абзаца в строке номер ', i, ' документа: ', text) END AS t,
  CASE WHEN (d + o) % 4 = 2 AND d % 17 <> 16 THEN 'below' ELSE 'above' END AS grid, CASE WHEN d % 5 = 0 THEN 'Итого.' ELSE 'Год' END AS head, CASE WHEN d % 4 = 0 THEN 'left' ELSE 'center' END AS head_alignment FROM lines"""
_PAGES = """SELECT doc_id, CASE d % 6 WHEN 0 THEN 216.0 WHEN 1 THEN 420.0 WHEN 2 THEN 213.1 ELSE 210.0 END AS width_mm, CASE d % 7 WHEN 0 THEN 279.0 ELSE 297.0 END AS height_mm, CASE d % 5 WHEN 0 THEN 25.0 WHEN 1 THEN 31.6 WHEN 2 THEN NULL ELSE 30.0 END AS left_mm,
  CASE d % 8 WHEN 0 THEN NULL WHEN 1 THEN 16.5 WHEN 2 THEN 17.0 ELSE 15.0 END AS right_mm, CASE d % 11 WHEN 3 THEN 18.5 WHEN 4 THEN 25.0 ELSE 20.0 END AS top_mm, CASE d % 13 WHEN 5 THEN 25.0 WHEN 6 THEN NULL ELSE 20.0 END AS bottom_mm,
  d % 3 <> 0 AS page_field, CASE d % 4 WHEN 1 THEN 'right' WHEN 2 THEN 'unspecified' ELSE 'center' END AS footer_alignment, d % 6 = 1 AS header_field, d % 7 = 0 AS first_field, d % 2 = 0 AS title_page, CASE d % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 END AS page_start FROM lines WHERE i = 1"""

_SECTION_ID = "CASE WHEN (d + o) % 7 = 0 THEN concat('sec_auto_', sum(CASE WHEN (d + o) % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i)) ELSE concat('sec_', o) END"
#: What reading the files must give: the relations of the checks, for DuckDB.
FILES = {
    "fx_docs": "SELECT doc_id, NULL AS title, NULL AS language FROM laid WHERE i = 1",
    "fx_sections": f"""SELECT a.doc_id, o AS ord, section_id, number, CASE WHEN number = '' THEN t ELSE t[length(number) + 2:] END AS title, 1 AS level, coalesce(b.text, '') AS text
  FROM (SELECT *, {_SECTION_ID} AS section_id, CASE WHEN (d + o) % 7 = 0 THEN '' ELSE CAST(o AS VARCHAR) END AS number FROM laid WHERE role = 'heading') a
  LEFT JOIN (SELECT d, h, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM laid WHERE role <> 'heading' AND t <> '' GROUP BY d, h) b ON a.d = b.d AND a.h = b.h""",
    "fx_paragraphs": f"""SELECT p.doc_id, o AS ord, concat('p_', o) AS paragraph_id, section_id, t AS text, NULL AS page, i AS paragraph_index FROM (SELECT * FROM laid WHERE role = 'para') p
  LEFT JOIN (SELECT d, h, {_SECTION_ID} AS section_id FROM laid WHERE role = 'heading') s ON s.d = p.d AND s.h = p.h""",
    "fx_figures": "SELECT doc_id, o AS ord, concat('fig_', o) AS item_id, t AS caption, NULL AS page, i AS paragraph_index FROM laid WHERE role = 'figure'",
    "fx_tables": "SELECT doc_id, o AS ord, concat('tbl_', o) AS item_id, t AS caption, NULL AS page, i AS paragraph_index FROM laid WHERE role = 'table'",
    "fx_para_layout": "SELECT doc_id, i AS paragraph_index, t AS text, alignment, first_line_indent_mm, line_spacing, font_size_pt AS font_size_pt_min, font_family, bold AS has_bold_text, non_black AS has_non_black_text FROM laid WHERE t <> ''",
    "fx_table_layout": "SELECT doc_id, o - 1 AS table_index, i AS caption_paragraph_index, grid AS caption_position, head AS header_text, head_alignment AS header_alignment, NULL AS appendix_letter FROM laid WHERE role = 'table'",
    "fx_page_layout": f"SELECT doc_id, 0 AS section_index, width_mm AS page_width_mm, height_mm AS page_height_mm, left_mm AS left_margin_mm, right_mm AS right_margin_mm, top_mm AS top_margin_mm, bottom_mm AS bottom_margin_mm FROM ({_PAGES})",
    "fx_page_numbering": f"SELECT doc_id, 0 AS section_index, title_page AS different_first_page, page_field AS footer_field, CASE WHEN page_field THEN footer_alignment END AS footer_alignment, header_field, first_field AS first_footer_field, page_start AS page_number_start FROM ({_PAGES})",
    "fx_formulas": """SELECT doc_id, o AS ord, i AS paragraph_index, t AS text, alignment, true AS is_standalone, CASE WHEN (d + i) % 7 > 1 THEN CAST(o AS VARCHAR) END AS equation_number, CASE (d + i) % 7 WHEN 0 THEN CAST(o AS VARCHAR) WHEN 1 THEN CAST(length(text) AS VARCHAR) END AS raw_equation_number,
  false AS prev_blank, false AS next_blank, coalesce(later, '') AS next_text, NULL AS appendix_letter FROM (SELECT *, lead(CASE WHEN t <> '' THEN trim(regexp_replace(t, '\\s+', ' ', 'g')) END IGNORE NULLS) OVER (PARTITION BY d ORDER BY i) AS later FROM laid) WHERE role = 'formula'""",
    "fx_heading_layout": f"SELECT doc_id, {_SECTION_ID} AS section_id, i AS paragraph_index, alignment FROM laid WHERE role = 'heading'",
}


def of_files(sql: str) -> str:
    """A query's SQL over the relations, with those that its files must give in their place."""
    for n, own in FILES.items():
        sql = sql.replace(_definition(n, RELATIONS[n][1]), _definition(n, own))
    return sql.replace(f"lines AS ({_LINES})", f"lines AS ({_LINES}), laid AS ({_LAID})")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, content): all documents as DOCX files with planted faults of layout."""
    with_ = "WITH lines AS (" + _LINES.replace("split_lines", "{split_lines}") + "), laid AS (" + _LAID + ") "
    lines = _lines(spark, d)
    item = "doc_id, i, {0} AS sub, {1} AS kind, {2} AS text, {3} AS style, {4} AS alignment, first_line_indent_mm, line_spacing, font_size_pt, font_family, bold, non_black, {5} AS drawing"
    own = item.format("1", "'p'", "t", "CASE WHEN role = 'heading' THEN 'heading 1' END", "alignment", "role = 'figure' AND t = ''")
    grid = item.format("CASE grid WHEN 'below' THEN 0 ELSE 2 END", "'table'", "head", "CAST(NULL AS STRING)", "head_alignment", "false")
    items = spark.sql(with_ + f"SELECT {own} FROM laid UNION ALL SELECT {grid} FROM laid WHERE role = 'table'", split_lines=lines)
    return docx.composed(items, spark.sql(with_ + _PAGES, split_lines=lines))
