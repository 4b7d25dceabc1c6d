"""Small inline relations in Russian, with the same rows for Spark and for the oracle SQL.

The driver's documents hold no Russian text and no layout, so the checks that need them are compared on these.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LONG = "Система " + "обработки данных " * 27 + "работает."  # 56 words
LINE = "Длинная строка основного текста документа, которая занимает больше восьмидесяти знаков."
NEAR = "Система " + "обработки данных " * 26 + "работает."  # 54 words

SCHEMAS = {
    "fx_docs": "doc_id string, title string, language string",
    "fx_sections": "doc_id string, ord int, section_id string, number string, title string, level int, text string",
    "fx_paragraphs": "doc_id string, ord int, paragraph_id string, section_id string, text string, page int, paragraph_index int",
    "fx_figures": "doc_id string, ord int, item_id string, caption string, page int, paragraph_index int",
    "fx_tables": "doc_id string, ord int, item_id string, caption string, page int, paragraph_index int",
    "fx_para_layout": "doc_id string, paragraph_index int, text string, alignment string, first_line_indent_mm double, line_spacing double, font_size_pt_min double, font_family string, has_bold_text boolean, has_non_black_text boolean",
    "fx_page_layout": "doc_id string, section_index int, page_width_mm double, page_height_mm double, left_margin_mm double, right_margin_mm double, top_margin_mm double, bottom_margin_mm double",
    "fx_page_numbering": "doc_id string, section_index int, different_first_page boolean, footer_field boolean, footer_alignment string, header_field boolean, first_footer_field boolean, page_number_start int",
    "fx_table_layout": "doc_id string, table_index int, caption_paragraph_index int, caption_position string, header_text string, header_alignment string, appendix_letter string",
    "fx_formulas": "doc_id string, ord int, paragraph_index int, text string, alignment string, is_standalone boolean, equation_number string, raw_equation_number string, prev_blank boolean, next_blank boolean, next_text string, appendix_letter string",
    "fx_heading_layout": "doc_id string, section_id string, paragraph_index int, alignment string",
    "fx_rules": "standard_id string, ord int, rule_id string, number string, section_id string, title string, content string, object_type string, constraint_type string",
    "fx_issues": "doc_id string, ord int, issue_id string, type string, subtype string, severity string, message string, section_id string, paragraph_id string, paragraph_index int, page int, evidence string, rule_id string, quote string, suggestion string, agent string",
    "fx_agents": "doc_id string, agent string, error string",
    "fx_nodes": "id string, ord int, name string, type string, content string, number string, section_title string, object_type string, constraint_type string, keywords string",
    "fx_edges": "source string, target string, type string",
    "fx_raw": "doc_id string, text string",
    "fx_lines": "standard_id string, pos int, line string",
    "fx_fixes": "doc_id string, target string, ord int, before string, after string",
    "fx_blocks": "doc_id string, pos int, kind string, text string",
    "fx_hits": "query_id int, rank int, id string, entry_type string",
    "fx_queries": "query_id int, query string",
    "fx_chat": "doc_id string, response string",
}

ROWS: dict[str, list[tuple]] = {
    "fx_docs": [("d1", "Отчет", "ru"), ("d2", "Доклад", "ru"), ("d3", "Пустой", "ru"), ("d4", "Статья", "ru"), ("d5", "Записка", "ru"), ("d6", "Обзор", "ru")],
    "fx_sections": [
        ("d1", 1, "s1", "1", "Введение", 1, "Цель работы. На рисунке 1 показана схема."), ("d1", 2, "s2", "2", "Основная часть", 1, "Описание метода."), ("d1", 3, "s21", "2.1", "Метод", 2, "Метод описан."),
        ("d1", 4, "s23", "2.3", "Данные.", 2, ""), ("d1", 5, "s4", "4", "Заключение", 1, "Итоги."), ("d1", 6, "s5", "5", "Список литературы", 1, "1. Иванов И. Книга. 2. Петров П. Статья."),
        ("d2", 1, "a", "2", "Заключение", 1, ""), ("d2", 2, "b", "3.1", "Подраздел", 2, "т"), ("d2", 3, "c", "3.1", "Подраздел снова", 2, "т"), ("d2", 4, "d", "", "Введение", 1, "т"), ("d2", 5, "e", "5.2.1", "Глубоко", 3, "т"), ("d2", 6, "f", "", "Приложение А", 1, "т"),
        ("d4", 1, "x", "", "Обзор", 1, ""), ("d4", 2, "y", "", "Ещё", 1, "текст ёлки"),
        ("d5", 1, "p1", "1", "ВВЕДЕНИЕ", 1, "текст"), ("d5", 2, "p2", "2", "Выводы", 1, "текст"), ("d5", 3, "p3", "3", "Источники", 1, "текст"), ("d5", 4, "p4", "", "", 1, "текст"), ("d5", 5, "p5", "3.a", "Буква", 2, "текст"),
        ("d6", 1, "q1", "1", "Содержание", 1, "Перечень"), ("d6", 2, "q2", "2", "Приложение Материалы", 1, "т"), ("d6", 3, "q3", "3", "Введение", 1, "т"), ("d6", 4, "q4", "", "Расчет", 1, "т"),
    ],
    "fx_paragraphs": [
        ("d1", 1, "p_1", "s1", "Цель работы состоит в анализе. На рисунке 1 показана схема.", 1, 2), ("d1", 2, "p_2", "s2", LONG, 1, 4), ("d1", 3, "p_3", "s2", NEAR, 2, 5), ("d1", 4, "p_4", "s21", "Короче говоря, метод простой, блин.", 2, 7), ("d1", 5, "p_5", "s21", "1. первый пункт", 2, 8), ("d1", 6, "p_6", "s23", "• второй пункт", 2, 9), ("d1", 7, "p_7", "s23", "1. Третий похож на заголовок", 2, 11), ("d1", 8, "p_8", "s23", "б) четвёртый", 2, 13), ("d1", 9, "p_9", "s1", "• заголовок", 2, 1),
        ("d2", 1, "p_1", "b", "Эта фигня не работает. Тупой подход! Жесть", 1, 2), ("d2", 2, "p_2", "c", "Фигнягенератор тут ни при чём.", 1, 3), ("d2", 3, "p_3", None, "а" * 421, 2, 4),
        ("d5", 1, "p_1", "p1", "Обычный текст с  пробелами.", 1, 1), ("d5", 2, "p_2", "p2", "а) пункт", 1, 2), ("d5", 3, "p_3", "p2", "а. пункт", 1, 3),
        ("d6", 1, "p_1", "q1", "Содержание и прочее", 1, None), ("d6", 2, "p_2", "q3", "Ну короче, КАПЕЦ как быстро. См. Таблица 1 – Данные", 1, 3),
    ],
    "fx_figures": [("d1", 1, "fig_1", "Рисунок 1 — Схема", 1, 3), ("d1", 2, "fig_2", "Рис. 3 - График.", 2, 6), ("d1", 3, "fig_3", "", 2, None), ("d1", 4, "fig_4", "Рисунок 3 – Повтор", 3, 10), ("d5", 1, "fig_1", "Рисунок 1.2 — Вид", 1, 2), ("d5", 2, "fig_2", "Рисунок 2 — План", 1, 3), ("d6", 1, "fig_1", "Схема 7 без слова", 1, 2), ("d6", 2, "fig_2", "Рисунок 2-Слитно", 1, 9), ("d6", 3, "fig_3", "Рисунок 3 - ...", 1, 10), ("d6", 4, "fig_4", "Рис 4 - Коротко", 1, None)],
    "fx_tables": [("d1", 1, "tbl_1", "Таблица 1 — Данные", 1, 5), ("d1", 2, "tbl_2", "Таблица без номера", 2, 8), ("d2", 1, "tbl_1", "", 1, 3), ("d6", 1, "tbl_1", "Таблица 1 – Данные", 1, 4), ("d6", 2, "tbl_2", "Таблица А.2 — Прочее", 1, 9), ("d6", 3, "tbl_3", "Таблица 3-Слитно", 1, 11), ("d5", 1, "tbl_1", "таблица 1 - Строчная", 1, 7)],
    "fx_para_layout": [
        ("d1", 2, "Цель работы состоит в анализе. На рисунке 1 показана схема.", "justify", 12.5, 1.5, 14.0, "Times New Roman", False, False), ("d1", 3, "Рисунок 1 — Схема", "left", 0.0, 1.5, 14.0, "Times New Roman", False, False), ("d1", 4, LONG, "left", 10.9, 1.5, 11.5, "Arial", True, False), ("d1", 5, NEAR, "left", 14.0, 1.7, 12.0, "Times New Roman", False, True),
        ("d1", 6, "Рис. 3 - График.", "center", 0.0, 1.5, 14.0, "Times New Roman", False, False), ("d1", 7, "Короче говоря, метод простой, блин.", "justify", 12.5, 1.65, 14.0, None, False, False), ("d1", 8, "1. первый пункт", "justify", 0.0, 1.5, 14.0, "Times New Roman", False, False), ("d1", 9, "• второй пункт", "justify", 12.5, 1.5, 14.0, "Times New Roman", False, False),
        ("d5", 1, "Министерство образования", "center", None, None, None, None, None, None), ("d5", 2, "Отчет о работе 2024", "center", None, None, None, None, None, None),
        *[("d5", 50 + i, LINE, "left", None, None, None, None, None, None) for i in range(2)], ("d5", 60, LINE, "right", None, None, None, None, None, None),
        ("d2", 1, "Выполнил: студент группы 12", "right", None, None, None, None, None, None), ("d2", 2, "Проверил", "right", None, None, None, None, None, None), ("d2", 3, "2023", "center", None, None, None, None, None, None), *[("d2", 50 + i, LINE, a, None, None, None, None, None, None) for i, a in enumerate(["left", "left", None, "justify", "center"])],
        *[("d4", i, t, a, None, None, None, None, None, None) for i, (t, a) in enumerate([("а", "left"), ("б", "left"), ("в", "right"), ("г", None), ("д", "left"), ("весна 2020 г.", "left")], 1)],
        ("d6", 1, "Университет", "left", None, None, None, None, None, None), ("d6", 2, "12024", "left", None, None, None, None, None, None),
    ],
    "fx_page_layout": [("d1", 0, 210.0, 297.0, 30.0, 15.0, 20.0, 20.0), ("d1", 1, 297.0, 210.0, 25.0, 15.0, 20.0, 20.0), ("d2", 0, 216.0, 279.0, 30.0, None, 20.0, 25.0), ("d5", 0, 420.0, 299.0, 31.5, 16.5, 18.5, 20.0), ("d6", 0, 213.1, 297.0, 31.6, 15.0, 20.0, 20.0), ("d4", 0, None, 297.0, None, None, None, None)],
    "fx_page_numbering": [("d1", 0, False, True, "right", False, False, None), ("d1", 1, False, True, "center", True, False, 5), ("d2", 0, False, False, "unspecified", False, False, None), ("d5", 0, True, True, "center", False, True, 1), ("d6", 0, True, True, "center", False, False, 0)],
    "fx_table_layout": [("d1", 0, 5, "above", "Имя", "center", None), ("d1", 1, 8, "below", "Итого.", "left", None), ("d6", 0, 4, "above", "Год", "center", None), ("d6", 1, None, "missing", "Сумма.", "center", "А")],
    "fx_formulas": [
        ("d1", 1, 10, "y = kx + b (1)", "center", True, "1", None, True, True, "где k - коэффициент", None), ("d1", 2, 12, "z = x 3", "left", True, None, "3", False, True, "где: x - число", None), ("d1", 3, 14, "w = q + r (2)", "center", True, "2", None, True, True, "Далее", None), ("d1", 4, 15, "u = v (2)", "center", False, "2", None, True, False, "", None),
        ("d4", 1, 3, "a = b +", "center", True, "1", None, True, True, "c + d", None), ("d4", 2, 5, "a = b +", "center", True, "2", None, True, False, "+ c", None), ("d4", 3, 7, "q = r (3)", None, None, "3", None, True, False, "где q - путь", None), ("d4", 4, 9, "s = t (4)", "center", True, "4", None, True, True, "Скорость — отношение", None), ("d4", 5, 11, "s = t *", "center", True, "5", None, True, False, "где s - путь", None),
        ("d6", 1, 5, "a = b", "center", True, None, None, True, True, "", None), ("d6", 2, 7, "c = d (А.2)", "center", True, "А.2", None, True, True, "", "А"), ("d6", 3, 8, "e = f (А.2)", "center", True, "А.2", None, True, True, "", "А"),
    ],
    "fx_heading_layout": [("d1", "s1", 1, "center"), ("d1", "s2", 3, "center"), ("d1", "s21", 6, "left"), ("d2", "f", 9, "left"), ("d5", "p1", 0, "left")],
    "fx_rules": [
        ("g", 1, "r1", "5.1", "s5", "Рисунки", "Рисунки следует нумеровать арабскими цифрами", "figure", "numbering"), ("g", 2, "r2", "5.10", "s5", "Место рисунков", "Подпись рисунка располагают по центру", "figure", "placement"), ("g", 3, "r3", "5.2", "s5", "Ссылки на рисунки", "На все рисунки должны быть ссылки, см. 5.1", "figure", "reference_required"),
        ("g", 4, "r4", "6.1", "s6", "Таблицы", "Таблицы нумеруют в соответствии с 5.1 и 6.2", "table", "numbering"), ("g", 5, "r5", "6.2", "s6", "Название таблицы", "Название обязательно согласно 6.1", "table", "required_presence"), ("g", 6, "r6", "7.1", "s7", "Формулы", "Формулы нумеруют, 9.9 не существует", "formula", "numbering"), ("g", 7, "r7", "7", "s7", "Общее", "Общие требования", "generic", "generic"),
        ("g", 8, "r8", "5.3", "s5", "Подписи", "Подпись обязательна, см. раздел 6", "figure", "caption_required"), ("g", 9, "r9", "6.0", "s6", "Вид таблиц", "Таблицы печатают", "table", "formatting"), ("g", 10, "r10", "6.3", "s6", "Место таблиц", "С учетом 6.2 таблицу размещают сразу", "table", "placement"), ("g", 11, "r11", "5.0", "s5", "Рисунок", "Рисунки", "figure", "generic"),
    ],
    "fx_issues": [
        ("d1", 1, "i1", "structure", "numbering_error", "warning", "m", "s1", None, None, 1, "a", "r1", "q", None, "structure_agent"), ("d1", 2, "i2", "structure", "numbering_error", "critical", "m", "s1", None, None, 1, "a", "r1", "q", None, "rag_agent"), ("d1", 3, "i3", "structure", "numbering_error", "critical", "m", "s1", None, None, 1, "a", "r1", "q", "fix", "style_agent"), ("d1", 4, "i4", "structure", "numbering_error", "critical", "m", "s1", None, None, 1, "b", "r1", "q", "fix", "style_agent"),
        ("d1", 5, "i5", "style", "", "info", "long", None, "p1", 3, None, "xx", "r2", "", "", "style_agent"), ("d1", 6, "i6", "style", "", "info", "long", None, "p1", 3, None, "xxx", "r2", "", "", "style_agent"), ("d1", 7, "i7", "odd", "z", "note", "m", None, None, None, None, "e", None, None, None, "x"),
        ("d2", 1, "i1", "formatting", "missing", "warning", "m", None, None, None, None, "short", "r", "q", "t", "rag_agent"), ("d2", 2, "i2", "formatting", "missing", "warning", "m", None, None, None, None, "longer", "r", "q", "t", "rag_agent"), ("d2", 3, "i0", "logic", "k", "critical", "m", None, None, None, None, "e", "r", "q", None, "logic_agent"),
    ],
    "fx_agents": [("d1", "structure_agent", None), ("d1", "rag_agent", None), ("d1", "style_agent", None), ("d2", "rag_agent", "no parsed standard"), ("d2", "structure_agent", None), ("d3", "structure_agent", None)],
    "fx_nodes": [
        ("n1", 1, "Раздел один", "section", "Общие положения", "1", None, None, None, None), ("n2", 2, "Правило рисунков", "rule", "Рисунки нумеруют", "1.1", "Раздел один", "figure", "numbering", "рисунок,нумерация"), ("n3", 3, "Правило таблиц", "rule", "Таблицы нумеруют", "1.2", "Раздел один", "table", "numbering", ""), ("n4", 4, "figure", "object_type", "", None, None, "figure", None, None),
        ("n5", 5, "numbering", "constraint", "", None, None, None, "numbering", None), ("n6", 6, "рисунок", "keyword", "", None, None, None, None, None), ("n7", 7, "Остров", "rule", "Недостижимо", "1.3", None, "figure", "generic", None), ("n8", 8, "odd_type", "object_type", "", None, None, "odd_type", None, None), ("n9", 9, "Правило прочего", "rule", "Прочее " * 40, "1.4", "Раздел один", "odd_type", "generic", ""),
    ],
    "fx_edges": [("n1", "n2", "contains"), ("n1", "n3", "contains"), ("n2", "n4", "applies_to"), ("n2", "n4", "applies_to"), ("n2", "n3", "rule_follows"), ("n3", "n2", "references"), ("n2", "n5", "constrains"), ("n3", "n5", "constrains"), ("n2", "n6", "mentions"), ("n5", "n5", "self"), ("n4", "n1", "back"), ("n9", "n8", "applies_to"), ("n9", "n2", "depends_on"), ("n2", "n9", "depends_on")],
    "fx_raw": [
        ("t1", "1 Введение\r\n\r\nЦель работы.\r\n\r\nРисунок 1 — Схема\r\n\r\n2 Метод\r\n\r\nОписание.\r\n\r\nТаблица 1 - Данные\r\n\r\n2.1 Детали метода\r\n\r\nЕщё текст."), ("t2", "Без раздела\n\n   \n\nРис. 2 Вид\n\nПриложение А Материалы\n\nПриложение Материалы\n\nТекст приложения"), ("t3", ""), ("t4", "# Заголовок\nтекст\n\n## Пусто\n\n## Второй\nещё\nстроки"),
    ],
    "fx_lines": [("g", i, t) for i, t in enumerate(["СТАНДАРТ", "", "1 Область применения", "Настоящий стандарт устанавливает тре-", "бования к отчету.", "", "3 Лишний раздел", "2 Оформление", "2.1 Рисунки следует нумеровать Рисунок должен иметь наименование,", "подпись располагают снизу.", "For Staff Page 7", "12:30", "Дата сохранения: вчера", "2.2 Титульный лист отчета", "Титульный лист должен содержать сведения. Приложение А Пример", "Библиография", "[1] Книга"], 1)],
    "fx_fixes": [("d1", "p_4", 1, "Короче говоря", "Таким образом"), ("d1", "p_4", 2, "блин", ""), ("d1", "p_1", 1, "нет такого", "Новый текст"), ("d2", "p_1", 1, "фигня", "ошибка")],
    "fx_blocks": [("b1", 1, "para", "текст"), ("b1", 2, "caption", "Таблица 1 — А"), ("b1", 3, "para", "пояснение"), ("b1", 4, "table", ""), ("b1", 5, "table", ""), ("b1", 6, "caption", "Таблица 2 — Б"), ("b1", 7, "heading", "Раздел"), ("b1", 8, "table", ""), ("b1", 9, "heading", "Далее"), ("b1", 10, "caption", "Таблица 3 — В")],
    "fx_hits": [(q, r, f"h{r}", "bridging_fact" if r in b else "aku") for q, b in ((1, (1, 2, 3, 4, 6)), (2, ()), (3, (2, 5))) for r in range(1, 9)],
    "fx_queries": [(1, "Как оформить рисунок и его нумерацию?"), (2, "Общие положения"), (3, "таблица и правило таблиц"), (4, "Где odd type?")],
    "fx_chat": [("d1", '{"issues":[{"subtype":"spelling_error","paragraph_id":"p_1","severity":"","confidence":"high","before":"а","after":"б"},{"subtype":"long_sentence","paragraph_id":"p_2","severity":"info","confidence":"low","before":"","after":""}]}'), ("d2", 'Ответ:\n```json\n{"issues":[{"subtype":"other","paragraph_id":"p_1","severity":"info","confidence":"high","before":"x","after":"y"},{"subtype":"long_sentence","paragraph_id":"p_3","severity":"info","confidence":"medium","before":"x","after":"y"}]}\n```'), ("d5", '{"issues":[{"subtype":'), ("d6", "нет ошибок")],
}


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the program as a relation whose size the planner knows; of one made from a list it takes the largest there is, and broadcasts what it meets."""
    columns = [c.split() for c in schema.split(", ")]
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], _ARROW[k]) for i, (c, k) in enumerate(columns)}))


def fixture(spark: SparkSession, name: str) -> DataFrame:
    return local(spark, ROWS[name], SCHEMAS[name])


_KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def values(*names: str) -> str:
    """CTE definitions of some relations for DuckDB, without the leading WITH."""
    out = []
    for n in names:
        cols = [c.split() for c in SCHEMAS[n].split(", ")]
        rows = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in ROWS[n])
        cast = ", ".join(f"CAST({c} AS {_KINDS[k]}) AS {c}" for c, k in cols)
        out.append(f"{n} AS (SELECT {cast} FROM (VALUES {rows}) AS v({', '.join(c for c, _ in cols)}))")
    return ",\n".join(out)
