"""Queries of the structure, style and reporting operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators import structure as S
from ..operators import style as T
from .planted import ctes, planted

Q: dict = {}


def _fx(spark, d, *names):
    return [planted(spark, d, n) for n in names]


def _entries(spark, d):
    s, p = _fx(spark, d, "fx_sections", "fx_paragraphs")
    return S.structure_entries(s, p)


_ENTRIES = (
    ctes("fx_docs", "fx_sections", "fx_paragraphs")
    + r""",
fp AS (SELECT doc_id, section_id, arg_min(page, ord) AS page, arg_min(paragraph_id, ord) AS paragraph_id FROM fx_paragraphs GROUP BY ALL),
e0 AS (SELECT *, CASE WHEN regexp_full_match(coalesce(number, ''), '[0-9]+(\.[0-9]+)*') THEN list_transform(string_split(number, '.'), lambda x: CAST(x AS INTEGER)) ELSE [] END AS parts FROM fx_sections),
e AS (SELECT e0.doc_id, ord, e0.section_id, number, title, CAST(CASE WHEN len(parts) > 0 THEN len(parts) ELSE level END AS INTEGER) AS level, parts,
             CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '.') END AS parent_number, fp.page, fp.paragraph_id,
             trim(regexp_replace(replace(lower(coalesce(title, '')), 'ё', 'е'), '\s+', ' ', 'g')) AS folded
      FROM e0 LEFT JOIN fp ON e0.doc_id = fp.doc_id AND e0.section_id = fp.section_id)"""
)

Q["structure_entries"] = (
    lambda spark, d: _entries(spark, d).select("doc_id", "ord", "section_id", "level", F.array_join(F.col("parts").cast("array<string>"), ".").alias("parts"), "parent_number", F.coalesce("page", F.lit(-1)).alias("page"), "paragraph_id"),
    f"WITH {_ENTRIES} SELECT doc_id, ord, section_id, level, coalesce(array_to_string(parts, '.'), '') AS parts, parent_number, coalesce(page, -1) AS page, paragraph_id FROM e",
)


def _issues(df):
    return df.select("doc_id", "item_ord", "subtype", "severity", "section_id", "evidence")


Q["structure_unrecognized"] = (
    lambda spark, d: _issues(S.unrecognized(planted(spark, d, "fx_docs"), _entries(spark, d))),
    f"""WITH {_ENTRIES} SELECT d.doc_id, 0 AS item_ord, 'unrecognized_structure' AS subtype, 'critical' AS severity, CAST(NULL AS VARCHAR) AS section_id,
    CASE WHEN count(e.ord) = 0 THEN 'no sections' ELSE 'no numbered sections' END AS evidence
    FROM fx_docs d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id HAVING coalesce(max(len(parts)), 0) = 0""",
)
Q["structure_unnumbered"] = (
    lambda spark, d: _issues(S.unnumbered_top(_entries(spark, d))),
    f"""WITH {_ENTRIES}, t AS (SELECT *, max(len(parts)) OVER (PARTITION BY doc_id) AS most FROM e WHERE level = 1)
    SELECT doc_id, ord AS item_ord, 'numbering_error' AS subtype, 'warning' AS severity, section_id, 'no number: ' || title AS evidence FROM t WHERE most > 0 AND len(parts) = 0 AND NOT starts_with(folded, 'приложение')""",
)
Q["structure_duplicates"] = (
    lambda spark, d: _issues(S.duplicates(_entries(spark, d))),
    f"""WITH {_ENTRIES} SELECT doc_id, ord AS item_ord, 'numbering_error' AS subtype, 'critical' AS severity, section_id,
    'number ' || number || ' was used by: ' || first_value(title) OVER w AS evidence FROM e WHERE len(parts) > 0
    WINDOW w AS (PARTITION BY doc_id, parts ORDER BY ord) QUALIFY row_number() OVER w > 1""",
)
Q["structure_missing_parent"] = (
    lambda spark, d: _issues(S.missing_parents(_entries(spark, d))),
    f"""WITH {_ENTRIES}, b AS (SELECT * FROM e x WHERE len(parts) > 1 AND NOT EXISTS (SELECT 1 FROM e y WHERE y.doc_id = x.doc_id AND y.ord < x.ord AND len(y.parts) > 0 AND y.parts = x.parts[1:len(x.parts) - 1]))
    SELECT doc_id, ord AS item_ord, 'hierarchy_error' AS subtype, 'critical' AS severity, section_id, 'no parent: ' || number AS evidence FROM b
    UNION ALL SELECT doc_id, ord, 'hierarchy_error', 'critical', section_id, 'level jump: ' || number FROM b WHERE len(parts) > 2""",
)
Q["structure_first_number"] = (
    lambda spark, d: _issues(S.first_number(_entries(spark, d))),
    f"""WITH {_ENTRIES}, t AS (SELECT * FROM e WHERE len(parts) = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1)
    SELECT doc_id, ord AS item_ord, 'numbering_error' AS subtype, 'warning' AS severity, section_id, 'starts at ' || number AS evidence FROM t WHERE parts[1] <> 1""",
)
Q["structure_sequence_gaps"] = (
    lambda spark, d: _issues(S.sequence_gaps(_entries(spark, d))),
    f"""WITH {_ENTRIES}, t AS (SELECT *, parts[len(parts)] AS last, parts[1:len(parts) - 1] AS up, lag(parts[len(parts)]) OVER (PARTITION BY doc_id, parts[1:len(parts) - 1] ORDER BY ord) AS before FROM e WHERE len(parts) > 0)
    SELECT doc_id, ord AS item_ord, 'numbering_error' AS subtype, 'warning' AS severity, section_id, 'gap before ' || number AS evidence FROM t
    WHERE CASE WHEN before IS NULL THEN len(up) > 0 AND last <> 1 ELSE last <> before + 1 END""",
)
Q["structure_transitions"] = (
    lambda spark, d: _issues(S.transitions(_entries(spark, d))),
    f"""WITH {_ENTRIES}, t AS (SELECT *, lag(parts) OVER (PARTITION BY doc_id ORDER BY ord) AS was FROM e WHERE len(parts) > 0)
    SELECT doc_id, ord AS item_ord, 'order_error' AS subtype, 'critical' AS severity, section_id, 'unexpected ' || number AS evidence FROM t WHERE was IS NOT NULL AND NOT (
      (len(parts) = len(was) + 1 AND parts[1:len(was)] = was AND parts[len(parts)] = 1)
      OR (len(parts) <= len(was) AND coalesce(array_to_string(parts[1:len(parts) - 1], '.'), '') = coalesce(array_to_string(was[1:len(parts) - 1], '.'), '') AND parts[len(parts)] = was[len(parts)] + 1))""",
)
_GROUPS = "g AS (SELECT * FROM (VALUES (0, 'Введение', ['введение']), (1, 'Заключение', ['заключение', 'выводы']), (2, 'Список использованных источников', ['список использованных источников', 'список литературы', 'библиографический список', 'источники'])) AS v(part, expected, variants))"
Q["required_sections_missing"] = (
    lambda spark, d: _issues(S.missing_required(planted(spark, d, "fx_docs"), _entries(spark, d), planted(spark, d, "fx_paragraphs"))),
    f"""WITH {_ENTRIES}, {_GROUPS}, pool AS (SELECT doc_id, folded AS t FROM e WHERE level = 1 UNION ALL
      SELECT doc_id, replace(lower(text), 'ё', 'е') FROM fx_paragraphs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 80)
    SELECT d.doc_id, part AS item_ord, 'missing_required_section' AS subtype, 'warning' AS severity, CAST(NULL AS VARCHAR) AS section_id, '«' || expected || '»' AS evidence FROM fx_docs d, g
    WHERE NOT EXISTS (SELECT 1 FROM pool, (SELECT unnest(g.variants) AS v) WHERE pool.doc_id = d.doc_id AND contains(pool.t, v))""",
)
Q["required_sections_order"] = (
    lambda spark, d: _issues(S.required_order(_entries(spark, d))),
    f"""WITH {_ENTRIES}, {_GROUPS}, h AS (SELECT e.*, part FROM e, g WHERE level = 1 AND len(list_filter(variants, lambda v: contains(folded, v))) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY ord) = 1)
    SELECT a.doc_id, a.ord AS item_ord, 'order_error' AS subtype, 'warning' AS severity, a.section_id, 'too late: ' || a.title AS evidence FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.part = a.part + 1 WHERE a.ord > b.ord""",
)
_STEPS = [
    "structure_unrecognized", "structure_unnumbered", "structure_duplicates", "structure_missing_parent", "structure_first_number",
    "structure_sequence_gaps", "structure_transitions", "required_sections_missing", "required_sections_order",
]
Q["structure_issues_numbered"] = (
    lambda spark, d: S.check_structure(*_fx(spark, d, "fx_docs", "fx_sections", "fx_paragraphs")).groupBy("doc_id", "subtype", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("issue_id").alias("first_id")),
    # all checks in order, numbered, then without repeats
    f"""WITH {_ENTRIES}, every AS ({" UNION ALL ".join(f"SELECT {k} AS k, * FROM ({Q[q][1]})" for k, q in enumerate(_STEPS))}),
    kept AS (SELECT * FROM every WHERE k <> 7 OR doc_id IN (SELECT doc_id FROM e)),
    placed AS (SELECT v.*, page, paragraph_id, row_number() OVER (PARTITION BY v.doc_id ORDER BY k, item_ord, evidence) AS n FROM kept v LEFT JOIN e ON e.doc_id = v.doc_id AND e.section_id = v.section_id),
    once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY doc_id, subtype, section_id, paragraph_id, page, evidence ORDER BY n) = 1)
    SELECT doc_id, subtype, severity, count(*) AS n, 'issue_structure_' || lpad(CAST(min(n) AS VARCHAR), 3, '0') AS first_id FROM once GROUP BY ALL""",
)
Q["structure_map"] = (
    lambda spark, d: S.structure_map(planted(spark, d, "fx_docs"), _entries(spark, d), planted(spark, d, "fx_paragraphs")).select("doc_id", F.concat_ws("|", "titles").alias("titles"), F.size("missing").alias("n_missing"), "critical"),
    f"""WITH {_ENTRIES}, {_GROUPS}, pool AS (SELECT doc_id, folded AS t FROM e WHERE level = 1 UNION ALL SELECT doc_id, replace(lower(text), 'ё', 'е') FROM fx_paragraphs),
    m AS (SELECT d.doc_id, count(*) AS n FROM fx_docs d, g WHERE NOT EXISTS (SELECT 1 FROM pool, (SELECT unnest(g.variants) AS v) WHERE pool.doc_id = d.doc_id AND contains(pool.t, v)) GROUP BY d.doc_id)
    SELECT d.doc_id, coalesce((SELECT string_agg(title, '|' ORDER BY ord) FROM e WHERE e.doc_id = d.doc_id AND level = 1), '') AS titles, CAST(coalesce(m.n, 0) AS INTEGER) AS n_missing,
           coalesce((SELECT max(len(parts)) FROM e WHERE e.doc_id = d.doc_id), 0) = 0 AS critical FROM fx_docs d LEFT JOIN m USING (doc_id)""",
)


# --- style -----------------------------------------------------------------------------------------------------------

def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


_SENT = r"""s AS (SELECT {key}, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM {table}),
x AS (SELECT {key}, unnest(l) AS t, CAST(unnest(range(len(l))) AS INTEGER) AS sentence_ord FROM s)"""
_SENT_DOCS = _SENT.format(key="doc_id", table="documents")
_WORDS = "CAST(len(regexp_extract_all(t, '[A-Za-zА-Яа-яЁё0-9-]+')) AS INTEGER)"
Q["style_sentences"] = (
    lambda spark, d: _docs(spark, d).select("doc_id", F.size(T.sentences("text")).alias("n_sentences")),
    f"WITH {_SENT_DOCS} SELECT doc_id, CAST(len(l) AS INTEGER) AS n_sentences FROM s",
)
Q["style_long_sentence"] = (
    lambda spark, d: T.long_sentences(_docs(spark, d), ["doc_id"]),
    f"WITH {_SENT_DOCS} SELECT doc_id, sentence_ord, CAST(length(t) AS INTEGER) AS n_chars, {_WORDS} AS n_words FROM x WHERE {_WORDS} >= 55 OR length(t) >= 420",
)
Q["style_summary_by_doc"] = (
    lambda spark, d: T.style_summary(T.long_sentences(_docs(spark, d), ["doc_id"]).select("doc_id", F.lit("long_sentence").alias("subtype"), F.lit("split").alias("suggestion"))).select("doc_id", "total", "fixable", F.col("by_subtype")["long_sentence"].alias("long_sentence")),
    f"WITH {_SENT_DOCS} SELECT doc_id, count(*) AS total, count(*) AS fixable, count(*) AS long_sentence FROM x WHERE {_WORDS} >= 55 OR length(t) >= 420 GROUP BY doc_id",
)
_UNITS = (
    ctes("fx_sections", "fx_paragraphs")
    + """,
u AS (SELECT doc_id, ord, paragraph_id, section_id, text, page, paragraph_index FROM fx_paragraphs UNION ALL
      SELECT doc_id, ord, 'style_section_' || row_number() OVER (PARTITION BY doc_id ORDER BY ord), section_id, CASE WHEN coalesce(text, '') <> '' THEN text ELSE title END, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
      FROM fx_sections s WHERE NOT EXISTS (SELECT 1 FROM fx_paragraphs p WHERE p.doc_id = s.doc_id))"""
)
Q["style_text_units"] = (lambda spark, d: T.text_units(*_fx(spark, d, "fx_sections", "fx_paragraphs")).select("doc_id", "ord", "paragraph_id", "section_id", "text"), f"WITH {_UNITS} SELECT doc_id, ord, paragraph_id, section_id, text FROM u WHERE trim(text) <> ''")


def _lex(rows):
    return "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(rows)) + ") AS v(item, phrase, replacement))"


_AFTER = r"trim(regexp_replace(text[:instr(lower(text), phrase) - 1] || replacement || text[instr(lower(text), phrase) + length(phrase):], '\s{2,}', ' ', 'g'), ' ,')"
_HIT = "SELECT doc_id, paragraph_id, item, text[instr(lower(text), phrase):instr(lower(text), phrase) + length(phrase) - 1] AS fragment, " + _AFTER + " AS after FROM u, lex WHERE "
Q["style_colloquial"] = (
    lambda spark, d: T.lexicon_hits(T.text_units(*_fx(spark, d, "fx_sections", "fx_paragraphs")), T.COLLOQUIAL, ["doc_id", "paragraph_id"]).select("doc_id", "paragraph_id", "item", "fragment", "after"),
    f"WITH {_UNITS}, {_lex(T.COLLOQUIAL)} {_HIT} contains(replace(lower(text), 'ё', 'е'), phrase)",
)
Q["style_informal"] = (
    lambda spark, d: T.lexicon_hits(T.text_units(*_fx(spark, d, "fx_sections", "fx_paragraphs")), T.INFORMAL, ["doc_id", "paragraph_id"], True).select("doc_id", "paragraph_id", "item", "fragment", "after"),
    f"WITH {_UNITS}, {_lex(T.INFORMAL)} {_HIT} regexp_matches(replace(lower(text), 'ё', 'е'), '(^|[^\\p{{L}}\\p{{N}}_])' || phrase || '($|[^\\p{{L}}\\p{{N}}_])')",
)
Q["style_lexicon_documents"] = (
    # the same operator over the whole corpus, with an English lexicon
    lambda spark, d: T.lexicon_hits(_docs(spark, d), [("idiot", "person"), ("stupid", "simple"), ("trash", "waste"), ("clown", "actor"), ("loser", "runner-up")], ["doc_id"], True).select("doc_id", "item", "fragment"),
    f"WITH u AS (SELECT * FROM documents), {_lex([('idiot', 'person'), ('stupid', 'simple'), ('trash', 'waste'), ('clown', 'actor'), ('loser', 'runner-up')])} SELECT doc_id, item, text[instr(lower(text), phrase):instr(lower(text), phrase) + length(phrase) - 1] AS fragment FROM u, lex WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || phrase || '($|[^\\p{{L}}\\p{{N}}_])')",
)
LEXICAL = f"""{_UNITS}, v AS (SELECT * FROM u WHERE trim(text) <> ''), {_lex(T.COLLOQUIAL).replace("lex AS", "lc AS")}, {_lex(T.INFORMAL).replace("lex AS", "li AS")},
{_SENT.format(key="doc_id, ord, paragraph_id, section_id, page", table="v")},
hits AS (SELECT doc_id, ord, paragraph_id, section_id, page, 0 AS k, item, 'colloquial_phrase' AS subtype, text[instr(lower(text), phrase):instr(lower(text), phrase) + length(phrase) - 1] AS evidence FROM v, lc WHERE contains(replace(lower(text), 'ё', 'е'), phrase)
  UNION ALL SELECT doc_id, ord, paragraph_id, section_id, page, 1, item, 'informal_wording', text[instr(lower(text), phrase):instr(lower(text), phrase) + length(phrase) - 1] FROM v, li WHERE contains(replace(lower(text), 'ё', 'е'), phrase) AND regexp_matches(replace(lower(text), 'ё', 'е'), '(^|[^\\p{{L}}\\p{{N}}_])' || phrase || '($|[^\\p{{L}}\\p{{N}}_])')
  UNION ALL SELECT doc_id, ord, paragraph_id, section_id, page, 2, sentence_ord, 'long_sentence', CAST({_WORDS} AS VARCHAR) FROM x WHERE {_WORDS} >= 55 OR length(t) >= 420),
lexical AS (SELECT *, 'issue_style_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, k, item) AS VARCHAR), 3, '0') AS issue_id FROM hits)"""
Q["style_issues"] = (
    lambda spark, d: T.check_style(*_fx(spark, d, "fx_sections", "fx_paragraphs")).select("doc_id", "issue_id", "subtype", "paragraph_id", "evidence"),
    f"WITH {LEXICAL} SELECT doc_id, issue_id, subtype, paragraph_id, evidence FROM lexical",
)
_CHAT = """c AS (SELECT doc_id, CASE WHEN regexp_extract(response, '(?s)```(?:json)?\\s*(\\{.*\\})\\s*```', 1) <> '' THEN regexp_extract(response, '(?s)```(?:json)?\\s*(\\{.*\\})\\s*```', 1) ELSE regexp_extract(response, '(?s)\\{.*\\}') END AS j FROM fx_chat),
i AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM (SELECT doc_id, CAST(j->'issues' AS JSON[]) AS a FROM c WHERE json_valid(j)))"""
Q["style_chat_issues"] = (
    lambda spark, d: T.chat_issues(*_fx(spark, d, "fx_chat", "fx_paragraphs")),
    f"""WITH {ctes("fx_chat", "fx_paragraphs")}, {_CHAT} SELECT i.doc_id, 'issue_style_llm_' || lpad(CAST(i AS VARCHAR), 3, '0') AS issue_id, x->>'subtype' AS subtype, CASE WHEN coalesce(x->>'severity', '') = '' THEN 'warning' ELSE x->>'severity' END AS severity,
    x->>'paragraph_id' AS paragraph_id, section_id, page, x->>'before' AS before, x->>'after' AS after FROM i LEFT JOIN fx_paragraphs p ON p.doc_id = i.doc_id AND p.paragraph_id = x->>'paragraph_id'
    WHERE x->>'subtype' IN ('spelling_error', 'long_sentence') AND x->>'confidence' <> 'low'""",
)
Q["style_combined"] = (
    lambda spark, d: T.combined(T.chat_issues(*_fx(spark, d, "fx_chat", "fx_paragraphs")), T.check_style(*_fx(spark, d, "fx_sections", "fx_paragraphs"))).select("doc_id", "issue_id", "subtype"),
    f"""WITH {LEXICAL}, every AS (SELECT doc_id, issue_id, subtype, section_id, paragraph_id, page, coalesce(before, '') AS evidence, 0 AS src FROM ({Q["style_chat_issues"][1]})
      UNION ALL SELECT doc_id, issue_id, subtype, section_id, paragraph_id, page, evidence, 1 FROM lexical)
    SELECT doc_id, issue_id, subtype FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, subtype, section_id, paragraph_id, page, evidence ORDER BY src, issue_id) = 1""",
)
Q["logic_issues"] = (lambda spark, d: T.check_logic(planted(spark, d, "fx_docs")), "SELECT '' AS doc_id, '' AS issue_id, '' AS subtype, '' AS severity, '' AS section_id, '' AS paragraph_id, '' AS evidence, '' AS suggestion WHERE false")
Q["style_prompts"] = (
    # what a model is shown: each unit's id and text, read back from the JSON
    lambda spark, d: T.chat_prompts(T.text_units(*_fx(spark, d, "fx_sections", "fx_paragraphs"))).select("doc_id", "n", F.posexplode(F.from_json("prompt", "array<struct<paragraph_id:string,text:string>>")).alias("i", "u")).select("doc_id", "n", "i", "u.paragraph_id", F.md5(F.col("u.text").cast("binary")).alias("h")),
    f"""WITH {ctes("fx_sections", "fx_paragraphs")}, u AS (SELECT doc_id, ord, paragraph_id, text FROM fx_paragraphs UNION ALL SELECT doc_id, ord, 'style_section_' || row_number() OVER (PARTITION BY doc_id ORDER BY ord), CASE WHEN coalesce(text, '') <> '' THEN text ELSE title END FROM fx_sections s WHERE NOT EXISTS (SELECT 1 FROM fx_paragraphs p WHERE p.doc_id = s.doc_id)), v AS (SELECT * FROM u WHERE trim(text) <> '')
    SELECT doc_id, least(count(*) OVER (PARTITION BY doc_id), 40) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS i, paragraph_id, md5(text) AS h FROM v QUALIFY i < 40""",
)

# --- merging and reporting -------------------------------------------------------------------------------------------

_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, coalesce(suggestion, '') <> '' DESC, length(coalesce(evidence, '')) DESC, length(coalesce(quote, '')) DESC, ord"
_KEY = "doc_id, type, coalesce(nullif(subtype, ''), message), section_id, paragraph_id, paragraph_index, page, rule_id"
_MERGED = f"m AS (SELECT *, min(ord) OVER (PARTITION BY {_KEY}) AS position FROM fx_issues QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY {_RANK}) = 1)"
_FXI = ctes("fx_issues")
Q["issues_merged"] = (lambda spark, d: R.merged(planted(spark, d, "fx_issues")).select("doc_id", "issue_id", "severity", "evidence", "suggestion", "position"), f"WITH {_FXI}, {_MERGED} SELECT doc_id, issue_id, severity, evidence, suggestion, position FROM m")
_ORDER = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 99 END, CASE type WHEN 'structure' THEN 0 WHEN 'formatting' THEN 1 WHEN 'style' THEN 2 WHEN 'logic' THEN 3 ELSE 99 END, issue_id"
Q["issues_sorted"] = (lambda spark, d: R.ranked(R.merged(planted(spark, d, "fx_issues"))).select("doc_id", "issue_id", "rank"), f"WITH {_FXI}, {_MERGED} SELECT doc_id, issue_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) AS INTEGER) AS rank FROM m")
Q["issues_summary"] = (
    lambda spark, d: R.summary(R.merged(planted(spark, d, "fx_issues"))).select("doc_id", "total", "critical", "warning", "info", "fixable", F.coalesce(F.col("by_type")["structure"], F.lit(0)).alias("structure")),
    f"WITH {_FXI}, {_MERGED} SELECT doc_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (coalesce(suggestion, '') <> '') AS fixable, count(*) FILTER (type = 'structure') AS structure FROM m GROUP BY doc_id",
)
Q["report"] = (
    lambda spark, d: R.report(planted(spark, d, "fx_docs"), R.merged(planted(spark, d, "fx_issues")), planted(spark, d, "fx_agents")).select("doc_id", "status", "total", F.size(F.coalesce("agents_failed", F.create_map())).alias("n_failed")),
    f"WITH {ctes('fx_docs', 'fx_issues', 'fx_agents')}, {_MERGED}, a AS (SELECT doc_id, count(error) AS n FROM fx_agents GROUP BY doc_id) SELECT d.doc_id, CASE WHEN coalesce(a.n, 0) > 0 THEN 'partial_success' ELSE 'done' END AS status, (SELECT count(*) FROM m WHERE m.doc_id = d.doc_id) AS total, CAST(coalesce(a.n, 0) AS INTEGER) AS n_failed FROM fx_docs d LEFT JOIN a USING (doc_id)",
)
