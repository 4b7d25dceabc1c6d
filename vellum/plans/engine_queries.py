"""Queries of whole jobs and of file sources and sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators.ask import ask
from ..operators.fix import ALIGN, EDITS, edit_plan
from ..sources import docx
from ..sources.folder import put, registered
from ..sources.loaders import uploads
from ..operators import graph as G
from ..operators import links as L
from ..operators import parse as P
from ..operators import standards as N
from ..operators import vector_index as I
from ..operators import vectors as V
from ..sources.loaders import concatenated, pdf_texts
from ..sources.scratch import shared_dir, written
from ..streaming.incremental import bridges_now, event_counts, registry_now, registry_stream
from . import engine as E
from .checks_queries import _SENT_DOCS as SENTENCES
from .checks_queries import LEXICAL
from .corpus_queries import _ENT1, _ENT2
from .corpus_queries import STANDARD
from .corpus_queries import Q as _CORPUS
from .formatting_queries import ALL_ISSUES
from .formatting_queries import Q as _CHECKS
from .planted import ctes, files, of_files, over_lines, planted
from .sql import register

Q: dict = {}
CHUNKS, BLOCKS = _CORPUS["chunks_fixed"], _CORPUS["text_blocks"]


def _corpus(spark, d):
    fx = lambda n: planted(spark, d, "fx_" + n)
    return E.Corpus(
        fx("docs"), fx("sections"), fx("paragraphs"), fx("figures"), fx("tables"),
        {k: fx(k) for k in ("para_layout", "table_layout", "page_layout", "page_numbering", "formulas", "heading_layout")},
    )


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where("trim(text) <> ''")


Q["analyze"] = (lambda spark, d: E.analyze(_corpus(spark, d)).select("doc_id", "status", "total", "critical", "warning", "info"), None)
Q["analyze_documents"] = (
    lambda spark,
    d: E.analyze(E.parse_texts(_docs(spark, d).select("doc_id", "text"))).select("doc_id", "status", "total"), None,
)
Q["ingest_standard_edges"] = (
    # every document as a standard: its sections and rules, and what follows what
    lambda spark, d: E.ingest_standard(planted(spark, d, "fx_lines"))["edges"].where("type IN ('follows', 'contains', 'rule_follows')").select("standard_id", "source", "target", "type"),
    f"""WITH {STANDARD} SELECT standard_id, 'std_sec_' || (o - 2) AS source, 'std_sec_' || (o - 1) AS target, 'follows' AS type FROM blk WHERE kind = 'section' AND o > 1
    UNION ALL SELECT standard_id, 'std_sec_' || (h - 1), 'gost_rule_' || n, 'contains' FROM rul UNION ALL SELECT standard_id, 'gost_rule_' || n, 'gost_rule_' || nn, 'rule_follows' FROM (SELECT *, lead(n) OVER (PARTITION BY standard_id, h ORDER BY n) AS nn FROM rul) WHERE nn IS NOT NULL""",
)
Q["index_statistics"] = (
    lambda spark, d: E.index_statistics({k: v for k, v in E.build_index(_docs(spark, d), "doc_id").items() if k != "vectors"}),
    f"""WITH {_ENT1}, {_ENT2}, b AS (SELECT entity FROM e2 GROUP BY entity HAVING count(DISTINCT doc_id) BETWEEN 2 AND 10)
    SELECT 'entities' AS relation, (SELECT count(*) FROM e2) AS n UNION ALL SELECT 'registry', (SELECT count(DISTINCT entity) FROM e2) UNION ALL SELECT 'bridges', (SELECT count(*) FROM b) UNION ALL SELECT 'facts', (SELECT count(*) FROM b)""",
)
Q["corrected_files"] = (
    lambda spark,
    d: docx.read_facts(E.corrected_files(_corpus(spark, d), planted(spark, d, "fx_fixes"))).select("doc_id", "i", "text"),
    None,
)
Q["docx_round_trip"] = (
    # every document written as a file and read again
    lambda spark, d: docx.read_facts(docx.written(_lines(spark, d))).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.md5(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").cast("binary")
        ).alias("h"),
    ).select(F.col("doc_id").cast("long").alias("doc_id"), "n", "h"),
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY i)) AS h FROM l WHERE trim(t) <> '' GROUP BY doc_id",
)
Q["upload_dispatch"] = (
    lambda spark, d: uploads(
        _docs(spark, d).select(
            "doc_id",
            F.concat(
                F.lit("f"),
                F.element_at(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".xls")), (F.col("doc_id") % 3 + 1).cast("int")),
            ).alias("filename"),
            F.col("text").cast("binary").alias("content"),
        )
    ).select("doc_id", "source_format", F.length("text").alias("n"), "error"),
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' END AS source_format, CASE WHEN doc_id % 3 < 2 THEN length(trim(text, ' ')) END AS n, CASE WHEN doc_id % 3 = 2 THEN 'unsupported: .xls' END AS error FROM documents",
)
_FLAGGED = """SELECT doc_id, CASE WHEN (d + i) % 11 <> 3 THEN i END AS paragraph_index, CASE (d + i) % 6 WHEN 0 THEN 'figure_caption_not_centered' WHEN 1 THEN 'missing_formula_number' WHEN 2 THEN 'invalid_font_size' WHEN 3 THEN 'invalid_font_family' WHEN 4 THEN 'heading_trailing_period' ELSE 'unheard_of' END AS subtype FROM lines
    UNION ALL SELECT doc_id, i, 'invalid_font_family' FROM lines WHERE (d + i) % 6 = 2"""
_DRAWN = "SELECT doc_id, i AS paragraph_index FROM lines WHERE i % 7 = 0"
Q["edit_plan"] = (
    lambda spark, d: edit_plan(over_lines(spark, d, _FLAGGED), over_lines(spark, d, _DRAWN)).select("doc_id", "paragraph_index", "op", "arg", "step"),
    f"""WITH {ctes()}, f AS ({_FLAGGED}), e AS (SELECT DISTINCT doc_id, paragraph_index, CASE subtype WHEN 'figure_caption_not_centered' THEN 'align' WHEN 'missing_formula_number' THEN 'number_formula' WHEN 'heading_trailing_period' THEN 'strip_period' WHEN 'unheard_of' THEN NULL ELSE 'set_font' END AS op,
      CASE subtype WHEN 'figure_caption_not_centered' THEN 'center' END AS arg FROM f WHERE NOT EXISTS (SELECT 1 FROM ({_DRAWN}) x WHERE x.doc_id = f.doc_id AND x.paragraph_index = f.paragraph_index))
    SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index DESC NULLS LAST, op, arg NULLS FIRST) AS INTEGER) AS step FROM e WHERE op IS NOT NULL""",
)
Q["event_windows"] = (
    lambda spark, d: event_counts(spark.read.parquet(f"{d}/events.parquet")).select(
        "event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n",
    ),
    "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL",
)


def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"


def _stored(spark, d):
    root = _folder(spark, "standards")
    stages = ("parsed", "rules")
    E.save_standard({k: v for k, v in E.ingest_standard(planted(spark, d, "fx_lines")).items() if k in stages}, root)
    return E.load_standard(spark, root, stages=stages)


Q["standard_stored"] = (
    lambda spark, d: _stored(spark, d)["rules"].select("standard_id", "rule_id", "number", "object_type"),
    f"WITH {STANDARD} SELECT standard_id, 'gost_rule_' || n AS rule_id, h || '.' || i AS number, 'figure' AS object_type FROM rul",
)
Q["standard_registry"] = (
    lambda spark, d: N.registry(_docs(spark, d).select(F.concat(F.lit("Norm "), F.substring(F.coalesce("text", F.lit("")), 1, 12)).alias("name"))),
    r"""WITH n AS (SELECT 'Norm ' || substr(coalesce(text, ''), 1, 12) AS name FROM documents)
    SELECT 'gost_7_32_2017' AS standard_id, 'GOST 7.32-2017' AS name UNION ALL SELECT trim(regexp_replace(regexp_replace(strip_accents(lower(name)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_') AS standard_id, min(name) FROM n GROUP BY 1""",
)


def _collected(spark, d):
    """A collection that is added to twice: the second time half of the rows are there already."""
    path = _folder(spark, "collection")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("entity_id"), F.concat(F.lit("t"), "vec_id").alias("text"), "embedding",
    )
    V.grown(rows.where("cast(entity_id as long) % 2 = 0"), "c", path)
    return V.grown(rows, "c", path)


Q["vector_collection_grown"] = (lambda spark, d: _collected(spark, d).select("id"), "SELECT 'c:' || vec_id AS id FROM embeddings")


def _indexed(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def _index_search(spark, d, exact):
    """As many lists for each query as a sample needs; exact reads the others that could change the result as well."""
    rows, queries = _indexed(spark, d)
    index = I.build(rows, _folder(spark, "index"))
    probes = None if exact else I.probes_for(index, spark, 5)
    return I.search(index, queries, 5, probes, exact, 6).select("query_id", "id", "rank")


def _index_upserted(spark, d):
    """An index over two thirds of the rows, then all even rows put in with their vectors reversed; searched for the first vectors."""
    rows, queries = _indexed(spark, d)
    index = I.build(rows.where("id % 3 <> 0"), _folder(spark, "index"))
    index = I.upsert(index, rows.where("id % 2 = 0").withColumn("embedding", F.reverse("embedding")))
    return I.search(index, queries, 5, exact=True, decimals=6).select("query_id", "id", "rank")


def _nearest_sql(held: str) -> str:
    return f"""WITH held AS ({held}), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS c FROM embeddings q, held v WHERE q.vec_id % 50 = 0)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""


Q["vector_index_exact"] = (lambda spark, d: _index_search(spark, d, True), _nearest_sql("SELECT vec_id, embedding FROM embeddings"))
# what is found is ranked by exact similarity; the recall is tested against brute force
Q["vector_index_probed"] = (lambda spark, d: _index_search(spark, d, False), None)
Q["vector_index_upserted"] = (
    _index_upserted,
    _nearest_sql("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0"),
)


def _page_edges(spark, d):
    """Pages and the addresses they link to, in both directions."""
    e = L.page_links(spark.read.parquet(f"{d}/pages.parquet")).select(F.concat(F.lit("p"), "page_id").alias("source"), "target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))


def _page_hops(spark, d):
    """Every page and the first page of its host: how many links lie between them, six at most."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", host.alias("host"))
    pairs = pages.join(pages.groupBy("host").agg(F.min("page_id").alias("first")), "host")
    name = lambda c: F.concat(F.lit("p"), c)
    return G.hops_between(_page_edges(spark, d), pairs.select(name("first").alias("source"), name("page_id").alias("target")), 6, 50)


# every link of the pages is a path from the root
_PAGE_LINKS = r"""host AS (SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, html FROM pages),
    link AS (SELECT DISTINCT page_id, host, scheme || '://' || host || regexp_replace(replace(href, '&amp;', '&'), '#.*', '') AS target FROM (SELECT page_id, host, scheme, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM host))"""
Q["page_links"] = (
    lambda spark, d: L.page_links(spark.read.parquet(f"{d}/pages.parquet")).select("page_id", "target"),
    f"WITH {_PAGE_LINKS} SELECT page_id, target FROM link",
)
Q["page_shared_links"] = (
    # links of a page, and how many of them other pages have too; a link of many pages is counted once, never paired
    lambda spark, d: (lambda e: e.join(e.groupBy("target").agg(F.count(F.lit(1)).alias("pages")), "target").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("pages") > 1).alias("n_shared")))(L.page_links(spark.read.parquet(f"{d}/pages.parquet")).select("page_id", "target")),
    f"WITH {_PAGE_LINKS} SELECT page_id, count(*) AS n_links, count(*) FILTER (EXISTS (SELECT 1 FROM link o WHERE o.target = link.target AND o.page_id <> link.page_id)) AS n_shared FROM link GROUP BY page_id",
)
Q["page_hops"] = (
    _page_hops,
    f"""WITH RECURSIVE {_PAGE_LINKS}, near AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM link a JOIN link b ON a.target = b.target),
    first AS (SELECT host, min(page_id) AS first FROM host GROUP BY host),
    walk AS (SELECT first, first AS id, 0 AS hops FROM first UNION SELECT w.first, n.b, w.hops + 2 FROM walk w JOIN near n ON n.a = w.id WHERE w.hops < 6)
    SELECT 'p' || first AS source, 'p' || id AS target, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY first, id""",
)


def _pages(content: bytes) -> list[str]:
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    return content.decode().split("|")[1:]


Q["pdf_texts"] = (
    # pages as files that the first extractor reads, that only the second reads, and that none reads
    lambda spark, d: pdf_texts(
        spark.read.parquet(f"{d}/pages.parquet").select(
            "page_id",
            F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF|"), F.translate("html", "|", "/"), F.lit("| |two"))).when(F.col("page_id") % 3 == 1, F.col("html")).otherwise(F.lit("%PDF")).cast("binary").alias("content"),
        ),
        _pages, lambda c: c.decode() if not c.startswith(b"%") else "",
    ).select("page_id", F.md5(F.col("text").cast("binary")).alias("h"), F.col("error").isNotNull().alias("failed")),
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN md5(translate(html, '|', '/') || chr(10) || chr(10) || 'two') WHEN 1 THEN md5(html) END AS h, page_id % 3 = 2 AS failed FROM pages",
)
_STYLED = """SELECT doc_id, i AS ord, CASE WHEN role = 'heading' THEN CASE o % 3 WHEN 0 THEN 'Заголовок 2' ELSE 'Heading 1' END WHEN i % 4 = 0 THEN 'Normal' END AS style,
    CASE role WHEN 'heading' THEN CASE o % 4 WHEN 0 THEN 'Без номера' WHEN 1 THEN ' ' ELSE concat(o, '.', d % 9, ' Метод') END ELSE CASE i % 5 WHEN 0 THEN 'Введение' ELSE concat('Строка: ', text) END END AS text FROM lines"""
Q["word_headings"] = (
    lambda spark, d: P.word_headings(over_lines(spark, d, _STYLED)),
    f"""WITH {ctes()}, p AS ({_STYLED}), h AS (SELECT *, style IS NOT NULL AND style <> 'Normal' OR text = 'Введение' AS head, text NOT IN ('Введение', 'Без номера') AS numbered FROM p WHERE trim(text) <> '')
    SELECT doc_id, ord, CASE WHEN numbered THEN 'sec_' || replace(regexp_extract(text, '^[0-9.]+'), '.', '_') ELSE 'sec_auto_' || sum(CAST(NOT numbered AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord) END AS section_id, text AS title FROM h WHERE head""",
)
Q["document_titles"] = (
    lambda spark, d: P.document_title(
        _docs(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.concat(F.lit("a/b/Отчет "), F.col("doc_id") % 5, F.lit("--"), "lang", F.lit(".docx")).alias("filename")), planted(spark, d, "fx_sections"),
    ),
    f"""WITH {ctes("fx_sections")}, t AS (SELECT doc_id, first(title ORDER BY ord) AS t FROM fx_sections WHERE trim(title) <> '' GROUP BY doc_id)
    SELECT 'd' || d.doc_id AS doc_id, coalesce(t, 'Отчет ' || d.doc_id % 5 || '--' || lang) AS title, 'отчет_' || d.doc_id % 5 || '_' || lang AS document_id FROM documents d LEFT JOIN t ON t.doc_id = 'd' || d.doc_id""",
)
Q["documents_concatenated"] = (
    lambda spark, d: concatenated(
        _docs(spark, d).select("doc_id", "text", "source"), "source",
    ).select("source", F.md5(F.col("text").cast("binary")).alias("h")),
    "SELECT source, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id, text)) AS h FROM documents GROUP BY source",
)


# --- files with layouts ----------------------------------------------------------------------------------------------

def _read(spark, d):
    return E.read_files(files(spark, d))


Q["docx_corpus_issues"] = (
    # all documents written as files with planted faults, read back and checked: every fault is counted
    lambda spark, d: E.checked_files(files(spark, d))[1].groupBy("doc_id", "subtype").agg(F.count(F.lit(1)).alias("n")),
    of_files(_CHECKS["formatting_issues"][1]),
)
Q["docx_corpus_sections"] = (
    lambda spark, d: _read(spark, d).sections.select("doc_id", "ord", "section_id", "number", "title", "level", F.md5(F.col("text").cast("binary")).alias("h")),
    of_files(f"WITH {ctes('fx_sections')} SELECT doc_id, ord, section_id, number, title, level, md5(text) AS h FROM fx_sections"),
)
_RELATIONS = {
    "paragraphs": ["ord", "paragraph_id", "section_id", "paragraph_index"], "figures": ["ord", "caption", "paragraph_index"], "tables": ["ord", "caption", "paragraph_index"],
    "para_layout": ["paragraph_index", "alignment", "first_line_indent_mm", "line_spacing", "font_size_pt_min", "font_family", "has_bold_text", "has_non_black_text"],
    "table_layout": ["table_index", "caption_paragraph_index", "caption_position", "header_text", "header_alignment", "appendix_letter"],
    "page_layout": ["section_index", "page_width_mm", "page_height_mm", "left_margin_mm", "right_margin_mm", "top_margin_mm", "bottom_margin_mm"],
    "page_numbering": ["section_index", "different_first_page", "footer_field", "footer_alignment", "header_field", "first_footer_field", "page_number_start"],
    "formulas": ["ord", "paragraph_index", "text", "alignment", "is_standalone", "equation_number", "raw_equation_number", "next_text"],
}
for _name, _columns in _RELATIONS.items():
    Q[f"docx_corpus_{_name}"] = (
        lambda spark, d, n=_name, cols=_columns: (lambda c: getattr(c, n, None) or c.more[n])(_read(spark, d)).select("doc_id", *cols),
        of_files(f"WITH {ctes('fx_' + _name)} SELECT doc_id, {', '.join(_columns)} FROM fx_{_name}"),
    )


def _faults(c, issues):
    """Issues that an edit answers, with the text at their place."""
    said = c.more["para_layout"].select("doc_id", "paragraph_index", "text")
    i = issues.where(F.col("subtype").isin(*_MENDED))
    return i.join(said, ["doc_id", "paragraph_index"], "left").select("doc_id", "subtype", F.coalesce("text", F.lit("")).alias("text"))


#: Edits that leave the numbering of all formulas as it is or mend it.
_MENDED = [k for k in {**EDITS, **ALIGN} if k not in ("formula_not_standalone", "table_caption_below_table")]


def _mended(spark, d):
    # the files are read and checked once for their faults and their edits; the edited ones are read as they are made
    before = files(spark, d)
    checked = E.checked_files(before)
    faults = written(_faults(*checked), "faults")
    after, _ = E.fixed_files(before, checked)
    left = _faults(*E.checked_files(after)).distinct().withColumn("left", F.lit(1))
    found = faults.join(left, ["doc_id", "subtype", "text"], "left")
    return found.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("left"), F.lit(0)).alias("n_left"))


Q["docx_corpus_fixed"] = (
    # all files edited by what their issues ask for, read again: none of the mended faults is left at its place
    _mended,
    f"SELECT subtype, count(*) AS n, 0 AS n_left FROM ({of_files(ALL_ISSUES)}) WHERE subtype IN ({', '.join(map(repr, _MENDED))}) GROUP BY subtype",
)


# --- mixed folders and streams ---------------------------------------------------------------------------------------

def _mixed(spark, d):
    """All documents as .txt, .md and .docx files and all pages as .html, below one folder."""
    root = _folder(spark, "mixed")
    at = lambda s: F.concat(F.lit("part"), F.col("doc_id") % 7, F.lit("/"), F.col("doc_id"), F.lit(s))
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.where("doc_id % 3 <> 2").select(F.when(F.col("doc_id") % 3 == 0, at(".txt")).otherwise(at(".md")).alias("path"), F.col("text").cast("binary").alias("content"))
    word = docx.written(_lines(spark, d).where("doc_id % 3 = 2")).select(at(".docx").alias("path"), "content")
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    put(plain.unionByName(word).unionByName(pages), root).write.format("noop").mode("overwrite").save()
    return root


def _mixed_read(spark, d):
    read = registered(spark).read.format("mixed_folder").load(_mixed(spark, d)).where("suffix IN ('.txt', '.md', '.docx')")
    stem = F.regexp_extract("path", r"/(\d+)\.[a-z]+$", 1).cast("long")
    return read.select(stem.alias("doc_id"), "suffix", F.md5(F.col("text").cast("binary")).alias("h"), F.col("error").isNotNull().alias("failed"))


Q["mixed_folder_read"] = (
    _mixed_read,
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 3 = 2),
    w AS (SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY i)) AS h FROM l WHERE trim(t) <> '' GROUP BY doc_id)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.txt' ELSE '.md' END AS suffix, md5(coalesce(text, '')) AS h, false AS failed FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, '.docx', h, false FROM w""",
)


def _streamed(spark, d):
    """Documents in three folders, of which the third repeats a third of the first; a micro-batch takes as many files as the first folder has."""
    root = _folder(spark, "stream")
    for n, some in enumerate(("doc_id % 2 = 0", "doc_id % 2 = 1", "doc_id % 6 = 0")):
        _docs(spark, d).select("doc_id", "text").where(some).write.parquet(f"{root}/in/{n}")
    files = len(spark.read.parquet(f"{root}/in/0").inputFiles())
    s = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max(1, files)).parquet(f"{root}/in")
    registry_stream(s, "doc_id", f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/events")


def _registry_streamed(spark, d):
    e = _streamed(spark, d)
    return registry_now(e).join(bridges_now(e).select("entity", F.lit(True).alias("bridge")), "entity", "left").select("entity", "df", F.coalesce("bridge", F.lit(False)).alias("bridge"))


Q["registry_streamed"] = (
    _registry_streamed,
    f"WITH {_ENT1}, {_ENT2} SELECT entity, count(DISTINCT doc_id) AS df, count(DISTINCT doc_id) BETWEEN 2 AND 10 AS bridge FROM e2 GROUP BY entity",
)


# --- failures and providers ------------------------------------------------------------------------------------------

def _poisoned(spark, d):
    c = E.Corpus(*(planted(spark, d, "fx_" + n) for n in ("docs", "sections", "paragraphs", "figures", "tables")))
    bad = F.pmod(F.substring("doc_id", 2, 20).cast("long"), F.lit(400)) == 7
    c.paragraphs = c.paragraphs.withColumn("text", F.when(bad, F.raise_error(F.lit("poisoned"))).otherwise(F.col("text")))
    issues, agents = E.run_agents(c, ("style_agent",))
    n = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return agents.join(n, "doc_id", "left").select("doc_id", F.col("error").isNotNull().alias("failed"), F.coalesce("n", F.lit(0)).alias("n"))


Q["documents_quarantined"] = (
    # documents with a paragraph that no check can read fail alone
    _poisoned,
    f"""WITH {LEXICAL}, bad AS (SELECT DISTINCT doc_id FROM fx_paragraphs WHERE CAST(substr(doc_id, 2) AS BIGINT) % 400 = 7), n AS (SELECT doc_id, count(*) AS n FROM lexical GROUP BY doc_id)
    SELECT 'd' || d.doc_id AS doc_id, bad.doc_id IS NOT NULL AS failed, CASE WHEN bad.doc_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS n FROM documents d LEFT JOIN bad ON bad.doc_id = 'd' || d.doc_id LEFT JOIN n ON n.doc_id = 'd' || d.doc_id""",
)


def told(prompt: str) -> str:
    """Stands for a model: an answer that follows from the prompt, and some prompts that it refuses."""
    if len(prompt) % 7 == 0:
        raise ValueError("refused")
    return hashlib.md5(prompt.encode()).hexdigest()


def _answers(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("prompt"))
    path = _folder(spark, "answers")
    ask(turns.where("conv_id % 2 = 0"), told, path).write.format("noop").mode("overwrite").save()
    return ask(turns, told, path).select("conv_id", "turn", "response", "error")


Q["conversation_answers"] = (
    _answers,
    "SELECT conv_id, turn, CASE WHEN length(text) % 7 <> 0 THEN md5(text) END AS response, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: refused' END AS error FROM conversations",
)


# --- SQL -------------------------------------------------------------------------------------------------------------

def _by_sql(spark, d, sql):
    return register(spark).sql(sql, documents=_docs(spark, d))


Q["sql_sentences"] = (
    lambda spark, d: _by_sql(spark, d, "SELECT d.doc_id, s.ord, md5(CAST(s.sentence AS BINARY)) AS h FROM {documents} d, LATERAL vellum_sentences(d.text) s WHERE length(s.sentence) > 20"),
    f"WITH {SENTENCES} SELECT doc_id, sentence_ord AS ord, md5(t) AS h FROM x WHERE length(t) > 20",
)
Q["sql_chunks"] = (
    lambda spark, d: _by_sql(spark, d, "SELECT d.doc_id, c.chunk, md5(CAST(c.piece AS BINARY)) AS h FROM {documents} d, LATERAL vellum_chunks(d.text, 800, 100) c"),
    CHUNKS[1],
)
Q["sql_blocks"] = (
    # blocks of a line each, counted by SQL over the function
    lambda spark, d: _by_sql(spark, d, "SELECT d.doc_id, count(*) AS n_blocks, sum(length(b.text)) AS n_chars FROM {documents} d, LATERAL vellum_blocks(replace(d.text, chr(10), concat(chr(10), chr(10)))) b GROUP BY d.doc_id"),
    BLOCKS[1],
)
