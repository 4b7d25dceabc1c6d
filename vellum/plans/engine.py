"""The whole jobs: analyse documents, ingest a standard, build and ask an index, correct documents.

Each is one lazy plan over many documents; the only Python workers are those that read or write files and embed text.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import assemble, fix, formatting, graph, parse, report, retrieve, standards, structure, style, vectors
from ..operators.ask import ask as ask_provider
from ..sources import docx
from ..sources.scratch import discard, made, shuffles_removed, written

ISSUES = [
    "doc_id", "ord", "issue_id", "type", "subtype", "severity", "message", "section_id", "paragraph_id",
    "paragraph_index", "page", "evidence", "rule_id", "quote", "suggestion", "agent",
]
KINDS = {"ord": "int", "paragraph_index": "int", "page": "int"}


def as_issues(df: DataFrame, kind: str, agent: str) -> DataFrame:
    """Any check's rows in the columns that merging and reporting use."""
    if "item_ord" in df.columns:
        df = df.withColumnRenamed("item_ord", "ord")
    own = F.concat(F.lit(kind + "_"), "subtype")
    rule = F.coalesce("rule_id", own) if "rule_id" in df.columns else own
    df = df.withColumn("type", F.lit(kind)).withColumn("agent", F.lit(agent)).withColumn("message", F.col("subtype")).withColumn("rule_id", rule)
    return df.select(
        *(
            F.col(c).cast(KINDS.get(c, "string")).alias(c) if c in df.columns else F.lit(None).cast(KINDS.get(c, "string")).alias(c) for c in ISSUES
        )
    )


@dataclass
class Corpus:
    """The relations of a set of documents; layout relations may be missing.

    With rules (of one or more standards) docs have a standard_id, and formatting issues name the rules they break.
    """

    docs: DataFrame
    sections: DataFrame
    paragraphs: DataFrame
    figures: DataFrame
    tables: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)
    rules: DataFrame | None = None


def parse_texts(raw: DataFrame) -> Corpus:
    """Raw (doc_id, text) as a corpus."""
    d = parse.document(raw)
    blank = F.lit(None).cast("int").alias("page")
    return Corpus(
        raw.select("doc_id").distinct(), d["sections"], d["paragraphs"].select("*", blank),
        d["figures"].select("*", blank), d["tables"].select("*", blank),
    )


def read_files(files: DataFrame) -> Corpus:
    """DOCX files (doc_id, content) as a corpus with all its layouts; facts are written once, since every relation reads them.

    A file that can't be read stays in docs, with its error, and has no rows elsewhere.
    """
    c = assemble.corpus(written(docx.read_facts(files), "facts"))
    names = ("docs", "sections", "paragraphs", "figures", "tables")
    return Corpus(*(c[n] for n in names), more={k: v for k, v in c.items() if k not in names})


def analyze_files(files: DataFrame) -> DataFrame:
    """One report row for each DOCX file (doc_id, content), which all checks of structure, formatting and style have seen."""
    return analyze(read_files(files))


def _relations(c: Corpus) -> list[DataFrame]:
    """What the formatting checks read, with whatever layouts the corpus has."""
    more = [c.more[k] if k in c.more else formatting.no_layout(c.docs, k) for k in formatting.LAYOUT]
    return [c.docs, c.sections, c.paragraphs, c.figures, c.tables, *more]


def formatting_issues(c: Corpus) -> DataFrame:
    """Issues of every formatting check."""
    return formatting.check_formatting(*_relations(c), rules=c.rules)


#: Checks whose shuffle files are on disk together.
TOGETHER = 6


def checked_files(files: DataFrame) -> tuple[Corpus, DataFrame]:
    """(DOCX files as a corpus, its formatting issues): every relation and what some checks find are written once.

    What the relations were made from goes before they are checked, and shuffle files go with each of these jobs: what is on
    disk at once is the relations and one job's shuffles.
    """
    spark = files.sparkSession
    with shuffles_removed(spark):
        first = made()
        c = read_files(files)
        stop = made()
        c = _settled(c, every=True)
        discard(spark, first, stop)
        parts = formatting.every_check(*_relations(c))
        some = [parts[n : n + TOGETHER] for n in range(0, len(parts), TOGETHER)]
        found = [written(formatting.all_of(x, c.docs, c.rules), "issues") for x in some]
    return c, reduce(DataFrame.unionByName, found)


def fixed_files(files: DataFrame, checked: tuple[Corpus, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files after the edits that their issues ask for, the edits): reading, checking, planning and editing in one job.

    checked: what checked_files() says of these files, where that is known.
    """
    c, issues = checked or checked_files(files)
    drawn = c.figures.where("caption = ''").select("doc_id", "paragraph_index")
    plan = written(fix.edits_of(issues, c.more["para_layout"], c.more["formulas"], drawn), "edits")
    return docx.edited(files, plan), plan


#: Relations of a corpus without layouts; an agent reads docs, sections and paragraphs, or all.
READ = ("docs", "sections", "paragraphs", "figures", "tables")
AGENTS = ("structure_agent", "rag_agent", "style_agent", "logic_agent")


#: Failed runs of an agent after which the parts that aren't settled yet fail as a whole.
SPLITS = 200


def _part(c: Corpus, bits: int, value: int) -> Corpus:
    """The documents of one of 2 ** bits buckets."""
    def own(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) == value) if bits else df

    return Corpus(
        *(own(df) for df in (c.docs, c.sections, c.paragraphs, c.figures, c.tables)), more={k: own(df) for k, df in c.more.items()}, rules=c.rules,
    )


#: Relations that several checks read.
OFTEN = ("sections", "paragraphs", "figures", "tables", "para_layout", "formulas", "heading_layout")


def _settled(c: Corpus, every: bool = False) -> Corpus:
    """The corpus with the relations written that many checks read, or every relation: each is worked out once, and their plan stays small for the driver."""
    own = {k: written(getattr(c, k), k) if every or k in OFTEN else getattr(c, k) for k in ("docs", "sections", "paragraphs", "figures", "tables")}
    return Corpus(**own, more={k: written(df, k) if every or k in OFTEN else df for k, df in c.more.items()}, rules=c.rules)


def quarantined(c: Corpus, run, name: str, splits: int = SPLITS) -> tuple[list[DataFrame], list[tuple[int, int, str]]]:
    """(written results of run(corpus) for parts of the documents, (bits, value, error) of the parts that failed).

    All documents are tried at once. Where that fails, each half of the buckets is tried alone, and so on down to single documents:
    a document that can't be checked costs its own issues and about 2 log2(n) runs. Errors in a plan itself are raised.
    """
    done, failed, open_, broken = [], [], [(0, 0)], 0
    while open_:
        bits, value = open_.pop()
        part = _part(c, bits, value)
        try:
            done.append(written(run(part), name))
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError) as why:
            broken += 1
            if broken >= splits or bits >= 60 or bits and len(part.docs.select("doc_id").distinct().limit(2).collect()) < 2:
                known = "" if broken < splits else f"one of several documents after {splits} failed runs: "
                failed.append((bits, value, known + str(why).split("\n")[0]))
            else:
                open_ += [(bits + 1, value), (bits + 1, value + (1 << bits))]
    return done, failed


def _tried(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(df, (doc_id, error) of documents with a value that can't be worked out): one pass over df, whose failing values are null.

    try_to_binary is null where its argument fails. It reads 00 for a null, 01 and its text for another value; nested values and times are read as they are.
    """
    plain = (T.StringType, T.BooleanType, T.NumericType, T.DateType)
    kinds = {f.name: f.dataType for f in df.schema if f.name != "doc_id" and isinstance(f.dataType, plain)}
    own = lambda c: "`" + c.replace("`", "``") + "`"
    x = written(
        df.select(*(F.expr(f"try_to_binary(coalesce(concat('01', hex(cast({own(c)} as string))), '00'), 'hex')").alias(c) if c in kinds else F.col(own(c)) for c in df.columns)), name,
    )
    said = F.concat_ws(", ", *(F.when(F.col(own(c)).isNull(), F.lit(c)) for c in kinds))
    bad = x.where(said != "").groupBy("doc_id").agg(F.concat(F.lit(f"{name} can't be read: "), F.min(said)).alias("error"))
    values = (F.expr(f"CASE WHEN {own(c)} <> X'00' THEN cast(substring({own(c)}, 2) as string) END").cast(kinds[c]).alias(c) if c in kinds else F.col(own(c)) for c in df.columns)
    return x.select(*values), bad


def readable(c: Corpus, reads: tuple[str, ...]) -> tuple[Corpus, DataFrame]:
    """(the corpus without documents that can't be read, the (doc_id, error) of those): its relations named by reads are read and written once."""
    tried = {n: _tried(c.more[n] if n in c.more else getattr(c, n), n) for n in reads}
    bad = written(reduce(DataFrame.unionByName, (b for _, b in tried.values())).groupBy("doc_id").agg(F.min("error").alias("error")), "unread")

    def left(n: str, df: DataFrame) -> DataFrame:
        df, no = (tried[n][0] if n in tried else df).alias("own"), bad.alias("no")
        return df.join(no, F.col("own.doc_id").eqNullSafe(F.col("no.doc_id")), "left_anti")

    own = {n: left(n, getattr(c, n)) for n in ("docs", "sections", "paragraphs", "figures", "tables")}
    return Corpus(**own, more={n: left(n, df) for n, df in c.more.items()}, rules=c.rules), bad


def isolated(c: Corpus, run, name: str, reads: tuple[str, ...]) -> tuple[list[DataFrame], list[tuple[int, int, str]], DataFrame | None]:
    """quarantined(), and the (doc_id, error) of documents that can't be read.

    Where a run over all documents fails, those with a value that can't be read in the relations named by reads are found in one pass,
    whatever their number; the others are run again, and only a failure in a check itself is searched for by halves.
    """
    spark = c.docs.sparkSession
    with shuffles_removed(spark):
        try:
            return [written(run(c), name)], [], None
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError):
            pass
        first, bad = made(), None
        try:
            c, bad = readable(c, reads)
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError):
            pass  # what fails below a shuffle fails for the whole relation
        # the table of bad documents is the last one and stays
        stop = made() - (bad is not None)
        done, failed = quarantined(c, run, name)
        discard(spark, first, stop)
        return done, failed, bad


def run_agents(c: Corpus, agents: tuple[str, ...] = AGENTS) -> tuple[DataFrame, DataFrame]:
    """(issues, agent_status): every agent in order; a document that an agent fails on has that agent's error, all others its issues.

    Each agent's issues are written to the shared folder, so a failure stays with its agent and document, and plans stay small.
    """
    def structure_issues(c: Corpus):
        return as_issues(structure.check_structure(c.docs, c.sections, c.paragraphs), "structure", "structure_agent")

    def rag_issues(c: Corpus):
        return as_issues(formatting_issues(_settled(c)), "formatting", "rag_agent")

    def style_issues(c: Corpus):
        return as_issues(style.check_style(c.sections, c.paragraphs), "style", "style_agent")

    def logic_issues(c: Corpus):
        return as_issues(style.check_logic(c.docs), "logic", "logic_agent")

    out, status, unread = None, [], []
    for rank, (agent, run) in enumerate(zip(AGENTS, (structure_issues, rag_issues, style_issues, logic_issues), strict=True)):
        if agent not in agents:
            continue
        reads = {"style_agent": READ[1:3], "logic_agent": READ[:1], "structure_agent": READ[:3]}.get(agent, (*READ, *c.more))
        done, failed, bad = isolated(c, lambda part, r=run, k=rank: r(part).withColumn("ord", F.coalesce("ord", F.lit(0)) + k * 100_000_000), agent, reads)
        if bad is not None:
            unread.append(bad.select("doc_id", F.lit(agent).alias("agent"), F.col("error").alias("unread")))
        error = F.lit(None).cast("string")
        for bits, value, why in failed:
            error = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) == value, why).otherwise(error)
        status.append(F.struct(F.lit(agent).alias("agent"), error.alias("error")))
        for got in done:
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = as_issues(style.check_logic(c.docs), "logic", "logic_agent").where(F.lit(False))
    told = c.docs.select("doc_id", F.explode(F.array(*status)).alias("s")).select("doc_id", "s.agent", "s.error")
    if unread:
        a, b = told.alias("a"), reduce(DataFrame.unionByName, unread).alias("b")
        told = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.agent") == F.col("b.agent")), "left").select("a.doc_id", "a.agent", F.coalesce("b.unread", "a.error").alias("error"))
    return out, told


def model_issues(c: Corpus, provider, path: str, **options) -> DataFrame:
    """Style issues by a model: each document's units are shown to it once, answers kept at path; see operators.ask."""
    shown = style.chat_prompts(style.text_units(c.sections, c.paragraphs)).select("doc_id", "prompt")
    answers = ask_provider(shown, provider, path, **options).where("response IS NOT NULL").select("doc_id", "response")
    return style.chat_issues(answers, c.paragraphs)


def analyze(c: Corpus, known_standards: list[str] | None = None) -> DataFrame:
    """One report row for each document; a standard that isn't known is an error before any work."""
    if known_standards is not None and "standard_id" in c.docs.columns:
        odd = c.docs.where(~F.col("standard_id").isin(known_standards)).limit(1).count()
        if odd:
            raise FileNotFoundError("a document names an unknown standard")
    issues, agents = run_agents(c)
    return report.report(c.docs, report.merged(issues).drop("position"), agents)


def ingest_standard(lines: DataFrame) -> dict[str, DataFrame]:
    """(standard_id, pos, line) to clean blocks, parsed blocks, rules and the graph.

    Clean and parsed blocks are written once, for all that follows reads them.
    """
    b = written(standards.clean_blocks(lines), "blocks")
    p = written(standards.parse_blocks(b), "parsed")
    r = standards.rules(p)
    s = standards.sections(p)
    e = graph.follows(s).unionByName(graph.membership(r)).unionByName(graph.rule_chains(r)).unionByName(graph.links(r)).unionByName(graph.prerequisites(r))
    return {"blocks": b, "parsed": p, "rules": r, "nodes": graph.nodes(r, s), "edges": e}


def build_index(
    texts: DataFrame, key: str, config: retrieve.Config = retrieve.Config(), provider=vectors.hash_embedding,
) -> dict[str, DataFrame]:
    """Vectors, the entity registry, bridge entities and what a model is asked about each."""
    e = retrieve.entities(texts, key)
    reg = retrieve.registry(e, key)
    b = retrieve.bridge_entities(reg, config)
    return {
        "vectors": vectors.embedded(texts, key, provider), "entities": e, "registry": reg, "bridges": b,
        "facts": retrieve.bridge_facts(retrieve.bridge_candidates(b, e, key, config), texts, key),
    }


STAGES = ("blocks", "parsed", "rules", "nodes", "edges")


def save_standard(artifacts: dict[str, DataFrame], root: str) -> None:
    """The artifacts of ingest_standard() as Parquet below root, for load_standard(): they replace what is there of their standards.

    A save is a folder of each stage, whatever number of standards it has, its rows in the order of standards within a file.
    root/standards says which stages of which standards a save holds; it is written last, so a save that failed doesn't count.
    """
    spark = next(iter(artifacts.values())).sparkSession
    save = uuid.uuid4().hex
    for stage, df in artifacts.items():
        df.sortWithinPartitions("standard_id").write.parquet(f"{root}/{stage}/save={save}")
    every = [spark.read.parquet(f"{root}/{stage}/save={save}").select("standard_id") for stage in artifacts]
    at = F.lit(time.time_ns()).alias("at")
    names = reduce(DataFrame.unionByName, every).distinct().select("standard_id", at, F.explode(F.array(*map(F.lit, artifacts))).alias("stage"))
    names.withColumn("save", F.lit(save)).write.partitionBy("stage", "save").mode("append").parquet(f"{root}/standards")


def load_standard(spark, root: str, standard_id: str | None = None, stages: tuple[str, ...] = STAGES) -> dict[str, DataFrame]:
    """What save_standard() wrote last of one standard or of all; one that isn't there is an error. stages: those that are wanted."""
    names = spark.read.parquet(f"{root}/standards")
    one = F.lit(True) if standard_id is None else F.col("standard_id") == standard_id
    if standard_id is not None and not names.where(one).head(1):
        raise FileNotFoundError(f"no parsed standard {standard_id}")
    out = {}
    for stage in stages:
        mine = names.where(F.col("stage") == stage)
        saves = [r.save for r in mine.select("save").distinct().collect()]
        if not saves:
            raise FileNotFoundError(f"no {stage} below {root}")
        df = spark.read.option("basePath", f"{root}/{stage}").parquet(*(f"{root}/{stage}/save={s}" for s in saves)).where(one)
        if len(saves) > 1:
            last = mine.where(one).groupBy("standard_id").agg(F.max_by("save", "at").alias("save"))
            df = df.join(last, ["standard_id", "save"], "left_semi")
        out[stage] = df.drop("save")
    return out


def ask(
    queries: DataFrame, vecs: DataFrame, nodes: DataFrame, edges: DataFrame,
    config: retrieve.Config = retrieve.Config(), provider=vectors.hash_embedding,
) -> DataFrame:
    """Context rows for a batch of (query_id, query): vector search, then weighted expansion."""
    q = vectors.embedded(queries.select("query_id", F.col("query").alias("text")), "query_id", provider)
    hits = vectors.top_k(q, vecs, config.k)
    return retrieve.retrieve(queries, hits, nodes, edges, config)


def ask_bridged(
    queries: DataFrame, vecs: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame,
    config: retrieve.Config = retrieve.Config(), provider=vectors.hash_embedding,
) -> dict[str, DataFrame]:
    """What a model is asked for each question, and the sources of the answer: one pass over nodes, facts and bridging facts.

    vecs: (id, embedding, entry_type) of nodes and facts; facts: (id, entity, content, entry_type, sources).
    """
    q = vectors.embedded(queries.select("query_id", F.col("query").alias("text")), "query_id", provider)
    hits = vectors.top_k(q, vecs, 2 * config.k).join(vecs.select("id", "entry_type"), "id")
    items = retrieve.context_items(retrieve.retrieve_bridged(queries, hits, nodes, edges, config), nodes, facts)
    items = written(items, "context")
    return {
        "items": items, "prompts": retrieve.prompts(queries, retrieve.context_text(items, config.context_items)),
        "sources": retrieve.answer_sources(items), "bridges": retrieve.bridge_sources(items),
    }


def index_statistics(index: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in index.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def corrected(c: Corpus, fixes: DataFrame, issues: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs) after text fixes, renumbering, heading fixes and, with issues, what they ask to add."""
    text = fix.apply_replacements(c.paragraphs.select("doc_id", F.col("paragraph_id").alias("target"), "text"), fixes)
    p = c.paragraphs.drop("text").join(
        text.withColumnRenamed("target", "paragraph_id"), ["doc_id", "paragraph_id"],
    ).select(c.paragraphs.columns)
    h = fix.fixed_headings(c.sections).select("doc_id", "section_id", "title")
    n = fix.renumbered(c.sections).select("doc_id", "section_id", "number", "level")
    s = c.sections.drop("title", "number", "level").join(h, ["doc_id", "section_id"]).join(n, ["doc_id", "section_id"]).select(c.sections.columns)
    return (s, p) if issues is None else fix.completed(issues, s, p)


def corrected_files(c: Corpus, fixes: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): new files of the corrected documents; captions that were missing are lines at the end."""
    s, p = corrected(c, fixes, issues)
    lines = fix.docx_lines(s, p)
    if issues is not None:
        layout = c.more["table_layout"] if "table_layout" in c.more else formatting.no_layout(c.docs, "table_layout")
        late = fix.missing_captions(c.tables, fix.table_captions(c.tables, layout))
        last = lines.groupBy("doc_id").agg(F.max("line").alias("last"))
        lines = lines.unionByName(
            late.join(last, "doc_id", "left").select(
                "doc_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("int").alias("line"),
                F.col("caption").alias("text"),
            )
        )
    return docx.written(lines)
