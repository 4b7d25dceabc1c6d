"""Structure checks over sections(doc_id, ord, section_id, number, title, level, text).

Every check is a window or a join keyed by doc_id and returns issue rows (ISSUE columns below); the windows share one
partitioning, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import folded, number_parts

# The title variants of each required part, in the order the parts must have.
REQUIRED = [
    ("Введение", ["введение"]),
    ("Заключение", ["заключение", "выводы"]),
    (
        "Список использованных источников",
        ["список использованных источников", "список литературы", "библиографический список", "источники"],
    ),
]
ISSUE = ["doc_id", "check_rank", "item_ord", "subtype", "severity", "section_id", "paragraph_id", "page", "evidence", "suggestion"]


def _issue(df: DataFrame, rank: int, subtype: str, severity: str, evidence: Column, suggestion: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id", F.lit(rank).alias("check_rank"), F.col("ord").alias("item_ord"), F.lit(subtype).alias("subtype"),
        F.lit(severity).alias("severity"), "section_id", "paragraph_id", "page", evidence.alias("evidence"),
        (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"),
    )


def structure_entries(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row per section: number parts, parent, level (the number's depth, else the given one), first paragraph's place."""
    first = paragraphs.groupBy("doc_id", "section_id").agg(F.min_by(F.struct("page", "paragraph_id"), "ord").alias("at"))
    parts = number_parts("number")
    e = sections.withColumn("parts", parts).join(first, ["doc_id", "section_id"], "left")
    depth = F.size("parts")
    return e.select(
        "doc_id", "ord", "section_id", "number", "title", F.when(depth > 0, depth).otherwise(F.col("level")).cast("int").alias("level"), "parts",
        F.when(
            depth > 1,
            F.array_join(F.transform(F.slice("parts", F.lit(1), F.greatest(depth - 1, F.lit(0))), lambda p: p.cast("string")), "."),
        ).alias("parent_number"),
        F.col("at.page").alias("page"), F.col("at.paragraph_id").alias("paragraph_id"),
    )


def unrecognized(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents without sections, or whose sections have no numbers."""
    have = entries.groupBy("doc_id").agg(F.max(F.size("parts")).alias("depth"))
    d = docs.select("doc_id").join(have, "doc_id", "left").where(F.coalesce("depth", F.lit(0)) == 0)
    why = F.when(F.col("depth").isNull(), F.lit("no sections")).otherwise(F.lit("no numbered sections"))
    none = F.lit(None).cast("string")
    return _issue(
        d.select(
            "doc_id", F.lit(0).alias("ord"), none.alias("section_id"), none.alias("paragraph_id"),
            F.lit(None).cast("int").alias("page"), "depth",
        ),
        0, "unrecognized_structure", "critical", why,
    )


def unnumbered_top(entries: DataFrame) -> DataFrame:
    top = entries.where("level = 1")
    some = F.max((F.size("parts") > 0).cast("int")).over(W.partitionBy("doc_id")) == 1
    top = top.withColumn("some", some).where(F.col("some") & (F.size("parts") == 0) & ~folded("title").startswith("приложение"))
    return _issue(top, 1, "numbering_error", "warning", F.concat(F.lit("no number: "), "title"))


def duplicates(entries: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id", "parts").orderBy("ord")
    d = entries.where(F.size("parts") > 0).withColumn("n", F.row_number().over(w)).withColumn(
        "first", F.first("title").over(w),
    ).where("n > 1")
    return _issue(d, 2, "numbering_error", "critical", F.concat(F.lit("number "), "number", F.lit(" was used by: "), "first"))


def missing_parents(entries: DataFrame) -> DataFrame:
    """A number whose parent doesn't come earlier; from depth 3 on also a jump in level."""
    numbered = entries.where(F.size("parts") > 0)
    seen = numbered.groupBy("doc_id", F.col("parts").alias("up")).agg(F.min("ord").alias("at"))
    e = numbered.where(F.size("parts") > 1).withColumn("up", F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))))
    e = e.join(seen, ["doc_id", "up"], "left").where(F.col("at").isNull() | (F.col("at") >= F.col("ord")))
    e = e.withColumn(
        "kind",
        F.explode(F.when(F.size("up") >= 2, F.array(F.lit("no parent: "), F.lit("level jump: "))).otherwise(F.array(F.lit("no parent: ")))),
    )
    return _issue(e, 3, "hierarchy_error", "critical", F.concat("kind", "number"))


def first_number(entries: DataFrame) -> DataFrame:
    top = entries.where(F.size("parts") == 1).withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")))
    return _issue(
        top.where((F.col("n") == 1) & (F.get("parts", F.lit(0)) != 1)), 4, "numbering_error", "warning",
        F.concat(F.lit("starts at "), "number"),
    )


def sequence_gaps(entries: DataFrame) -> DataFrame:
    """Under each parent the last parts must count 1, 2, 3, ..."""
    e = entries.where(F.size("parts") > 0).withColumn("last", F.element_at("parts", -1)).withColumn(
        "up", F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))),
    )
    e = e.withColumn("before", F.lag("last").over(W.partitionBy("doc_id", "up").orderBy("ord")))
    bad = F.when(F.col("before").isNull(), (F.size("up") > 0) & (F.col("last") != 1)).otherwise(F.col("last") != F.col("before") + 1)
    return _issue(e.where(bad), 5, "numbering_error", "warning", F.concat(F.lit("gap before "), "number"))


def transitions(entries: DataFrame) -> DataFrame:
    """From one numbered section to the next: its first child, or the next number at its or a higher level."""
    e = entries.where(F.size("parts") > 0).withColumn(
        "was", F.lag("parts").over(W.partitionBy("doc_id").orderBy("ord")),
    ).where("was is not null")
    k = F.size("parts")
    head = lambda c, n: F.slice(c, F.lit(1), F.greatest(n, F.lit(0)))
    child = (k == F.size("was") + 1) & (head("parts", k - 1) == F.col("was")) & (F.element_at("parts", -1) == 1)
    after = (k <= F.size("was")) & (head("parts", k - 1) == head("was", k - 1)) & (F.element_at("parts", -1) == F.get("was", k - 1) + 1)
    return _issue(e.where(~(child | after)), 6, "order_error", "critical", F.concat(F.lit("unexpected "), "number"))


def _groups(spark) -> DataFrame:
    rows = [(i, t, v) for i, (t, v) in enumerate(REQUIRED)]
    return spark.createDataFrame(rows, "part int, title string, variants array<string>").withColumnRenamed("title", "expected")


def missing_required(
    docs: DataFrame, entries: DataFrame, paragraphs: DataFrame, layout: DataFrame | None = None,
    table_layout: DataFrame | None = None,
) -> DataFrame:
    """Required parts that no level-1 title, first 80 paragraphs or first 60 lines of either layout mention."""
    def firsts(df, n):
        return df.withColumn(
            "n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")),
        ).where(F.col("n") <= n).select("doc_id", folded("text").alias("t"))

    pool = entries.where("level = 1").select("doc_id", folded("title").alias("t")).unionByName(firsts(paragraphs, 80))
    for more in (layout, table_layout):
        if more is not None:
            pool = pool.unionByName(firsts(more.withColumn("ord", F.col("paragraph_index")), 60))
    groups = F.broadcast(_groups(docs.sparkSession))  # three rows
    found = pool.join(groups, F.exists("variants", lambda v: F.contains(F.col("t"), v))).select("doc_id", "part").distinct()
    gone = docs.select("doc_id").crossJoin(groups).join(found, ["doc_id", "part"], "left_anti")
    none = F.lit(None).cast("string")
    return _issue(
        gone.select(
            "doc_id", F.col("part").alias("ord"), none.alias("section_id"), none.alias("paragraph_id"),
            F.lit(None).cast("int").alias("page"), "expected",
        ),
        7, "missing_required_section", "warning", F.concat(F.lit("«"), "expected", F.lit("»")),
        F.concat(F.lit("add «"), "expected", F.lit("»")),
    )


def required_order(entries: DataFrame) -> DataFrame:
    """Required parts in the wrong order: adjacent pairs of their first level-1 sections."""
    groups = F.broadcast(_groups(entries.sparkSession))
    at = entries.where("level = 1").join(groups, F.exists("variants", lambda v: F.contains(folded("title"), v)))
    at = at.groupBy("doc_id", "part").agg(F.min_by(F.struct("ord", "section_id", "paragraph_id", "page", "title"), "ord").alias("e"))
    nxt = at.select("doc_id", (F.col("part") - 1).alias("part"), F.col("e").alias("later"))
    bad = at.join(nxt, ["doc_id", "part"]).where("e.ord > later.ord")
    return _issue(bad.select("doc_id", "e.*"), 8, "order_error", "warning", F.concat(F.lit("too late: "), "title"))


def check_structure(docs: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """All checks in order, numbered, then without repeats (the number is given first, as the contract says)."""
    e = structure_entries(sections, paragraphs)
    odd = unrecognized(docs, e)
    bare = docs.select("doc_id").join(e.select("doc_id").distinct(), "doc_id", "left_anti")
    parts = [
        unnumbered_top(e), duplicates(e), missing_parents(e), first_number(e), sequence_gaps(e), transitions(e),
        missing_required(docs, e, paragraphs), required_order(e),
    ]
    every = odd
    for p in parts:
        every = every.unionByName(p.join(bare, "doc_id", "left_anti") if p is parts[6] else p)
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("check_rank", "item_ord", "evidence"))
    key = W.partitionBy("doc_id", "subtype", "section_id", "paragraph_id", "page", "evidence").orderBy("n")
    return every.withColumn("n", n).withColumn(
        "issue_id", F.concat(F.lit("issue_structure_"), F.lpad("n", 3, "0")),
    ).withColumn("k", F.row_number().over(key)).where("k = 1").drop("n", "k")


def structure_map(docs: DataFrame, entries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Per document: ordered level-1 titles, missing required parts, and whether the structure can't be recognised."""
    top = entries.where("level = 1").groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda s: s["title"]).alias("titles")
    )
    gone = missing_required(docs, entries, paragraphs).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "evidence"))), lambda s: s["evidence"]).alias("missing")
    )
    odd = unrecognized(docs, entries).select("doc_id", F.lit(True).alias("odd"))
    out = docs.select("doc_id").join(top, "doc_id", "left").join(gone, "doc_id", "left").join(odd, "doc_id", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id", F.coalesce("titles", empty).alias("titles"), F.coalesce("missing", empty).alias("missing"),
        F.coalesce("odd", F.lit(False)).alias("critical"),
    )
