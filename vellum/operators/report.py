"""Merging, ranking and reporting of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEVERITY = {"critical": 3, "warning": 2, "info": 1}
TYPES = ["structure", "formatting", "style", "logic"]


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for k, v in SEVERITY.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def merged(issues: DataFrame) -> DataFrame:
    """One issue per signature: that of the highest rank (severity, a suggestion, longer evidence, longer quote), the earliest of equals, in the place of the first."""
    sign = [
        "doc_id", "type", F.coalesce(F.nullif("subtype", F.lit("")), "message").alias("__what"), "section_id",
        "paragraph_id", "paragraph_index", "page", "rule_id",
    ]
    i = issues.withColumn("__what", sign[2])
    key = ["doc_id", "type", "__what", "section_id", "paragraph_id", "paragraph_index", "page", "rule_id"]
    best = W.partitionBy(*key).orderBy(
        severity_rank(F.col("severity")).desc(), (F.coalesce("suggestion", F.lit("")) != "").desc(),
        F.length(F.coalesce("evidence", F.lit(""))).desc(), F.length(F.coalesce("quote", F.lit(""))).desc(), "ord",
    )
    return i.withColumn("__n", F.row_number().over(best)).withColumn(
        "position", F.min("ord").over(W.partitionBy(*key)),
    ).where("__n = 1").drop("__n", "__what")


def order_key() -> list[Column]:
    sev = F.when(
        F.col("severity") == "critical", 0,
    ).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(99)
    kind = F.lit(99)
    for i, t in enumerate(TYPES):
        kind = F.when(F.col("type") == t, i).otherwise(kind)
    return [sev, kind, F.col("issue_id")]


def ranked(issues: DataFrame) -> DataFrame:
    """rank: an issue's place in its document's report."""
    return issues.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*order_key())))


def summary(issues: DataFrame) -> DataFrame:
    """Per document: totals by severity and type, and how many issues have a suggestion."""
    by = issues.groupBy("doc_id", "type").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY),
        F.count_if(F.coalesce("suggestion", F.lit("")) != "").alias("fixable"),
    )
    return by.groupBy("doc_id").agg(
        F.sum("n").alias("total"), *(F.sum(s).alias(s) for s in SEVERITY), F.sum("fixable").alias("fixable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"),
    )


def report(docs: DataFrame, issues: DataFrame, agents: DataFrame) -> DataFrame:
    """Per document: the sorted issues, summary, agents run and failed, and a status."""
    s = summary(issues)
    one = ranked(issues).groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "issue_id", "type", "subtype", "severity"))),
            lambda x: x["issue_id"],
        ).alias("issue_ids")
    )
    a = agents.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.col("agent")))).alias("agents_run"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("agent", "error"))))
        ).alias("agents_failed"),
    )
    out = docs.select("doc_id").join(a, "doc_id", "left").join(s, "doc_id", "left").join(one, "doc_id", "left")
    failed = F.coalesce(F.size("agents_failed"), F.lit(0)) > 0
    return out.withColumn("status", F.when(failed, "partial_success").otherwise("done")).na.fill(0, ["total", *SEVERITY, "fixable"])
