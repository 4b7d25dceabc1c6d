"""The engine from SQL: relations of a corpus as temporary views, and table functions for LATERAL joins.

The functions are SQL themselves, so a query that uses them is planned as one and stays in the JVM:

    register(spark)
    views(corpus, "c_")
    spark.sql("SELECT d.doc_id, s.* FROM documents d, LATERAL vellum_sentences(d.text) s WHERE length(s.sentence) > 400")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .engine import Corpus

_SENTENCES = r"filter(transform(split(regexp_replace(trim(coalesce(t, '')), '([.!?])\\s+', concat('$1', char(1))), char(1)), x -> trim(x)), x -> x <> '')"
_BLOCKS = r"filter(transform(split(regexp_replace(coalesce(t, ''), '\r\n?', '\n'), '\n\\s*\n'), x -> btrim(x, concat(' \t\n\r', char(12)))), x -> x <> '')"
_CHUNKS = (
    "filter(transform(sequence(0, cast(greatest(ceil((length(coalesce(t, '')) - size) / (size - shared)), 0) as int)), "
    "i -> struct(i as i, trim(substr(coalesce(t, ''), i * (size - shared) + 1, size)) as piece)), x -> x.piece <> '')"
)
#: name -> (parameters, columns, body)
FUNCTIONS = {
    "vellum_sentences": ("t STRING", "ord INT, sentence STRING", f"SELECT pos, col FROM (SELECT posexplode({_SENTENCES}))"),
    "vellum_blocks": ("t STRING", "block INT, text STRING", f"SELECT pos + 1, col FROM (SELECT posexplode({_BLOCKS}))"),
    "vellum_chunks": ("t STRING, size INT, shared INT", "chunk INT, piece STRING", f"SELECT col.i, col.piece FROM (SELECT explode({_CHUNKS}))"),
}


def register(spark: SparkSession) -> SparkSession:
    """The session with FUNCTIONS as temporary table functions."""
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return spark


def views(c: Corpus, prefix: str = "") -> list[str]:
    """Every relation of a corpus as a temporary view; gives their names."""
    every = {n: getattr(c, n) for n in ("docs", "sections", "paragraphs", "figures", "tables")} | c.more
    if c.rules is not None:
        every["rules"] = c.rules
    for name, df in every.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in every]
