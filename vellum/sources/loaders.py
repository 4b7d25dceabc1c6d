"""Readers of document collections: text, Markdown, JSON, HTML-free uploads, PDF by a pluggable extractor, directories.

Each reader takes a path (or a folder) that Spark can open and returns (doc_id, text, source, filename, extension, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from ..operators.parse import markdown_sections
from .docx import document_text

Reader = Callable[[SparkSession, str], DataFrame]


def _named(df: DataFrame, path: Column) -> DataFrame:
    name = F.regexp_replace(path, r"^.*/", "")
    name = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return df.withColumn("source", path).withColumn("filename", name).withColumn(
        "doc_id", F.regexp_replace("filename", r"\.[^.]*$", ""),
    ).withColumn(
        "extension", F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)),
    )


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    return _named(df.select("content", F.col("path").alias("__p")), F.col("__p")).drop("__p")


def read_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """One row for each file, its text whole."""
    if encoding.lower().replace("-", "") == "utf8":
        df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return _named(df.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("__p")), F.col("__p")).drop("__p")
    # decode() of Spark 4 knows few encodings
    b = binary(spark, path).select("content", "source", "filename", "doc_id", "extension")

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.decode(encoding) for c in x.column(0).to_pylist()], pa.string()), *x.columns[1:]],
                ["text", "source", "filename", "doc_id", "extension"],
            )

    return b.mapInArrow(run, "text string, source string, filename string, doc_id string, extension string")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row for each section with a body, ids {stem}_section_{i}; a file without any is one row."""
    t = read_text(spark, path)
    s = markdown_sections(t.select("source", "text"), "source")
    j = t.drop("text").join(s, "source")
    return j.withColumn("doc_id", F.concat("doc_id", F.lit("_section_"), "section"))


def read_json(spark: SparkSession, path: str, text_key: str = "text", id_key: str = "id", metadata_keys: tuple[str, ...] = ()) -> DataFrame:
    """The objects of JSON files (a list or one object): those with a text, ids from the key or {stem}_{idx}, idx counting all."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    raw = _named(
        raw.select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("__p")),
        F.col("__p"),
    ).drop("__p")
    one = MapType(StringType(), StringType())
    many = F.from_json("value", ArrayType(one))
    items = F.when(F.ltrim("value").startswith("["), many).otherwise(F.array(F.from_json("value", one)))
    x = raw.select("source", "filename", "doc_id", "extension", F.posexplode(items).alias("i", "m"))
    x = x.withColumn("text", F.col("m")[text_key]).where(F.coalesce("text", F.lit("")) != "")
    name = F.coalesce(F.nullif(F.col("m")[id_key], F.lit("")), F.concat("doc_id", F.lit("_"), "i"))
    return x.select("text", "source", "filename", name.alias("doc_id"), "extension", *(F.col("m")[k].alias(k) for k in metadata_keys))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Plain text of DOCX files; one that can't be read gives an error in its place."""
    b = binary(spark, path, "*.docx")

    def run(batches):
        for x in batches:
            got = [document_text(c) for c in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), *x.columns[1:]],
                ["text", "error", "source", "filename", "doc_id", "extension"],
            )

    return b.select("content", "source", "filename", "doc_id", "extension").mapInArrow(
        run, "text string, error string, source string, filename string, doc_id string, extension string",
    )


Extractor = Callable[[bytes], "list[str] | str"]


def first_text(content: bytes, extractors: Sequence[Extractor]) -> tuple[str | None, str | None]:
    """(text, error) by the first extractor that gives any text; pages are joined by a blank line."""
    why = []
    for extract in extractors:
        try:
            got = extract(content)
            text = got if isinstance(got, str) else "\n\n".join(p for p in got if p and p.strip())
        except Exception as e:
            why.append(f"{type(e).__name__}: {e}")
            continue
        if text and text.strip():
            return text, None
        why.append("no text")
    return None, "; ".join(why) or "no extractor"


def pdf_texts(files: DataFrame, *extractors: Extractor) -> DataFrame:
    """(text, error) of files (content and any other columns) by the caller's extractors, one after the other; no PDF library comes with the engine."""
    other = [f for f in files.schema if f.name != "content"]

    def run(batches):
        for x in batches:
            got = [first_text(c or b"", extractors) for c in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), *x.columns[1:]],
                ["text", "error", *(f.name for f in other)],
            )

    schema = ", ".join(["text string", "error string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in other)])
    return files.select("content", *(f.name for f in other)).mapInArrow(run, schema)


def read_pdf(spark: SparkSession, path: str, *extractors: Extractor) -> DataFrame:
    """PDF files as rows with their text, or an error where no extractor finds any."""
    if not extractors:
        raise ValueError("reading PDF needs an extractor: extract(bytes) -> str or pages")
    return pdf_texts(binary(spark, path, "*.pdf").select("content", "source", "filename", "doc_id", "extension"), *extractors)


class Registry:
    """Readers by suffix; unknown suffixes are read as text."""

    def __init__(self):
        self.readers: dict[str, Reader] = {
            ".txt": read_text, ".md": read_markdown, ".markdown": read_markdown, ".json": read_json, ".docx": read_docx,
        }

    def register(self, suffix: str, reader: Reader) -> None:
        self.readers[suffix.lower()] = reader

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        return self.readers.get(suffix, read_text)(spark, path)

    def load_many(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """Paths of a call's argument list, one read each."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.load(spark, p).drop("content") for p in paths])

    def load_directory(self, spark: SparkSession, path: str, extensions: tuple[str, ...] = (".txt", ".md", ".json")) -> DataFrame:
        """A folder and all below it: one read for each extension, however many files."""
        parts = []
        for e in extensions:
            reader = self.readers.get(e, read_text)
            parts.append(reader(_globbed(spark, e), path).drop("content"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class _globbed:
    """A session whose reader sees only files of one extension."""

    def __init__(self, spark: SparkSession, extension: str):
        self._spark, self._extension = spark, extension

    @property
    def read(self):
        return self._spark.read.option("pathGlobFilter", f"*{self._extension}")

    def __getattr__(self, name):
        return getattr(self._spark, name)


def uploads(files: DataFrame) -> DataFrame:
    """(doc_id, filename, content) of uploads as (doc_id, text, source_format, error), by suffix; unknown ones get an error."""
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    f = files.withColumn("suffix", suffix)
    plain = f.where(F.col("suffix").isin(".txt", ".md")).select(
        "doc_id", F.trim(F.decode("content", "UTF-8")).alias("text"),
        F.substring("suffix", 2, 9).alias("source_format"), F.lit(None).cast("string").alias("error"),
    )

    def run(batches):
        for x in batches:
            got = [document_text(c) for c in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    x.column(0), pa.array([g[0] for g in got], pa.string()),
                    pa.array(["docx" if g[1] is None else "docx_fallback" for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.string()),
                ],
                ["doc_id", "text", "source_format", "error"],
            )

    kind = files.schema["doc_id"].dataType.simpleString()
    docx = f.where(F.col("suffix").isin(".docx", ".doc")).select("doc_id", "content").mapInArrow(
        run, f"doc_id {kind}, text string, source_format string, error string",
    )
    other = f.where(~F.col("suffix").isin(".txt", ".md", ".docx", ".doc")).select(
        "doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source_format"),
        F.concat(F.lit("unsupported: "), "suffix").alias("error"),
    )
    return plain.unionByName(docx).unionByName(other)


def concatenated(df: DataFrame, key: str) -> DataFrame:
    """All texts of a key joined by a blank line, in the order of their ids."""
    return df.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]), "\n\n").alias("text")
    )
