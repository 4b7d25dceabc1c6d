"""Style checks over text units, with lexicons as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import folded, replace_first, sentences, squeeze, word_count

# Phrases and words that a report must not use, with what replaces them.
COLLOQUIAL = [
    ("короче говоря", "таким образом"), ("ну короче", "таким образом"), ("блин", ""), ("офигенно", "значительно"),
    ("капец", "существенно"),
]
INFORMAL = [
    ("хрень", "элемент"), ("фигня", "ошибка"), ("дебильный", "некорректный"), ("тупой", "неудачный"),
    ("жесть", "существенная проблема"),
]
LONG_WORDS, LONG_CHARS = 55, 420


def text_units(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A document's paragraphs, or if it has none its sections (their text, else their title)."""
    words = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.col("title"))
    s = sections.join(paragraphs.select("doc_id").distinct(), "doc_id", "left_anti").withColumn(
        "n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")),
    )
    s = s.where(squeeze(words) != "").select(
        "doc_id", "ord", F.concat(F.lit("style_section_"), "n").alias("paragraph_id"), "section_id",
        words.alias("text"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("paragraph_index"),
    )
    return paragraphs.select("doc_id", "ord", "paragraph_id", "section_id", "text", "page", "paragraph_index").unionByName(s)


def long_sentences(units: DataFrame, key: list[str], words: int = LONG_WORDS, chars: int = LONG_CHARS) -> DataFrame:
    """Sentences of many words or characters, with their place in the unit."""
    s = units.select(*key, F.posexplode(sentences("text")).alias("sentence_ord", "sentence"))
    s = s.select(*key, "sentence_ord", F.length("sentence").alias("n_chars"), word_count("sentence").alias("n_words"))
    return s.where((F.col("n_words") >= words) | (F.col("n_chars") >= chars))


def _lexicon(spark, rows) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "item int, phrase string, replacement string"))


def lexicon_hits(units: DataFrame, rows: list[tuple[str, str]], key: list[str], whole_words: bool = False) -> DataFrame:
    """Units that contain a lexicon phrase: the fragment in its own case, the text before and after the fix.

    The lexicon is a constant of the program, so its broadcast is bounded.
    """
    u = units.withColumn("f", folded("text"))
    hit = F.contains(F.col("f"), F.col("phrase"))
    if whole_words:
        # the lexicon has letters and spaces only
        hit = hit & F.regexp(F.col("f"), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.col("phrase"), F.lit(r"(?![\p{L}\p{N}_])")))
    m = u.join(_lexicon(units.sparkSession, rows), hit)
    at = F.call_function("locate", F.col("phrase"), F.lower("text"))
    fragment = F.when(at > 0, F.substr(F.col("text"), at, F.length("phrase"))).otherwise(F.col("phrase"))
    return m.select(
        *key, "item", "phrase", fragment.alias("fragment"), F.trim("text").alias("before"),
        replace_first(F.trim("text"), F.col("phrase"), F.col("replacement")).alias("after"),
    )


def check_style(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """All lexical checks, numbered through each document."""
    u = text_units(sections, paragraphs)
    key = ["doc_id", "ord", "paragraph_id", "section_id", "page"]
    parts = [
        lexicon_hits(u, COLLOQUIAL, key).select(
            *key, F.lit(0).alias("check_rank"), "item", F.lit("colloquial_phrase").alias("subtype"),
            F.lit("warning").alias("severity"), F.col("fragment").alias("evidence"), F.col("after").alias("suggestion"),
        ),
        lexicon_hits(u, INFORMAL, key, True).select(
            *key, F.lit(1).alias("check_rank"), "item", F.lit("informal_wording").alias("subtype"),
            F.lit("warning").alias("severity"), F.col("fragment").alias("evidence"), F.col("after").alias("suggestion"),
        ),
        long_sentences(u, key).select(
            *key, F.lit(2).alias("check_rank"), F.col("sentence_ord").alias("item"),
            F.lit("long_sentence").alias("subtype"), F.lit("info").alias("severity"),
            F.col("n_words").cast("string").alias("evidence"), F.lit("split").alias("suggestion"),
        ),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "check_rank", "item"))
    return every.withColumn("issue_id", F.concat(F.lit("issue_style_"), F.lpad(n.cast("string"), 3, "0")))


#: Units of a document that a model is shown.
SHOWN = 40


def chat_prompts(units: DataFrame) -> DataFrame:
    """(doc_id, n, prompt): the first units of each document as a JSON array, for a model to check."""
    first = units.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))).where(F.col("n") <= SHOWN)
    shown = F.transform(
        F.array_sort(F.collect_list(F.struct("n", "paragraph_id", "section_id", "page", "text"))),
        lambda u: F.struct(
            u["paragraph_id"].alias("paragraph_id"), u["section_id"].alias("section_id"), u["page"].alias("page"),
            u["text"].alias("text"),
        ),
    )
    return first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(shown).alias("prompt"))


def chat_issues(responses: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Issues from a model's answers: a fenced block or the outermost braces are parsed; unknown subtypes and low confidence go."""
    kind = "struct<issues:array<struct<subtype:string,paragraph_id:string,severity:string,confidence:string,before:string,after:string>>>"
    fenced = F.regexp_extract("response", r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    sliced = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    got = F.from_json(F.when(fenced != "", fenced).otherwise(sliced), kind)
    i = responses.select("doc_id", F.posexplode(got["issues"]).alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("i"), "x.*")
    i = i.where(F.col("subtype").isin("spelling_error", "long_sentence") & (F.coalesce("confidence", F.lit("")) != "low"))
    i = i.join(paragraphs.select("doc_id", "paragraph_id", "section_id", "page"), ["doc_id", "paragraph_id"], "left")
    return i.select(
        "doc_id", F.concat(F.lit("issue_style_llm_"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("issue_id"),
        "subtype",
        F.when(F.coalesce("severity", F.lit("")) == "", "warning").otherwise(F.col("severity")).alias("severity"),
        "paragraph_id", "section_id", "page", "before", "after",
    )


def combined(chat: DataFrame, lexical: DataFrame) -> DataFrame:
    """Chat issues first, then lexical ones; repeats of (subtype, place, evidence) go."""
    cols = ["doc_id", "issue_id", "subtype", "severity", "section_id", "paragraph_id", "page", "evidence"]
    c = chat.withColumn("evidence", F.coalesce("before", F.lit(""))).select(*cols, F.lit(0).alias("src"))
    every = c.unionByName(lexical.select(*cols, F.lit(1).alias("src")))
    w = W.partitionBy("doc_id", "subtype", "section_id", "paragraph_id", "page", "evidence").orderBy("src", "issue_id")
    return every.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "src")


def style_summary(issues: DataFrame) -> DataFrame:
    by = issues.groupBy("doc_id", "subtype").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("suggestion", F.lit("")) != "").alias("fixable"),
    )
    return by.groupBy("doc_id").agg(
        F.sum("n").alias("total"), F.sum("fixable").alias("fixable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("subtype", "n")))).alias("by_subtype"),
    )


def check_logic(docs: DataFrame) -> DataFrame:
    """There are no logic checks: an empty relation of issues."""
    return docs.where(F.lit(False)).select(
        "doc_id",
        *(
            F.lit(None).cast("string").alias(c) for c in (
                "issue_id", "subtype", "severity", "section_id", "paragraph_id", "evidence", "suggestion",
            )
        ),
    )
