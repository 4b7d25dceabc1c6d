"""Normative text to clean blocks, rules and their types."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import squeeze

# Word stems of object and constraint types, of which the first match wins; words that settle a constraint
# before them; keywords; lines that carry nothing.
OBJECTS = [
    ("title_page", ["титульн", "титул"]),
    ("executors_list", ["список исполнител"]),
    ("abstract", ["реферат"]),
    ("contents", ["содержание"]),
    ("terms", ["термин", "определени"]),
    ("abbreviations", ["сокращен", "обозначен"]),
    ("introduction", ["введение"]),
    ("conclusion", ["заключени"]),
    ("references", ["список использованных источников", "библиографическ", "источник"]),
    ("appendix", ["приложени"]),
    ("figure", ["рисунк", "иллюстрац"]),
    ("table", ["таблиц"]),
    ("formula", ["формул", "уравнен"]),
    ("footnote", ["сноск"]),
    ("page_numbering", ["страниц", "лист", "нумерац страниц"]),
    ("heading", ["заголов", "подзаголов"]),
    ("section", ["раздел", "подраздел", "пункт"]),
    ("report", ["отчет", "отчета", "отчете"]),
]
CONSTRAINTS = [
    ("definition", ["это", "является"]),
    ("required_presence", ["должен содержать", "должен включать", "обязательн", "приводят следующие сведения"]),
    ("formatting", ["оформля", "печата", "шрифт", "полужир", "абзац", "интервал"]),
    ("numbering", ["нумерац", "обозначают", "арабскими цифрами"]),
    ("caption_required", ["должен иметь наименование", "должны иметь наименование", "подпись"]),
    ("reference_required", ["должны быть даны ссылки", "ссылк"]),
    ("placement", ["располага", "размеща", "следует помещать", "по центру"]),
    ("sequence", ["в порядке", "последовательн"]),
    ("language_requirement", ["языке", "русском языке", "национальном языке"]),
    ("optional_allowed", ["допускается", "могут включать", "могут быть"]),
]
#: (constraint, groups of stems): it is taken if each group has a stem in the text.
SETTLED = [
    ("caption_required", [["рисунк", "иллюстрац", "таблиц"], ["наименование", "подпись"]]),
    ("reference_required", [["ссыл"], ["долж"]]),
    ("numbering", [["нумерац"]]),
    ("optional_allowed", [["допускается", "могут"]]),
]
KEYWORDS = [
    "рисунок", "иллюстрация", "таблица", "формула", "заголовок", "раздел", "подраздел", "приложение", "источник",
    "ссылка", "нумерация", "шрифт", "подпись", "страница", "абзац", "титульный лист", "реферат", "содержание",
    "заключение", "введение",
]
SERVICE = [
    r"For Staff Page \d+$",
    r"INTERSTATE COUNCIL FOR STANDARDIZATION,$",
    r"METROLOGY AND CERTIFICATION$",
    r"\d{1,2}:\d{2}$",
    r"[\"'`]+$",
    r"(?i:system of standards on information)",
    r"Документ предоставлен",
    r"Дата сохранения:",
]
ANNEX_WORD = "Приложение"
ANNEX = ANNEX_WORD + r"\s+[А-ЯA-Z]"
BIBLIOGRAPHY = "Библиография"
EDGE = "\".,;:()[]"


def service_line(t: Column) -> Column:
    """Of a squeezed line. The pattern is tried at the line's start only, not at each of its places."""
    return t.rlike("^(?:" + "|".join(SERVICE) + ")")


def starts_with_digit(c: Column) -> Column:
    """Spares the lines that don't the patterns of numbers."""
    return F.ascii(c).between(ord("0"), ord("9"))


def starts_block(t: Column) -> Column:
    """Of a squeezed line."""
    capitals = (F.length(t) <= 120) & (t == F.upper(t)) & t.rlike(r"\p{L}")
    number = starts_with_digit(t) & t.rlike(r"^\d+(\.\d+)*\s+.+$")
    return number | (t.startswith(ANNEX_WORD) & t.rlike(rf"^{ANNEX}$")) | (t == BIBLIOGRAPHY) | capitals


def inline_split(c: Column) -> Column:
    """Text cut before the first annex, and each part before the first bibliography, that isn't at its start."""
    def cut(part: Column, word: str, mark: str) -> Column:
        pattern = rf"(?s)^(.+?)({mark}.*)$"
        return F.when(
            F.contains(part, F.lit(word)) & part.rlike(pattern), F.array(F.regexp_extract(part, pattern, 1), F.regexp_extract(part, pattern, 2)),
        ).otherwise(F.array(part))

    parts = F.flatten(F.transform(cut(c, ANNEX_WORD, ANNEX), lambda part: cut(part, BIBLIOGRAPHY, BIBLIOGRAPHY)))
    return F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part != "")


def clean_blocks(lines: DataFrame) -> DataFrame:
    """(standard_id, block, text) of (standard_id, pos, line): lines that end with a hyphen joined to the next, service lines gone, lines merged to blocks."""
    by = W.partitionBy("standard_id").orderBy("pos")
    x = lines.withColumn("whole", F.sum(F.when(F.lag("line").over(by).endswith("-"), 0).otherwise(1)).over(by))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    # squeezed in the aggregate: a filter above it takes the column, where it would work out that of a projection again
    x = x.groupBy("standard_id", F.col("whole").alias("pos")).agg(
        squeeze(
            F.array_join(
                F.transform(parts, lambda p, i: F.when(i < F.count(F.lit(1)) - 1, F.regexp_replace(p["line"], "-$", "")).otherwise(p["line"])),
                "",
            )
        ).alias("t")
    ).where(~service_line(F.col("t")))
    x = x.withColumn("head", (F.col("t") != "") & starts_block(F.col("t")))
    new = (F.col("t") == "") | F.col("head") | F.coalesce(F.lag("head").over(by), F.lit(False))
    x = x.withColumn("b", F.sum(new.cast("int")).over(by))
    g = x.where("t <> ''").groupBy("standard_id", "b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), " ").alias("t")
    )
    g = g.select("standard_id", "b", F.posexplode(inline_split(F.col("t"))).alias("i", "text"))
    return g.select("standard_id", (F.row_number().over(W.partitionBy("standard_id").orderBy("b", "i"))).alias("block"), "text")


def heading_tail(c: Column) -> Column:
    """struct(title, tail): the title ends before the first capitalised word that follows a lower-case one."""
    words = F.split(squeeze(c), " ")
    bare = lambda w: F.btrim(w, F.lit(EDGE))
    start = F.struct(F.lit(False).alias("low"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    # one pass over the words, however many
    seen = F.aggregate(
        words, start, lambda s, w: F.struct(
            (s["low"] | bare(w).rlike(r"^\p{Ll}")).alias("low"),
            F.when((s["at"] < 0) & s["low"] & bare(w).rlike(r"^\p{Lu}"), s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"),
        ),
    )
    at = F.when(seen["at"] < 0, F.size(words)).otherwise(seen["at"])
    return F.struct(
        F.array_join(F.slice(words, F.lit(1), at), " ").alias("title"),
        F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ").alias("tail"),
    )


def looks_like_heading(title: Column) -> Column:
    """At most 140 characters, no address, not only Latin letters, and the first word isn't all capitals."""
    first = F.btrim(F.get(F.split(title, " "), F.lit(0)), F.lit(EDGE))
    latin = title.rlike("[A-Za-z]") & ~title.rlike("[\u0400-\u04FF]")
    shouted = first.rlike(r"\p{L}") & (first == F.upper(first)) & (first != F.lower(first))
    return (title != "") & (F.length(title) <= 140) & ~F.lower(title).rlike(r"http|www\.|//") & ~latin & ~shouted


def has_any(c: Column, stems: list[str]) -> Column:
    hit = F.lit(False)
    for s in stems:
        hit = hit | F.contains(c, F.lit(s))
    return hit


def best_match(c: Column, lexicon: list[tuple[str, list[str]]]) -> Column:
    """The first entry one of whose stems the text has, else generic."""
    out = F.lit("generic")
    for name, stems in reversed(lexicon):
        out = F.when(has_any(c, stems), name).otherwise(out)
    return out


def object_type(title: Column, content: Column, section_title: Column | None = None) -> Column:
    return best_match(F.lower(F.concat_ws(" ", *([] if section_title is None else [section_title]), title, content)), OBJECTS)


def constraint_type(title: Column, content: Column) -> Column:
    c = F.lower(F.concat_ws(" ", title, content))
    out = best_match(c, CONSTRAINTS)
    for name, groups in reversed(SETTLED):
        every = F.lit(True)
        for stems in groups:
            every = every & has_any(c, stems)
        out = F.when(every, name).otherwise(out)
    return out


def keywords(c: Column) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), k) for k in KEYWORDS)))


def parse_blocks(b: DataFrame) -> DataFrame:
    """Blocks with their part (front_matter until heading 1, normative_body, then annexes for good), kind and headings.

    A top-level heading counts only if it is the next number; one that isn't is an example.
    """
    by = W.partitionBy("standard_id").orderBy("block")
    first, number = r"^(\d+)\s+(.+)$", r"^(\d+\.\d+(?:\.\d+)*)\s+(.+)$"
    marked = F.col("text").startswith(ANNEX_WORD) | F.col("text").startswith(BIBLIOGRAPHY)
    annex = marked & F.col("text").rlike(rf"^({ANNEX}|{BIBLIOGRAPHY})(?![\p{{L}}\p{{N}}_])")
    digit = starts_with_digit(F.col("text"))
    x = b.withColumn("annexed", F.max(annex.cast("int")).over(by) == 1)
    x = x.withColumn("h", F.when(digit & F.col("text").rlike(first), heading_tail(F.regexp_extract("text", first, 2))))
    top = F.col("h").isNotNull() & looks_like_heading(F.col("h.title"))
    x = x.withColumn("n", F.when(~F.col("annexed") & top, F.regexp_extract("text", first, 1).try_cast("int")))
    # the fold "accept n if it is last + 1" keeps an ordered list of numbers, one for each standard: headings are few
    g = x.where("n is not null").groupBy("standard_id").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("h"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("at"))
    fold = F.aggregate(
        "h", start, lambda s,
        e: F.when(e["n"] == s["last"] + 1, F.struct(e["n"].alias("last"), F.array_append(s["at"], e["block"]).alias("at"))).otherwise(s),
    )
    acc = g.select("standard_id", F.explode(fold["at"]).alias("block"), F.lit(True).alias("accepted"))
    x = x.join(acc, ["standard_id", "block"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    x = x.withColumn("body", F.max(F.col("accepted").cast("int")).over(by) == 1)
    inside = F.col("body") & ~F.col("annexed")
    rule = inside & F.col("n").isNull() & digit & F.col("text").rlike(number)
    part = F.when(F.col("annexed"), "annexes").when(F.col("body"), "normative_body").otherwise("front_matter")
    kind = F.when(F.col("accepted"), "section").when(rule, "rule").when(inside & F.col("n").isNotNull(), "example").otherwise("text")
    x = x.withColumn("kind", kind).withColumn(
        "h", F.when(F.col("accepted"), F.col("h")).when(rule, heading_tail(F.regexp_extract("text", number, 2))),
    )
    x = x.withColumn("number", F.when(F.col("accepted"), F.col("n").cast("string")).when(rule, F.regexp_extract("text", number, 1)))
    own = F.when(
        F.col("accepted"),
        F.struct(
            F.concat(F.lit("std_sec_"), (F.col("n") - 1).cast("string")).alias("id"), F.col("number").alias("number"),
            F.col("h.title").alias("title"),
        ),
    )
    section = F.when(~F.col("annexed"), F.last(own, True).over(by))
    x = x.withColumn("section", section)
    return x.select(
        "standard_id", "block", part.alias("part"), "kind", "number", F.col("h.title").alias("title"), F.when(
            F.col("h").isNotNull(), F.col("h.tail"),
        ).otherwise(F.col("text")).alias("content"),
        F.col("section.id").alias("section_id"), F.col("section.number").alias("section_number"), F.col("section.title").alias("section_title"), "text",
    )


def rules(parsed: DataFrame) -> DataFrame:
    """Rules with content, types and keywords; the first text after a rule without content becomes its content."""
    by = W.partitionBy("standard_id").orderBy("block")
    p = parsed.where(
        "part = 'normative_body' and kind <> 'example'"
    ).withColumn("nk", F.lead("kind").over(by)).withColumn("nc", F.lead("content").over(by))
    bare = (F.col("content") == "") | (F.col("content") == F.col("title"))
    r = p.where("kind = 'rule'").withColumn(
        "content",
        F.when(bare & (F.col("nk") == "text"), F.col("nc")).when(F.col("content") == "", F.col("title")).otherwise(F.col("content")),
    )
    n = F.row_number().over(by)
    return r.select(
        "standard_id", n.alias("ord"), F.concat(F.lit("gost_rule_"), n - 1).alias("rule_id"), "number", "section_id", "section_number", "section_title", "title", "content",
        object_type(
            F.col("title"), F.col("content"), F.col("section_title"),
        ).alias("object_type"), constraint_type(F.col("title"), F.col("content")).alias("constraint_type"), keywords(
            F.concat_ws(" ", "section_title", "title", "content")
        ).alias("keywords"),
    )


def sections(parsed: DataFrame) -> DataFrame:
    """(standard_id, section_id, number, title, ord, text): a section's text is its heading's tail and the blocks below it."""
    p = parsed.where("section_id is not null and kind <> 'example'")
    said = F.when(F.col("kind") == "section", F.col("content")).otherwise(F.col("text"))
    g = p.groupBy("standard_id", "section_id").agg(
        F.min("block").alias("ord"), F.max(F.when(F.col("kind") == "section", F.struct("number", "title"))).alias("h"),
        F.array_sort(F.collect_list(F.struct("block", said.alias("t")))).alias("b"),
    )
    return g.select(
        "standard_id", "section_id", F.col("h.number").alias("number"), F.col("h.title").alias("title"), "ord",
        F.array_join(F.filter(F.transform("b", lambda x: x["t"]), lambda t: t != ""), "\n\n").alias("text"),
    )


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition (NFKD) leaves of characters beyond ASCII: those with one ASCII character, these, and those with several."""
    one, several = {}, {}
    for code in range(0x80, 0x10000):
        if not 0xD800 <= code < 0xE000:
            left = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if x < "\x80")
            if len(left) == 1:
                one[chr(code)] = left
            elif left:
                several[chr(code)] = left
    return "".join(one), "".join(one.values()), several


WIDE, PLAIN, LIGATURES = _decomposed()


def ascii_folded(c: Column) -> Column:
    """The ASCII characters of the text's compatibility decomposition: no accents, ligatures and wide letters taken apart, all else gone."""
    parts = F.create_map(*(F.lit(x) for pair in LIGATURES.items() for x in pair))
    # few texts have such characters
    apart = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(parts, x), x)), "")
    c = F.when(c.rlike("[" + "".join(LIGATURES) + "]"), apart).otherwise(c)
    return F.regexp_replace(F.translate(c, WIDE, PLAIN), r"[^\x00-\x7F]", "")


#: The standard that a registry begins with.
SEED = ("gost_7_32_2017", "GOST 7.32-2017")


def registry(names: DataFrame) -> DataFrame:
    """(standard_id, name) of (name): the seed and every name under its id, the first name of equal ids."""
    seed = names.sparkSession.createDataFrame([SEED], "standard_id string, name string")
    new = names.select(slug(F.col("name")).alias("standard_id"), "name").groupBy("standard_id").agg(F.min("name").alias("name"))
    return seed.unionByName(new.where(F.col("standard_id") != SEED[0]))


def slug(name: Column) -> Column:
    """An ASCII id of a standard's name: letters that fold to ASCII, digits and underscores; of none, a hash."""
    s = F.btrim(F.regexp_replace(F.lower(ascii_folded(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.concat(F.lit("standard_"), F.substring(F.md5(name.cast("binary")), 1, 10))).otherwise(s)
