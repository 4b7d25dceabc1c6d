"""Column helpers for text: the same semantics for every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null or without visible characters; the empty string and null mean the same throughout."""
    return squeeze(c) == ""


def squeeze(c: Column | str) -> Column:
    """White space runs (Unicode) become one space; trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def folded(c: Column | str) -> Column:
    """Lower case, yo as ye, white space squeezed: how titles and phrases are compared."""
    return squeeze(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "ё", "е"))


def tokens(c: Column | str, least: int = 3) -> Column:
    """Distinct lower-case words of at least `least` letters, digits or underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= least))


def number_parts(c: Column | str) -> Column:
    """'1.2.3' as [1, 2, 3]; an empty array unless every part is a number."""
    n = F.coalesce(col(c), F.lit(""))
    return F.when(
        n.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9})*$"), F.transform(F.split(n, r"\."), lambda p: p.cast("int")),
    ).otherwise(F.array().cast("array<int>"))


def number_key(c: Column | str) -> Column:
    """Sort key of a rule number: the digits of each part, none as 0."""
    return F.transform(
        F.split(F.coalesce(col(c), F.lit("")), r"\."),
        lambda p: F.coalesce(F.regexp_replace(p, r"[^0-9]", "").try_cast("int"), F.lit(0)),
    )


def sentences(c: Column | str) -> Column:
    """Text cut after . ! or ? followed by white space; blank pieces go."""
    return F.filter(
        F.transform(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"(?<=[.!?])(?U)\s+"), lambda s: F.trim(s)),
        lambda s: s != "",
    )


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"[A-Za-zА-Яа-яЁё0-9-]+"))


def replace_first(text: Column, needle: Column, by: Column) -> Column:
    """The first occurrence of needle, whatever its case, replaced; spaces squeezed, outer spaces and commas gone."""
    at = F.call_function("locate", F.lower(needle), F.lower(text))
    cut = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), by, F.substr(text, at + F.length(needle)))).otherwise(text)
    return F.btrim(F.regexp_replace(cut, r"(?U)\s{2,}", " "), F.lit(" ,"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, empty, zero or differently long vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot / norm).otherwise(F.lit(0.0))
