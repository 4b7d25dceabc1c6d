"""Spelling variants of words by an even-partition pigeonhole join.

A word of length l is cut into two segments of l // 2 and l - l // 2 code points. If one edit turns it into another word,
one of the segments is left as it was: the first is then the start of the other word, the second its end. So words are
indexed under (l, first segment) and (l, second segment), and a word probes the index of its own length with its own
segments and that of words shorter by one with its start of (l - 1) // 2 code points and its end of the rest, which lies one place
further on. Words that meet under a key are verified (one edit), and pairs that met under both keys count once.

Where a key holds more than GROUP words, what its words don't have in common is cut evenly once more by the same rule: a
key is then (length of the indexed words, their first p and last q code points), and pairs under it meet again under the
key with p grown by half of the rest or that with q grown by the other half. That goes on until no key is larger, or one
code point is left, so no key holds many more pairs than it has links, and none is dropped. Rounds grow with the logarithm of a word's length.

Everything is DataFrame functions: runs are counted with partial sums before the shuffle, keys dealt by their hash.

Defined cases: null text has no runs; a null doc_id reads as an empty string in the hash; rows with the same doc_id count
one by one; a run that loses a code point to the hash counts as what is left; runs of any length are words; other columns are ignored; no words give an
empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words of one key above which it is cut again.
GROUP = 2000


def words(documents: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur `least` times; every: see the module's hash rule."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    lower = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = documents.select(doc, F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    # what loses a code point must have one more; shorter runs can't become words
    runs = runs.where(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")
    counted = runs.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= shortest) & (F.col("n") >= least))


def _start(n: Column) -> Column:
    return F.col("word").substr(F.lit(1), n)


def _end(n: Column) -> Column:
    return F.when(n > 0, F.col("word").substr(F.length("word") - n + 1, n)).otherwise(F.lit(""))


def _cut(rows: DataFrame) -> DataFrame:
    """Every row under the two keys that halve what its key left open. rows: word, n, longer, p, q.

    longer: whether the row probes the index of words shorter by one. A key is the length of the indexed words, p, q and
    the code points that these say.
    """
    size = F.length("word") - F.col("longer").cast("int")
    open_ = size - F.col("p") - F.col("q")
    first = F.struct((F.col("p") + F.floor(open_ / 2).cast("int")).alias("p"), F.col("q").alias("q"))
    second = F.struct(F.col("p").alias("p"), (F.col("q") + F.ceil(open_ / 2).cast("int")).alias("q"))
    rows = rows.select("word", "n", "longer", size.alias("size"), F.explode(F.array(first, second)).alias("k"))
    rows = rows.select("word", "n", "longer", "size", "k.p", "k.q")
    return rows.select("*", _start(F.col("p")).alias("start"), _end(F.col("q")).alias("end"))


KEY = ["size", "p", "q", "start", "end"]


def _met(keyed: DataFrame) -> DataFrame:
    """(a, na, b, nb): verified pairs of words that meet under a key; a is indexed, b as long and after a, or longer by one."""
    index = keyed.where("NOT longer").select(*KEY, F.col("word").alias("a"), F.col("n").alias("na"))
    probe = keyed.select(*KEY, "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    pairs = index.join(probe, KEY).where(F.col("longer") | (F.col("a") < F.col("b")))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def near_words(counted: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, na, b, nb), once for each two words that differ by one edit."""
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")
    keyed = _cut(counted.select("word", "n", both, F.lit(0).alias("p"), F.lit(0).alias("q")).where("NOT longer OR length(word) > 1"))
    found = None
    while True:
        keyed = written(keyed, "keys")
        sizes = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("many"), F.sum(F.when(F.col("longer"), 0).otherwise(1)).alias("indexed"))
        # a key without an indexed word, or with one word alone, has no pairs
        sizes = sizes.where("indexed > 0 AND many > 1")
        large = written(sizes.where((F.col("many") > group) & (F.col("size") - F.col("p") - F.col("q") > 1)).select(KEY), "keys")
        again = bool(large.head(1))
        here = keyed.join(large, KEY, "left_anti") if again else keyed
        met = _met(here)
        found = met if found is None else found.unionByName(met)
        if not again:
            return found.distinct()
        keyed = _cut(keyed.join(large, KEY, "left_semi").select("word", "n", "longer", "p", "q"))


def grouped(documents: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, hops: int = 6) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word.

    A form has at least twice its word's n, so a chain of forms is no longer than the logarithm of the largest n; `hops`
    doublings follow 2 ** hops of its links.
    """
    counted = written(words(documents, shortest, least, every), "words")
    pairs = written(near_words(counted), "near")
    ways = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("m")),
    )
    best = F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    of = ways.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    of = of.select("word", "n_near", F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"))
    of = written(of.select("word", "n_near", "f.form", "f.form_n"), "forms")
    root = of.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(hops):
        root = written(root, "roots")
        on = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = root.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return counted.join(of, "word", "left").join(root, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"),
    )


def op12_query(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


#: The same by deletion neighbourhoods, for DuckDB, which has no crc32: its table follows from the polynomial.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, [
    CAST(('0x' || substr(hex(encode(said)), 2 * p + 1, 2)) AS BIGINT) FOR p IN range(octet_length(encode(said)))]),
    lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) + 1 AS BIGINT)]))) AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, CAST(p AS BIGINT) AS p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS MATERIALIZED (
  SELECT w.word, w.n, count(near) AS n_near, first(near ORDER BY m DESC, encode(near)) AS f, first(m ORDER BY m DESC, encode(near)) AS fm
  FROM words w LEFT JOIN near USING (word) GROUP BY w.word, w.n),
forms AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN fm >= 2 * n THEN f END AS form, CASE WHEN fm >= 2 * n THEN fm END AS form_n FROM best),
chain AS (
  SELECT word, word AS last, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT word, n, n_near, form, form_n, last AS root FROM forms JOIN chain USING (word) WHERE next IS NULL
"""
