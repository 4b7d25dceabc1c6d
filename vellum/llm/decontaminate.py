"""Benchmark decontamination by MinHash containment search.

An item of n distinct five-word shingles is contained in a document that has at least ceil(0.8 n) of them. An item's
MinHash sketch is its n - ceil(0.8 n) + 1 shingles of smallest hash: at least one must be in every document that
contains the item, so the search misses nothing, however long the document.

Items are partitioned by size: n from 2^p to 2^(p+1) - 1 makes partition p, of which two figures are taken from all its items,
the fewest shingles that one of them needs and the greatest rank of a hash in its sketches (large items have sketches of low ranks). A document of m
shingles is searched in the partitions that need m or fewer: of its shingles only those ranked up to the greatest rank of
these partitions meet the sketches, and no item that needs more than m. Rows that share a doc_id are one document, so the
size of one of them says nothing, and it is searched in all partitions. Pairs found are verified by exact containment of the shingle strings.

In the pipeline (clean) items of fewer than five words are also searched as runs of whole words in longer documents.

Only DataFrame functions run. The sketches and the candidate pairs are written to the shared folder, so the planner
knows their true size: it broadcasts them under spark.sql.autoBroadcastJoinThreshold and sorts and merges otherwise.

Defined cases: words are runs of letters and digits, lower-cased; null text is empty; a text of fewer than five words
has one shingle, all of it; an item without words matches nothing; rows with the same doc_id (or item_id) are one
document (or item) with the union of their shingles, rows with a null id one of their own; other columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled_id, own_id, table, written

WORDS = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _at(words: Column, i: Column, f) -> Column:
    return f(*[F.get(words, i + k) for k in range(WORDS)])


def shingles(words: Column, f) -> Column:
    """f(five words) of every shingle; of a shorter text, f(its words)."""
    n = F.size(words)
    short = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(words, " ")))
    if f is not None:
        short = F.transform(short, lambda s: F.xxhash64(s))
        long_ = F.transform(F.slice(words, 1, F.greatest(n - WORDS + 1, F.lit(0))), lambda w, i: _at(words, i, f))
    else:
        long_ = F.transform(
            F.slice(words, 1, F.greatest(n - WORDS + 1, F.lit(0))), lambda w,
            i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WORDS)]),
        )
    return F.when(n >= WORDS, long_).otherwise(short)


def need(n: Column) -> Column:
    """Shingles that an item of n must share: ceil(0.8 n), in integers."""
    return F.floor((n * int(THRESHOLD * 10) + 9) / 10).cast("int")


ITEM = ["item", "unnamed"]


def rank(h: Column) -> Column:
    """What a sketch orders hashes by."""
    return F.xxhash64(h, F.lit(7))


def partitions(sketch: DataFrame) -> list[tuple[int, int]]:
    """(fewest shingles needed, greatest rank) of each size partition; the powers of two under 2^31 bound their number."""
    of = F.floor(F.log2(F.col("n").cast("double"))).alias("p")
    return [(r.least, r.edge) for r in sketch.groupBy(of).agg(F.min("need").alias("least"), F.max(rank(F.col("h"))).alias("edge")).orderBy("p").collect()]


def _contained(docs: DataFrame, own: list[str], benchmark: DataFrame, unite: bool = True) -> DataFrame:
    """own, item, unnamed, n, shared: the items that documents contain. docs: text and the columns that tell documents apart, none of them null.

    unite: rows that agree in own may have different texts.
    """
    items = benchmark.select(
        filled_id("item_id").alias("item"), F.col("item_id").isNull().alias("unnamed"),
        words_of(F.col("text")).alias("w"),
    ).where(F.size("w") > 0)
    items = items.groupBy(ITEM).agg(
        F.array_distinct(F.flatten(F.collect_list(shingles(F.col("w"), None)))).alias("s")
    ).withColumn("n", F.size("s"))
    items = written(items, "items")
    # the hash of a whole short text differs from that of five words; both sides use the same rule
    five = items.select(
        *ITEM, "n", need(F.col("n")).alias("need"),
        F.transform(
            "s",
            lambda s: F.when(
                F.size(F.split(s, " ")) == WORDS, F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(WORDS)]),
            ).otherwise(F.xxhash64(s)),
        ).alias("h"),
    )
    five = five.withColumn("k", F.col("n") - F.col("need") + 1)
    order = F.array_sort(F.transform("h", lambda h: F.struct(rank(h).alias("by"), h.alias("h"))))
    lowest = F.explode_outer(F.slice(order, F.lit(1), F.col("k"))).alias("m")
    sketch = written(five.select(*ITEM, "n", "need", lowest).select(*ITEM, "n", "need", F.col("m.h").alias("h")), "sketch")
    # words are a column of their own: inside the lambdas they would be split again for each shingle
    n = F.size("w")
    m = F.when(n >= WORDS, n - (WORDS - 1)).otherwise(F.signum(n).cast("int"))
    said = docs.select(*own, words_of(F.col("text")).alias("w"))
    if unite:
        several = written(docs.groupBy(*own).count().where("count > 1").select(*own, F.lit(True).alias("several")), "several")
        said = said.join(several, own, "left")
        m = F.when(F.col("several"), F.lit(2**31 - 1)).otherwise(m)
    none = F.lit(None).cast("long")
    edge = F.greatest(none, none, *(F.when(F.col("m") >= least, F.lit(by)) for least, by in partitions(sketch)))
    hashed = said.select(*own, m.alias("m"), shingles(F.col("w"), F.xxhash64).alias("h")).select(*own, "m", edge.alias("edge"), "h")
    # outer: for a plain explode the optimizer infers a filter, which would compute the shingles a second time
    low = hashed.select(*own, "m", "edge", F.explode_outer("h").alias("h")).where(rank(F.col("h")) <= F.col("edge"))
    pairs = low.join(sketch, "h").where(F.col("m") >= F.col("need")).select(*own, *ITEM).distinct()
    pairs = written(pairs, "pairs")
    wanted = docs.join(pairs.select(own).distinct(), own, "left_semi").select(*own, words_of(F.col("text")).alias("w")).select(
        *own, F.array_distinct(shingles(F.col("w"), None)).alias("s"),
    )
    found = wanted.join(pairs, own).join(items.withColumnRenamed("s", "t"), ITEM).select(
        *own, *ITEM, "n", F.array_intersect("t", "s").alias("both"),
    )
    # collected per pair: an item's shingles bound the group for each row; rows of one document are united
    one = found.where(F.size("both") > 0).groupBy(*own, *ITEM).agg(
        F.first("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("both")))).alias("shared"),
    )
    return one.where(F.col("shared") >= need(F.col("n")))


def contained(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair with a containment of 0.8 or more."""
    docs = documents.select(filled_id("doc_id").alias("doc"), F.col("doc_id").isNull().alias("none"), "text")
    return _contained(docs, ["doc", "none"], benchmark).select(
        own_id("doc").alias("doc_id"), own_id("item", "unnamed").alias("item_id"), F.col("n").cast("long").alias("n_item"), F.col("shared").cast("long").alias("n_shared"), (F.col("shared") / F.col("n")).alias("containment")
    )


#: What tells a row of the pipeline from others: its doc_id and its text, by hash and length.
ROW = ["doc", "none", "hash", "size"]


def _keys() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [filled_id("doc_id"), F.col("doc_id").isNull(), F.xxhash64(text), F.length(text)]


def short_items(docs: DataFrame, own: list[str], benchmark: DataFrame) -> DataFrame:
    """own: the documents with a benchmark text of one to four words as a run of whole words."""
    items = benchmark.select(words_of(F.col("text")).alias("w")).where(F.size("w").between(1, WORDS - 1))
    items = written(items.select(F.size("w").alias("n"), F.array_join("w", " ").alias("run")).distinct(), "short")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # at most four
    docs = docs.select(*own, words_of(F.col("text")).alias("w"))
    if not lengths:
        return docs.select(own).where(F.lit(False))

    def runs(n: int) -> Column:
        return F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - (n - 1), F.lit(0))), lambda _,
            i: F.concat_ws(" ", *[F.get(F.col("w"), i + k) for k in range(n)]),
        )

    return docs.select(
        *own, F.explode_outer(F.array_distinct(F.concat(*map(runs, lengths)))).alias("run"),
    ).join(items.select("run"), "run", "left_semi").select(own)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose own text contains no item of the benchmark; rows that share a doc_id, or have none, are judged one by one."""
    docs = documents.select(*(k.alias(c) for k, c in zip(_keys(), ROW, strict=True)), "text")
    found = _contained(docs, ROW, benchmark, False).select(ROW).union(short_items(docs, ROW, benchmark)).distinct()
    found = found.select(*(F.col(c).alias(f"__{c}") for c in ROW))
    same = [k == found[f"__{c}"] for k, c in zip(_keys(), ROW, strict=True)]
    return documents.join(found, same, "left_anti")


def op7_query(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = r"""
SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM (SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM {table})
"""

OP7_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
     b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
     n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
     c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b ON d.s = b.s GROUP BY d.id, b.id)
SELECT c.doc_id, c.item_id, n.n AS n_item, c.shared AS n_shared, c.shared / n.n AS containment
FROM c JOIN n ON c.item_id = n.id WHERE 10 * c.shared >= 8 * n.n
"""
