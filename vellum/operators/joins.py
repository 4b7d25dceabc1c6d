"""Joins by order: the latest row before another, and the first place that mentions a term. Both meet by equal keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written

#: Rows of one key above which its time is cut into ranges.
HEAVY = 1_000_000


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, tolerance: Column | None = None, prefix: str = "right_", heavy: int = HEAVY,
) -> DataFrame:
    """Every row of left with the latest row of right that has its keys and isn't later; its columns, prefixed, are null if there is none.

    Both sides are united and sorted once, and each row of right is carried to the rows of left behind it. A key with more
    than `heavy` rows is cut into ranges of equal counts (approximate quantiles); each range starts with what the ranges before it end with,
    joined by key and range, so that no key has to fit a task. tolerance: the greatest difference that counts.

    Rows without a key match nothing; of several rows of right at one time the greatest by their columns counts; rows of left that
    are alike stay as they are.
    """
    names = [c for c in right.columns if c not in by]
    mine = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    theirs = F.struct(F.col(on).alias("__on"), *(F.col(f"`{c}`") for c in names if c != on))
    l = left.select(*by, F.col(on).alias("__at"), F.lit(1).alias("__side"), mine.alias("__l"))
    usable = right.where(F.col(on).isNotNull())
    for b in by:
        usable = usable.where(F.col(b).isNotNull())
    r = usable.select(*by, F.col(on).alias("__at"), F.lit(0).alias("__side"), theirs.alias("__r"))
    u = l.unionByName(r, allowMissingColumns=True)
    parts = F.ceil(F.count(F.lit(1)) / heavy).cast("int")
    sizes = written(u.groupBy(*by).agg(parts.alias("__parts")).where("__parts > 1"), "heavy")
    most = sizes.agg(F.max("__parts")).first()[0]
    if most is None:
        u, key = u.withColumn("__range", F.lit(0)), list(by)
    else:
        # every heavy key at the same fractions; as fine as the largest needs
        shares = [i / most for i in range(1, most)]
        hot = u.join(sizes, by, "left_semi").where(F.col("__at").isNotNull())
        cuts = written(hot.groupBy(*by).agg(F.percentile_approx("__at", shares, 10_000).alias("__cuts")), "cuts")
        u = u.join(cuts, by, "left").withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__at"))), F.lit(0))).drop("__cuts")
        key = [*by, "__range"]
    upto = W.partitionBy(*key).orderBy("__at", "__side", "__r").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = u.withColumn("__got", F.last("__r", True).over(upto))
    if most is not None:
        ends = u.join(sizes.select(*by), by, "left_semi").groupBy(*key).agg(F.max("__r").alias("__end"))  # a row for each range
        before = F.last("__end", True).over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
        starts = written(ends.withColumn("__start", before).where("__start IS NOT NULL").drop("__end"), "starts")
        out = out.join(starts, key, "left").withColumn("__got", F.coalesce("__got", "__start"))
    out = out.where("__side = 1")
    if tolerance is not None:
        out = out.withColumn("__got", F.when(F.col("__at") - F.col("__got.__on") <= tolerance, F.col("__got")))
    return out.select("__l.*", F.col("__got.__on").alias(prefix + on), *(F.col(f"__got.`{c}`").alias(prefix + c) for c in names if c != on))


def first_mentions(texts: DataFrame, by: str, pos: str, terms: Column) -> DataFrame:
    """(by, term, first): the smallest position of a text that mentions a term, by one scan; terms: an array of each text's terms."""
    each = texts.select(by, pos, F.explode(F.array_distinct(terms)).alias("term"))
    return each.groupBy(by, "term").agg(F.min(pos).alias("first"))


def mentioned_before(items: DataFrame, mentions: DataFrame, by: str, pos: str) -> DataFrame:
    """Items (by, pos, term) with the first earlier position that mentions their term, null if there is none.

    An equal-key join with one row for each term of a document, whatever the number of texts before an item.
    """
    j = items.join(mentions, [by, "term"], "left")
    return j.withColumn("first", F.when(F.col("first") < F.col(pos), F.col("first")))


# --- containment -----------------------------------------------------------------------------------------------------

#: Bytes of a gram, and grams of a window; a pattern of fewer than GRAM + WINDOW - 1 bytes is short.
GRAM, WINDOW = 8, 16
#: Bytes of a text that are hashed at once.
STEP = 1 << 20


def _hashed(data: bytes, n: int):
    """Hashes of the n bytes (8 at most) that start at each byte."""
    import numpy as np

    if len(data) < n:
        return np.zeros(0, np.uint64)
    wide = np.ndarray((len(data) - n + 1,), "<u8", data + bytes(8), strides=(1,)) << np.uint64(64 - 8 * n)
    h = (wide ^ (wide >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    return h ^ (h >> np.uint64(29))


def minimisers(data: bytes):
    """The distinct smallest hashes of all windows of WINDOW grams: two texts that share such a window share its minimiser."""
    import numpy as np

    out = []
    for at in range(0, max(len(data) - GRAM - WINDOW + 2, 0), STEP):
        h = _hashed(data[at : at + STEP + GRAM + WINDOW - 2], GRAM)
        # the minimum of every window by doubling
        size = 1
        while 2 * size <= WINDOW:
            h, size = np.minimum(h[:-size], h[size:]), 2 * size
        out.append(np.unique(h))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _keys(batches, short: tuple[int, ...], pattern: bool):
    """(id, n, key) of patterns (one each) or texts (all of theirs): n is 0 for minimisers, else a short pattern's length."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids, ns, keys = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            if pattern:
                long = len(data) >= GRAM + WINDOW - 1
                own = [(0, minimisers(data[: GRAM + WINDOW - 1]))] if long else [(min(len(data), 8), _hashed(data[:8], min(len(data), 8)))] if data else []
            else:
                own = [(0, minimisers(data)), *((n, np.unique(_hashed(data, n))) for n in short)]
            for n, h in own:
                ids += [i] * len(h)
                ns += [n] * len(h)
                keys.append(h)
        got = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(ns, pa.int32()), pa.array(got)], ["id", "n", "key"])


def containing(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text): the ids of patterns (id, text) and of the texts (id, text) that contain them, byte for byte; ids are unique.

    A long pattern is looked up by the minimiser of its first window, of which a text has one in some eight places; a short one
    by its first bytes, of which texts have all, but only at the lengths that patterns have. Equal keys are proposals; the texts
    decide. Null and empty patterns are in no text; null texts contain nothing.
    """
    kind = lambda df: df.schema["id"].dataType.simpleString()
    p = written(
        patterns.select("id", F.col("text").cast("string")).mapInArrow(lambda it: _keys(it, (), True), f"id {kind(patterns)}, n int, key long"), "patterns",
    )
    short = tuple(sorted(r.n for r in p.where("n > 0").select("n").distinct().collect()))  # eight lengths at most
    found = texts.select("id", F.col("text").cast("string")).mapInArrow(lambda it: _keys(it, short, False), f"id {kind(texts)}, n int, key long")
    met = found.join(p.withColumnRenamed("id", "pattern"), ["n", "key"]).select("pattern", F.col("id").alias("text")).distinct()
    met = met.join(patterns.select(F.col("id").alias("pattern"), F.col("text").alias("__p")), "pattern")
    met = met.join(texts.select(F.col("id").alias("text"), F.col("text").alias("__t")), "text")
    return met.where(F.contains(F.col("__t"), F.col("__p"))).select("pattern", "text")
