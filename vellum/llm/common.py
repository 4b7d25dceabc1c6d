"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import shared_dir
from ..sources.scratch import shuffles_removed as shuffles_removed

#: Stands for a null identifier inside the operators: larger than any other, so it never counts as "smaller".
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled_id(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NO_ID)).cast("long")


def own_id(c: str = "id", none: str = "none") -> Column:
    """The identifier as it was given, by a flag that says whether it was null."""
    return F.when(~F.col(none), F.col(c))


#: Folders of the intermediate tables written so far by this process.
_MADE: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vellum-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many intermediate tables there are so far."""
    return len(_MADE)


def discard(spark: SparkSession, first: int, stop: int) -> None:
    """Deletes intermediate tables number first..stop - 1: call it once all that reads them is saved."""
    jvm = spark.sparkContext._jvm
    for path in filter(None, _MADE[first:stop]):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[first:stop] = [""] * len(_MADE[first:stop])  # numbers stay as they are


def partitions(spark: SparkSession) -> int:
    """Blocks and shards an operator deals its input to; the cluster sizes it with its shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the labelled rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Rows longer than this share of a sample's bytes come last, so that one of them doesn't take the place of many.
LONG = 16


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, sample_bytes: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, y) of labelled rows that aren't held out, and how many there are of each class.

    Per class the sample is the per_class rows of smallest hash, of which come, in that order, as many as sample_bytes
    hold, those longer than a LONG-th of it after all others; texts are whole, and the first row comes whatever its length,
    so that no class is left out. Rows without a label of 0 or 1 don't count; a document that is labelled twice counts once
    for each label.
    """
    y = labels.where(
        F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()
    ).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    drawn = None
    for k in (0, 1):
        one = y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = one if drawn is None else drawn.unionByName(one)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = written(rows, "sample")
    # windows over the sizes of at most 2 * per_class documents
    order = [F.col("size") > sample_bytes // LONG, F.xxhash64("doc_id"), F.col("doc_id"), F.col("size")]
    upto = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.withColumn("size", F.octet_length("text").cast("long")).withColumn("total", F.sum("size").over(upto))
    return total.where((F.col("total") <= sample_bytes) | (F.col("total") == F.col("size"))).select("doc_id", "text", "y"), [counts.get(0, 0), counts.get(1, 0)]


def fit_logistic(x, y, weight, rounds: int = 50, ridge: float = 1e-3):
    """Coefficients of a weighted logistic regression with an intercept, by Newton's method."""
    import numpy as np

    x = np.c_[np.asarray(x, float), np.ones(len(x))]
    b = np.zeros(x.shape[1])
    keep = np.full(len(b), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - keep * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def probability(x, b):
    import numpy as np

    x = np.c_[np.asarray(x, float), np.ones(len(x))]
    return 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))


#: Links of one vertex that a join task takes; beyond that the vertex's links are dealt over many tasks.
HUB = 4_000_000


def _beside(both: DataFrame, low: DataFrame, links: int, hub: int) -> DataFrame:
    """both (u, v) joined with low (u, m, n: links of u)."""
    if links <= hub:  # then no vertex can have more
        return both.join(low.drop("n"), "u")
    hot = written(low.where(F.col("n") > hub).drop("n"), "hubs")  # at most 2 * links / hub rows
    # a written table's size is known: the planner broadcasts it, so that a hub's links stay where they are
    return both.join(hot.select("u"), "u", "left_anti").join(low.drop("n"), "u").unionByName(both.join(hot, "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """(node, component) of every node in the links a-b: component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. on DataFrames: each step takes a minimum for each
    node (combined before the shuffle) and joins it to the node's links, those of a hub without a shuffle. Rounds grow
    with the logarithm of a component's size. Each round is written to the shared folder; the last one's table goes.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    count = F.count(F.lit(1))

    def state() -> tuple:
        return tuple(e.agg(count, F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = state()
    while now[0]:
        before, since = now, made()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), count.alias("n"))
        large = _beside(both, low, before[0], hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), count.alias("n"))
        small = _beside(large, down, before[0], hub).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"),
        ).unionByName(down.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "links")
        now = state()
        discard(spark, since - 1, made() - 1)
        if now == before:
            break
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = star.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("u").alias("node"), "component").unionByName(roots)
