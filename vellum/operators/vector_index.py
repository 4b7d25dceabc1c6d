"""A collection that is indexed by an inverted file: rows in partitions by their nearest coarse centroid.

A search reads the partitions (lists) that its queries need and no others. `search` probes the lists of the nearest
centroids; with exact=True it then reads every list that could still hold one of a query's k most similar: a list's rows
lie within its radius (the largest angle from its centroid), so none is more similar to a query than the cosine of
the query's angle to the centroid less the radius. Vectors that follow no direction have wide lists and few are ruled out.

Files under a path: vectors (partitioned by list), centroids, and statistics (rows and radius of each list). Centroids are
fitted on at most SAMPLE vectors of COMPONENTS components in all, the rows of smallest hash of their ids; every row is indexed.

Defined cases: similarity is the cosine, 0 where a vector is null, empty, zero, of another length or of no finite length; such vectors are
in list -1. Rows without an id go; of several with one id the greatest by its columns stays. A query that is null or
empty finds nothing, as in vectors.top_k. Queries have distinct ids. An empty table gives an index without centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..sources.scratch import discard, made, written
from .vectors import dealt_top_k

#: Lists at most: what the driver and every task know of an index (centroids, radii) is bounded by it.
LISTS = 1024
SAMPLE = 32_768
COMPONENTS = 1 << 22
ROUNDS = 10
#: Angles are this much wider than computed, for the error of the arc cosine.
SLACK = 1e-6


@dataclass
class Index:
    path: str
    centroids: np.ndarray  # a unit vector for each list
    rows: np.ndarray  # of lists 0, 1, ..., and of list -1 at the end
    radius: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _fitted(rows: DataFrame, lists: int | None) -> np.ndarray:
    """Unit centroids by k-means on the sphere over the sample."""
    sizes = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
    top = sizes.orderBy(F.desc("count"), "d").first()
    if top is None:
        return np.zeros((0, 0))
    d, n = top["d"], top["count"]
    taken = min(SAMPLE, max(1, COMPONENTS // d))
    sample = rows.where(F.size("embedding") == d).orderBy(F.xxhash64("id"), "id").limit(taken).select("embedding").collect()
    x = np.unique(_matrix([r[0] for r in sample], d)[1], axis=0)  # copies would give one place several centroids
    k = min(lists or max(1, round(n**0.5)), LISTS, len(x))
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(ROUNDS if k else 0):
        nearest = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        moved = np.linalg.norm(total, axis=1) > 0
        c[moved] = _unit(total[moved])
    return c


def _matrix(vectors: list, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of d components, and these as unit vectors."""
    at, out = [], []
    for i, v in enumerate(vectors):
        if v is not None and d and len(v) == d and None not in v:
            x = np.asarray(v, dtype=float)
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.dot(x, x)
            if 0 < length < np.inf:
                at.append(i)
                out.append(x)
    return np.array(at, dtype=int), _unit(np.array(out).reshape(len(out), d))


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with __list and __angle, the angle from the list's centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    where = rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            lists, angles = np.full(b.num_rows, -1, dtype=np.int32), np.zeros(b.num_rows)
            at, x = _matrix(b.column(where).to_pylist(), c.shape[1] if len(c) else 0)
            if len(at):
                s = x @ c.T
                lists[at] = s.argmax(axis=1)
                angles[at] = np.arccos(np.clip(s.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists), pa.array(angles)], [*b.schema.names, "__list", "__angle"])

    more = [StructField("__list", IntegerType()), StructField("__angle", DoubleType())]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def _usable(rows: DataFrame) -> DataFrame:
    """One row for each id, embeddings in double precision."""
    others = [c for c in rows.columns if c not in ("id", "embedding")]
    r = rows.where(F.col("id").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"), *(f"`{c}`" for c in others))
    kept = F.max(F.struct("embedding", *(F.col(f"`{c}`") for c in others))).alias("__row")
    return r.groupBy("id").agg(kept).select("id", "__row.*")


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def reset(spark: SparkSession, path: str) -> None:
    """Deletes the index at path, if there is one."""
    files, at = _file(spark, path)
    files.delete(at, True)


def _save_statistics(spark: SparkSession, path: str, schema: StructType) -> None:
    v = spark.read.schema(schema).parquet(f"{path}/vectors")  # a table without rows has no file to tell its schema
    v.groupBy("__list").agg(F.count(F.lit(1)).alias("n"), F.max("__angle").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


def build(rows: DataFrame, path: str, lists: int | None = None) -> Index:
    """An index over rows (id, embedding, more) at path, in place of what is there; about the root of the rows as lists unless given."""
    spark = rows.sparkSession
    since = made()
    usable = written(_usable(rows), "index-rows")
    c = _fitted(usable, lists)
    reset(spark, path)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    # by list and a number, so that a list of many rows isn't one task
    rows = _assigned(usable, c)
    rows.repartition("__list", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("__list").parquet(f"{path}/vectors")
    _save_statistics(spark, path, rows.schema)
    discard(spark, since, made())
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index at path. Only its centroids and statistics are read, of LISTS lists at most."""
    c = [r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]
    centroids = np.array(c) if c else np.zeros((0, 0))
    n, radius = np.zeros(len(c) + 1, dtype=np.int64), np.zeros(len(c) + 1)
    for r in spark.read.parquet(f"{path}/statistics").collect():
        n[r["__list"]], radius[r["__list"]] = r["n"], r["radius"]
    return Index(path, centroids, n, radius)


def vectors_of(spark: SparkSession, index: Index, lists: list[int] | None = None) -> DataFrame:
    """The rows of an index; with lists, of these partitions only."""
    v = spark.read.parquet(f"{index.path}/vectors") if index.rows.any() else None
    if v is None:
        return spark.createDataFrame([], "id string, embedding array<double>, __list int, __angle double")
    return v if lists is None else v.where(F.col("__list").isin(lists))


def upsert(index: Index, rows: DataFrame) -> Index:
    """The index after rows took the place of those with their ids, or were added. Centroids stay.

    Only the lists that rows leave or come to are written again: first to the shared folder, then over the old
    partitions. A driver lost between the two leaves some lists old and some new: repeat the call, which gives the same result.
    """
    spark, since = rows.sparkSession, made()
    new = written(_assigned(_usable(rows), index.centroids), "index-new")
    ids = new.select("id")
    old = vectors_of(spark, index)
    if index.rows.any():
        left = {r[0] for r in old.join(ids, "id", "left_semi").select("__list").distinct().collect()}
        come = {r[0] for r in new.select("__list").distinct().collect()}
        touched = sorted(left | come)
        new = written(vectors_of(spark, index, touched).join(ids, "id", "left_anti").unionByName(new, allowMissingColumns=True), "index-lists")
        have = {r[0] for r in new.select("__list").distinct().collect()}
    else:
        touched, have = [], set()
    out = new.repartition("__list", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite")
    out.partitionBy("__list").option("partitionOverwriteMode", "dynamic").parquet(f"{index.path}/vectors")
    for gone in set(touched) - have:
        reset(spark, f"{index.path}/vectors/__list={gone}")
    _save_statistics(spark, index.path, new.schema)
    discard(spark, since, made())
    return opened(spark, index.path)


def _wanted(queries: DataFrame, index: Index, probes: int, slack: float) -> DataFrame:
    """(query_id, embedding, __list): the lists of the nearest centroids, or, where queries have a __least, the others that can hold a similarity of that or more."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.rows, index.radius))
    second = "__least" in queries.columns
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n, radius = shared.value
        k = len(c)
        for b in batches:
            vs = b.column(1).to_pylist()
            near = np.zeros((len(vs), k + 1))  # of the centroids; 0 for a query that has no direction
            most = np.zeros((len(vs), k + 1))
            at, x = _matrix(vs, c.shape[1] if k else 0)
            if len(at):
                s = np.clip(x @ c.T, -1, 1)
                near[at, :k] = s
                most[at, :k] = np.cos(np.maximum(np.arccos(s) - radius[:k] - SLACK, 0))
            d = c.shape[1] if k else 0
            other = np.array([bool(v) and len(v) != d for v in vs], dtype=bool)
            near[:, k] = np.where(other, 2, -2)
            most[:, k] = np.where(other, 1, 0)
            near[:, n == 0] = -3
            order = np.argsort(-near, axis=1, kind="stable")
            first = np.zeros_like(near, dtype=bool)
            np.put_along_axis(first, order[:, :probes], True, axis=1)
            if second:
                least = b.column(2).to_numpy(zero_copy_only=False)
                take = ~first & (most >= (least - slack)[:, None])
            else:
                take = first
            take &= n > 0
            take[[not v for v in vs]] = False
            r, l = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(np.where(l == k, -1, l).astype(np.int32))],
                ["query_id", "embedding", "__list"],
            )

    cols = ["query_id", "embedding", *(["__least"] if second else [])]
    return queries.select(*cols).mapInArrow(run, f"query_id {kind}, embedding array<double>, __list int")


def _found(wanted: DataFrame, index: Index, k: int, decimals: int | None) -> DataFrame:
    """(query_id, id, similarity): k of each list that a query wants, and more."""
    spark = wanted.sparkSession
    wanted = written(wanted, "index-wanted")
    asked = {r["__list"]: r["count"] for r in wanted.groupBy("__list").count().collect()}  # at most LISTS + 1
    rows = vectors_of(spark, index, sorted(asked)).select("id", "embedding", "__list")
    return dealt_top_k(wanted, rows, k, decimals, {l: (n, int(index.rows[l])) for l, n in asked.items()})


def probes_for(index: Index, spark: SparkSession, k: int, recall: float = 0.95, sample: int = 200) -> int:
    """The fewest lists to probe by which a sample of the index's own rows finds that share of its k most similar others.

    The sample (rows of smallest hash) is searched exactly; the lists of what it found are looked up in each row's own order of lists.
    """
    d = index.dimension
    if not len(index.centroids):
        return 1
    rows = vectors_of(spark, index).where("__list >= 0")
    taken = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding")
    asked = {r.query_id: r.embedding for r in taken.collect()}
    at, x = _matrix(list(asked.values()), d)
    # each row's lists in the order of search: by nearness, without empty ones
    near = np.where(index.rows[:-1] > 0, x @ index.centroids.T, -3)
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    row = dict(zip(asked, place, strict=True))
    queries = spark.createDataFrame([(q, v) for q, v in asked.items()], taken.schema)
    found = search(index, queries, k + 1, exact=True).select("query_id", "id")
    pairs = found.join(rows.select("id", "__list"), "id").where("query_id <> id").collect()  # at most sample * (k + 1)
    depth = sorted(int(row[r.query_id][r["__list"]]) + 1 for r in pairs)
    return depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)] if depth else 1


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, decimals: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): each query's (query_id, embedding) k most similar rows, ties by id.

    probes: the lists that are read for a query (`probes_for` finds how many), a quarter of them unless given; exact also reads all others that could change the result.
    """
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    probes = max(1, -(-len(index.rows) // 4)) if probes is None else probes
    slack = 1e-9 + (0.0 if decimals is None else 10.0**-decimals)
    w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    found = _found(_wanted(q, index, probes, slack), index, k, decimals)
    if exact:
        found = written(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"), "index-found")
        least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("__least"))
        # fewer than k found: any similarity counts
        q = q.join(least, "query_id", "left").withColumn("__least", F.coalesce("__least", F.lit(-2.0)))
        found = found.unionByName(_found(_wanted(q, index, probes, slack), index, k, decimals))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
