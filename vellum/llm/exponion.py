"""Centroid clustering of integer vectors by exponion search.

A vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to any other one.
Where the upper bound is below the lower one, or below half the way from its centroid to the next, nothing is computed.
Else the upper bound is made exact, and where that doesn't settle it, only the centroids inside a ball around the own
centroid are scanned: radius 2u + s, with u the distance to the own centroid and s the way from that to the next one. The
ball holds the two nearest centroids of the vector (triangle inequality); it is found by bisection in the sorted list of
distances from the own centroid, radius included, so that ties are scanned too. Vectors and centroids are integers and
squared distances exact; bounds are rounded outwards by SLACK.

Vectors lie in blocks of at most BLOCK, dealt once by block number into a table bucketed by it. A round reads that table and
the bounds of the round before, bucketed alike, so that no vector is shuffled again; it writes the new bounds and, for
each task, one row of sums for each centroid. The driver gets the total for each centroid and nothing else. Bounds of a
round are deleted once the next ones are written.

Defined cases: a row takes part if its vector has exactly `dim` components, none null or non-finite, and all below 2^17
(LIMIT / SCALE) in size, since a squared distance must fit a long; other rows aren't in the result. Rows that share a vec_id
are rows of their own and start in the order of their components; a null vec_id stays null and starts last. With fewer rows than k, there
are as many centroids. A tie goes to the smaller number; an empty centroid stays where it is. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from .common import discard, made, partitions, table, written

#: Vectors of a block.
BLOCK = 8192
SCALE = 1024
#: Integer components are smaller in size, so that a squared distance of 64 of them fits a long.
LIMIT = 2**27
SLACK = 1e-9


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Arrays of (vec_id, int32 components) of the rows that take part."""
    for b in batches:
        fit = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False)
        b = b.filter(fit)
        x = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * x)
            good = (np.abs(x) < LIMIT).all(axis=1)  # false for nan and inf
        ids, x = b.column(0).filter(pa.array(good)), x[good].astype("<i4")
        for at in range(0, len(x), BLOCK):
            part = ids[at : at + BLOCK]
            lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
            yield pa.RecordBatch.from_arrays([lists, pa.array([x[at : at + BLOCK].tobytes()], pa.binary())], ["ids", "v"])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c (one, or as many as x)."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Integer centroids with, for each, the others sorted by their distance."""

    def __init__(self, at: np.ndarray):
        self.at, k = at.astype(np.int64), len(at)
        way = np.sqrt(np.stack([squared(self.at, c) for c in self.at]).astype(float))
        self.order = np.argsort(way, axis=1, kind="stable")
        self.sorted = np.take_along_axis(way, self.order, axis=1)
        other = way + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.next = other.min(axis=1)

    def search(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Makes own, upper and lower those of these centroids, in place; gives the count of distances worked out."""
        half = self.next[own] / 2 * (1 - SLACK)
        rows = np.flatnonzero(upper >= np.maximum(lower, half))
        upper[rows] = np.sqrt(squared(x[rows], self.at[own[rows]]).astype(float)) * (1 + SLACK)
        work = len(rows)
        rows = rows[upper[rows] >= np.maximum(lower[rows], half[rows])]
        for a in np.unique(own[rows]):
            of = rows[own[rows] == a]
            radius = (2 * upper[of] + self.next[a]) * (1 + SLACK)
            many = np.searchsorted(self.sorted[a], radius, side="right")  # an inclusive ball
            for m in np.unique(many):
                some = of[many == m]
                near = np.sort(self.order[a, :m])
                d = np.stack([squared(x[some], self.at[c]) for c in near], axis=1)
                work += d.size
                best = d.argmin(axis=1)  # the smallest number among ties
                own[some] = near[best]
                upper[some] = np.sqrt(d[np.arange(len(some)), best].astype(float)) * (1 + SLACK)
                d[np.arange(len(some)), best] = np.iinfo(np.int64).max
                # of fewer than two centroids there is no second; every other one lies outside the ball
                second = d.min(axis=1)
                lower[some] = np.where(second < np.iinfo(np.int64).max, np.sqrt(second.astype(float)) * (1 - SLACK), np.inf)
        return work


def moved(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, way: np.ndarray) -> None:
    """Bounds after each centroid has gone `way`."""
    most = np.argsort(way)[::-1]
    upper += way[own] * (1 + SLACK)
    other = np.where(own == most[0], way[most[1]] if len(way) > 1 else 0.0, way[most[0]])
    lower -= other * (1 + SLACK)


def _round(batches: Iterator[pa.RecordBatch], dim: int, at: np.ndarray, way: np.ndarray | None, last: bool) -> Iterator[pa.RecordBatch]:
    """A row of bounds for each block, and for each centroid a row of the task's sums; last: own and distance instead of bounds."""
    centroids, k = Centroids(at), len(at)
    total, count, block = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), None
    for b in batches:
        out = []
        for number, v, state in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(v, "<i4").reshape(-1, dim)
            if state is None:  # the first round knows nothing
                own, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                own = np.frombuffer(state[: 4 * len(x)], "<i4").copy()
                upper, lower = np.frombuffer(state[4 * len(x) :], "<f8").reshape(2, -1).copy()
                moved(own, upper, lower, way)
            centroids.search(x, own, upper, lower)
            block = number
            if last:
                out.append((number, own.astype("<i4").tobytes() + squared(x, centroids.at[own]).astype("<i8").tobytes()))
                continue
            out.append((number, own.astype("<i4").tobytes() + upper.tobytes() + lower.tobytes()))
            for c in np.unique(own):
                of = own == c
                total[c] += x[of].sum(axis=0, dtype=np.int64)
                count[c] += of.sum()
        yield _rows([n for n, _ in out], [s for _, s in out], None, None, None)
    if block is not None and not last:
        some = np.flatnonzero(count)
        yield _rows([block] * len(some), None, some, total[some].tolist(), count[some])


def _rows(block: list, state: list | None, cluster, total, count) -> pa.RecordBatch:
    n = len(block)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block, pa.int64()), pa.array(state or [None] * n, pa.binary()),
            pa.array(cluster, pa.int32()) if cluster is not None else pa.nulls(n, pa.int32()),
            pa.array(total, pa.list_(pa.int64())) if total is not None else pa.nulls(n, pa.list_(pa.int64())),
            pa.array(count, pa.int64()) if count is not None else pa.nulls(n, pa.int64()),
        ],
        ["block", "state", "cluster", "total", "count"],
    )


class _Bucketed:
    """Tables bucketed by block in the shared folder: joins of two of them shuffle neither."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets = spark, buckets

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        name = f"vellum_blocks_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "block").write.bucketBy(self.buckets, "block").option(
            "path", f"{shared_dir(self.spark).rstrip('/')}/{name}",
        ).format("parquet").saveAsTable(name)
        return name, self.spark.table(name)

    def drop(self, name: str) -> None:
        where = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _members(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, state in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(np.frombuffer(state[: 4 * n], "<i4")), pa.array(np.frombuffer(state[4 * n :], "<i8"))],
                ["vec_id", "cluster", "distance"],
            )


def _starts(batches: Iterator[pa.RecordBatch], dim: int, k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The k rows of a task that start first: (absent, order, components)."""
    best: list = []
    for b in batches:
        for ids, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(v, "<i4").reshape(-1, dim)
            own = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", n) for n, i in enumerate(ids)]
            edge = sorted(own)[:k]
            # rows of one vec_id rank by their components
            own = [o[:2] + (x[o[2]].tolist(),) for o in own if o[:2] <= edge[-1][:2]]
            best = sorted(best + own)[:k]
    columns = list(zip(*best, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int32()))],
        ["absent", "start", "v"],
    )


def _totals(sums: DataFrame, dim: int) -> list:
    """A row for each centroid that isn't empty: its number, its count and the exact sum of each component."""
    part = [F.sum(F.element_at("total", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    return sums.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("count").alias("count"), *part).collect()


def clustered(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3, buckets: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row that takes part, as a written table, and the final centroids."""
    spark = embeddings.sparkSession
    store = _Bucketed(spark, buckets or partitions(spark))
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = rows.mapInArrow(lambda it: _blocks(it, dim), f"ids array<{kind}>, v binary").withColumn("block", F.monotonically_increasing_id())
    first = made()
    name, blocks = store.write(written(blocks, "blocks"))
    discard(spark, first, made())
    starts = blocks.select("ids", "v").mapInArrow(lambda it: _starts(it, dim, k, seed), "absent boolean, start string, v array<int>")
    at = np.array([r.v for r in starts.orderBy("absent", "start", "v").limit(k).collect()], np.int64).reshape(-1, dim)
    sums = "block long, state binary, cluster int, total array<long>, count long"
    before, state, way = None, None, None
    for turn in range(rounds + 1 if len(at) else 0):
        last = turn == rounds
        if state is None:
            both = blocks.select("block", "v", F.lit(None).cast("binary").alias("state"))
        else:
            both = blocks.join(state.where("state IS NOT NULL").select("block", "state"), "block").select("block", "v", "state")
        # at and way are those of this turn
        done = both.mapInArrow(lambda it, at=at, way=way, last=last: _round(it, dim, at, way, last), sums)
        now, state = store.write(done)
        if before:
            store.drop(before)
        before = now
        if last:
            break
        new = [[int(x) for x in c] for c in at]
        for r in _totals(state, dim):
            new[r.cluster] = [int(r[f"s{i}"]) // r["count"] for i in range(dim)]
        way = np.sqrt(squared(np.array(new, np.int64), at).astype(float))
        at = np.array(new, np.int64)
    members = f"vec_id {kind}, cluster int, distance long"
    if not before:
        out = spark.createDataFrame([], members)
    else:
        both = blocks.join(state.select("block", "state"), "block").select("ids", "state")
        out = written(both.mapInArrow(lambda it: _members(it, dim), members), "clusters")
        store.drop(before)
    store.drop(name)
    return out, at


def clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, the cluster's and the whole inertia, and the hash of the final centroid."""
    members, at = clustered(embeddings, k, rounds, dim, seed)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    sums = {r.cluster: r.s for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())

    def of(values: dict, kind: str):
        return F.element_at(F.create_map(*(x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast(kind)))), F.col("cluster"))

    if not sums:
        empty = F.lit(None).cast("long")
        return members.select("*", empty.alias("cluster_inertia"), empty.alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    return members.select(
        "vec_id", "cluster", "distance", of(sums, "long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"),
        of(dict(enumerate(digest)), "string").alias("centroid_sha256"),
    )


def op11_query(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    """The same by plain assignment to all centroids, for DuckDB: a row for each component."""
    kept = f"""
kept AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim}),
v AS MATERIALIZED (
  SELECT r, vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dim} + 1) t(i)),
c0 AS MATERIALIZED (
  SELECT c, i, x FROM v JOIN (
    SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}) USING (r))"""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS MATERIALIZED (
  SELECT v.r, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} c USING (i) GROUP BY v.r, c.c),
a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM v JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN m IS NULL THEN x ELSE (s - ((s % m) + m) % m) // m END AS x FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return f"""WITH {kept.strip()},{','.join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)"""


OP11_SQL = _sql()
