"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

Index: k-means on a sample gives coarse centroids (about the square root of the number of vectors, LISTS at most). Every
vector goes to the list of its nearest centroid, and what the centroid leaves over, the residual, is coded by the nearest
of CODES codewords in each of the subspaces. Search: a query's nearest lists are probed. Its asymmetric distance table has
the product of each of its parts with each codeword, so that the distance to a coded vector, |q - c|^2 - 2 q.r + (r.r + 2 c.r),
takes a look-up for each subspace and a number kept with the code. The SHORTLIST best are ranked again by exact distances to the original
vectors.

How many lists are probed and how long the shortlist is comes from the sample, by brute force on CALIBRATE of its members: the
least that find TARGET of their 10 nearest in it each. The sample has about SAMPLE vectors of each dimension (all, if fewer; those whose
hash is small), so fitting is bounded; all vectors are indexed.

Spark deals the work: equal vectors are one, with the k + 1 smallest of their ids (more can't be among k nearest), found by
a window limited before the shuffle, so that a hot vector stays small. Lists are gathered into blocks of about BLOCK codes, large lists
cut into parts; a query goes once to each block that it probes, in portions of PORTION queries, and each block answers with its shortlist for
the query. Nothing but the sample's models and the sizes of lists (both bounded by LISTS for each dimension) reaches the driver.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths aren't compared (each length has an index); a query's own row isn't its candidate, while other rows of its vec_id
are; rows that share a vec_id are queries of their own, and their results rows of their own; a null vec_id is no query, and
ranks behind all others in ties; fewer candidates than k give all; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, table, written

LISTS, CODES, SUBSPACES = 2048, 256, 64
#: Vectors of a dimension's sample; of long vectors fewer, so that it has NUMBERS components.
SAMPLE, NUMBERS = 32_768, 1 << 22
CALIBRATE, TARGET = 256, 0.985
BLOCK, PORTION = 65_536, 1024
ROUNDS = 8


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest row of c for each row of x."""
    norm = (c * c).sum(axis=1)
    step = max(1, (1 << 22) // len(c))
    return np.concatenate([(norm - 2 * (x[at : at + step] @ c.T)).argmin(axis=1) for at in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of x, which has k rows or more, by ROUNDS of Lloyd's method; an empty one stays."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        some, at = np.unique(own[order], return_index=True)
        c[some] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.r_[at, len(x)])[:, None]
    return c


class Index:
    """Coarse centroids, codebooks, and what calibration says of a dimension's sample."""

    def __init__(self, x: np.ndarray, count: int, k: int):
        dim = x.shape[1]
        # of usual vectors, so that a few huge ones don't make all others zero
        self.scale = float(np.median(np.abs(x).max(axis=1)))
        x = self.scaled(x)
        self.coarse = kmeans(x, min(len(x), LISTS, max(1, round(np.sqrt(count)))), 1)
        cuts = np.linspace(0, dim, min(SUBSPACES, -(-dim // 2)) + 1).astype(int)
        self.parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        rest = x - self.coarse[nearest(x, self.coarse)]
        some = rest[: 1 << 14]
        self.books = [kmeans(some[:, a:b], min(CODES, len(some)), 2) for a, b in self.parts]
        self.probes, self.shortlist = len(self.coarse), len(x)
        self._calibrate(x, k)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x / self.scale, -1e15, 1e15).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, r.r + 2 c.r) of scaled vectors; r is the residual as its codes say."""
        own = nearest(x, self.coarse)
        c = self.coarse[own]
        codes = np.stack([nearest(x[:, a:b] - c[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], axis=1)
        r = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), (r * (r + 2 * c)).sum(axis=1, dtype=np.float64)

    def ways(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coarse centroids."""
        q, c = q.astype(np.float64), self.coarse.astype(np.float64)
        return np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * q @ c.T, 0)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each subspace, query and codeword their product."""
        return np.stack([q[:, a:b] @ np.pad(book, ((0, CODES - len(book)), (0, 0))).T for (a, b), book in zip(self.parts, self.books, strict=True)])

    @staticmethod
    def products(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of one query (its tables) with coded residuals."""
        out = np.zeros(len(codes), np.float32)
        for own, column in zip(tables, codes.T, strict=True):
            out += own[column]
        return out

    def _calibrate(self, x: np.ndarray, k: int) -> None:
        pick = np.random.default_rng(3).choice(len(x), min(CALIBRATE, len(x)), replace=False)
        if len(x) <= k + 1:
            return
        q = x[pick]
        d = (x * x).sum(axis=1) - 2 * (q @ x.T)
        d[np.arange(len(q)), pick] = np.inf
        true = np.argpartition(d, k - 1, axis=1)[:, :k]
        own, codes, added = self.encode(x)
        ways = self.ways(q)
        rank = np.empty_like(ways, dtype=np.int64)
        np.put_along_axis(rank, np.argsort(ways, axis=1, kind="stable"), np.arange(ways.shape[1])[None].repeat(len(q), 0), axis=1)
        wanted = np.sort(rank[np.arange(len(q))[:, None], own[true]].ravel())
        at = min(len(wanted) - 1, int(np.ceil(TARGET * len(wanted))) - 1)
        self.probes = int(wanted[at]) + 1
        tables, places = self.tables(q), []
        for i in range(len(q)):
            far = ways[i][own] + added - 2 * self.products(tables[:, i], codes)
            far[pick[i]] = np.inf
            places.append(np.searchsorted(np.sort(far), far[true[i]]))
        self.shortlist = max(4 * k, 2 * (int(np.sort(np.concatenate(places))[at]) + 1))


def _stacked(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fitted(vectors: DataFrame, k: int, sample: int = SAMPLE) -> dict[int, Index]:
    """An index model for each dimension, fitted in a task each."""
    counts = written(vectors.groupBy("dim").count(), "dimensions")

    def fit(t: pa.Table) -> pa.Table:
        model = Index(_stacked(t.sort_by("uid").column("v")), t.column("count")[0].as_py(), k)
        return pa.table([t.column("dim").slice(0, 1), pa.array([pickle.dumps(model)], pa.binary())], ["dim", "model"])

    most = F.least(F.lit(sample), F.ceil(F.lit(NUMBERS) / F.col("dim")))
    drawn = vectors.join(counts, "dim").where(F.pmod(F.xxhash64("uid", F.lit(7)), F.col("count")) < most)
    models = drawn.select("dim", "count", "uid", "v").groupBy("dim").applyInArrow(fit, "dim int, model binary")
    return {r.dim: pickle.loads(r.model) for r in models.collect()}  # a model is no larger than its sample


def _encoded(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, rows in _by_dim(b):
            if dim in models.value:
                own, codes, added = models.value[dim].encode(models.value[dim].scaled(_stacked(rows.column("v"))))
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("dim"), rows.column("uid"), pa.array(own.astype(np.int32)), code.cast(pa.binary()), pa.array(added)],
                    ["dim", "uid", "list", "code", "added"],
                )


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dim = b.column(b.schema.get_field_index("dim")).to_numpy()
    for d in np.unique(dim):
        yield int(d), b.filter(pa.array(dim == d))


def _probed(batches: Iterator[pa.RecordBatch], models, places: dict) -> Iterator[pa.RecordBatch]:
    """(qid, dim, block, v): a query for each block that has a list it probes."""
    for b in batches:
        out: list = []
        for dim, rows in _by_dim(b):
            if dim not in places:
                continue
            model, (size, first, parts, need) = models.value[dim], places[dim]
            order = np.argsort(model.ways(model.scaled(_stacked(rows.column("v")))), axis=1, kind="stable")
            for i, own in enumerate(order):
                # at least that many vectors, where there are so many
                enough = int(np.searchsorted(np.cumsum(size[own]), need)) + 1
                own = own[: max(model.probes, enough)]
                own = own[size[own] > 0]
                blocks = np.unique(np.concatenate([np.arange(first[a], first[a] + parts[a]) for a in own] or [np.zeros(0, np.int64)]))
                out += [(rows.column("qid")[i].as_py(), dim, int(x), own.astype("<i4").tobytes(), rows.column("v")[i].as_py()) for x in blocks]
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        yield _batch(out)


def _batch(out: list) -> pa.RecordBatch:
    c = list(zip(*out, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], ["qid", "dim", "block", "lists", "v"])


def _search(codes: pa.Table, queries: pa.Table, models) -> pa.Table:
    """The block's best coded vectors for each query, by asymmetric distances."""
    found: list = []
    if codes.num_rows and queries.num_rows:
        model = models.value[queries.column("dim")[0].as_py()]
        codes = codes.sort_by([("list", "ascending"), ("uid", "ascending")])
        own, uid, added = (codes.column(c).to_numpy() for c in ("list", "uid", "added"))
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(uid), -1)
        q = model.scaled(_stacked(queries.column("v")))
        ways, tables = model.ways(q), model.tables(q)
        for i, qid in enumerate(queries.column("qid").to_pylist()):
            probed = np.zeros(len(model.coarse), bool)
            probed[np.frombuffer(queries.column("lists")[i].as_py(), "<i4")] = True
            rows = np.flatnonzero(probed[own])
            far = ways[i][own[rows]] + added[rows] - 2 * model.products(tables[:, i], code[rows])
            best = np.lexsort((uid[rows], far))[: model.shortlist] if len(far) <= 4 * model.shortlist else _least(far, uid[rows], model.shortlist)
            found.append((np.full(len(best), qid), uid[rows[best]], far[best]))
    c = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(x) for x in c], ["qid", "uid", "far"])


def _least(far: np.ndarray, uid: np.ndarray, n: int) -> np.ndarray:
    edge = np.partition(far, n - 1)[n - 1]
    some = np.flatnonzero(far <= edge)
    return some[np.lexsort((uid[some], far[some]))[:n]]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, rows in _by_dim(b):
            d = np.abs(_stacked(rows.column("q")) - _stacked(rows.column("v")))
            with np.errstate(over="ignore", under="ignore"):
                most = d.max(axis=1)
                plain = np.sqrt((d * d).sum(axis=1))
                odd = (most > 1e150) | (most < 1e-150) & (most > 0)
                plain[odd] = most[odd] * np.sqrt(((d[odd] / most[odd, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([rows.column("qid"), rows.column("uid"), pa.array(plain)], ["qid", "uid", "score"])


def neighbours(embeddings: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0),
        F.lit(False),
    )
    rows = embeddings.where(good).select(F.col("vec_id").alias("id"), v.alias("v"))
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))).where(F.col("n") <= k + 1)
    kept = kept.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("ids"))  # k + 1 at most
    vectors = kept.select(F.monotonically_increasing_id().alias("uid"), F.size("v").alias("dim"), "v", F.col("ids.id").alias("ids"))
    vectors = written(vectors, "vectors")
    models = spark.sparkContext.broadcast(fitted(vectors, k, sample))
    codes = vectors.select("dim", "uid", "v").mapInArrow(lambda it: _encoded(it, models), "dim int, uid long, list int, code binary, added double")
    codes = written(codes, "codes")
    # lists' sizes are as few as lists
    sizes = codes.groupBy("dim", "list").count().collect()
    size_of = max(4096, min(block, -(-sum(r["count"] for r in sizes) // partitions(spark))))
    places, first = {}, 0
    for dim, model in sorted(models.value.items()):
        n = np.zeros(len(model.coarse), np.int64)
        for r in sizes:
            if r.dim == dim:
                n[r.list] = r["count"]
        parts, at, room = np.maximum(-(-n // size_of), 1), np.zeros(len(n), np.int64), 0
        for a in range(len(n)):
            if n[a] > room or parts[a] > 1:
                first, room = first + 1, size_of
            at[a] = first
            if parts[a] > 1:
                first, room = first + int(parts[a]) - 1, 0
            else:
                room -= int(n[a])
        first += 1
        places[dim] = (n, at, parts, 4 * (k + 1))
    queries = rows.where(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("qid"), F.size("v").alias("dim"), "id", F.col("v").alias("q"))
    queries = written(queries, "queries")
    asked = queries.select("qid", "dim", F.col("q").alias("v")).mapInArrow(
        lambda it: _probed(it, models, places), "qid long, dim int, block long, lists binary, v array<double>",
    )
    asked = written(asked, "probes")
    shares = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions"))
    asked = asked.join(shares, "block").withColumn("portion", F.pmod(F.xxhash64("qid"), F.col("portions")).cast("int")).drop("portions")
    where = [(dim, a, int(at[a]), int(parts[a])) for dim, (_, at, parts, _) in places.items() for a in range(len(at))]
    place = spark.createDataFrame(where, "dim int, list int, first long, parts int")  # as many rows as lists
    coded = codes.join(F.broadcast(place), ["dim", "list"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    coded = coded.join(shares, "block").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    coded = coded.select("block", "portion", "list", "uid", "code", "added")
    met = coded.groupBy("block", "portion").cogroup(asked.groupBy("block", "portion")).applyInArrow(
        lambda c, q: _search(c, q, models), "qid long, uid long, far double",
    )
    short = spark.createDataFrame([(d, m.shortlist) for d, m in models.value.items()], "dim int, short int")
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("far", "uid")))
    longest = max((m.shortlist for m in models.value.values()), default=1)
    met = met.where(F.col("place") <= longest).join(queries.select("qid", "dim"), "qid").join(F.broadcast(short), "dim").where("place <= short")
    best = written(met.select("qid", "uid"), "shortlists")
    pairs = best.join(queries.select("qid", "dim", "q"), "qid").join(vectors.select("uid", "v"), "uid")
    scored = pairs.select("qid", "uid", "dim", "q", "v").mapInArrow(_measured, "qid long, uid long, score double")
    near = scored.join(queries.select("qid", "id", "q"), "qid").join(vectors.select("uid", "v", "ids"), "uid")
    # the query's own row is one of its vector's
    own = F.array_position("ids", F.col("id")).cast("int")
    others = F.when((F.col("q") == F.col("v")) & (own > 0), F.concat(F.slice("ids", F.lit(1), own - 1), F.slice("ids", own + 1, k + 1))).otherwise(F.col("ids"))
    each = near.select("qid", "id", "score", F.explode(others).alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", F.col("vec_id").asc_nulls_last()))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_query(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
