"""Embedding and exact vector search."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import squeeze
from ..sources.scratch import written

DIMENSION = 256
#: Queries that are broadcast at most; more are searched in portions.
QUERIES = 2048
#: Rows that meet a portion of queries in one task, and queries that a task multiplies with them at once.
BLOCK, TOGETHER = 8192, 128


class HashEmbedding:
    """Signed hashed words (two letters or more) and trigrams of longer words, weighted by length, of unit norm; [] without any.

    short: a text without a word of two letters counts its words of one, or its characters where it has no word at all.
    every: every text has a vector: one without any, be it blank or be it that what it counts cancels out, is one word as a whole.
    A word's buckets and weights are worked out once for each worker; a batch of texts is one count over (text, bucket).
    """

    WORD = re.compile(r"[^\W_]+")
    #: Words that a worker remembers, and words of texts that are counted at once.
    MEMO, STEP = 500_000, 200_000

    def __init__(self, dim: int = DIMENSION, short: bool = False, every: bool = False):
        self.dim, self.short, self.every = dim, short, every
        self._clear()

    def __reduce__(self):
        return HashEmbedding, (self.dim, self.short, self.every)

    def _words(self, text: str | None) -> list[str]:
        t = (text or "").lower().replace("ё", "е")
        every = self.WORD.findall(t)
        words = [w for w in every if len(w) >= 2]
        return words or (every or [x for x in t if not x.isspace()] if self.short else words)

    def _clear(self) -> None:
        self.of: dict[str, int] = {}
        self.gram: dict[str, tuple[int, float]] = {}
        self.bucket, self.weight, self.start = array("q"), array("d"), array("q", [0])

    def _signed(self, g: str) -> tuple[int, float]:
        return _hash(g) % self.dim, (1 if _hash("sign::" + g) % 2 == 0 else -1) * (1 + min(len(g), 12) / 12)

    def _learn(self, word: str) -> int:
        found = [self._signed(word)]
        if len(word) >= 4:
            for i in range(len(word) - 2):
                g = word[i : i + 3]
                if g not in self.gram:  # far fewer than words
                    self.gram[g] = self._signed(g)
                found.append(self.gram[g])
        for bucket, weight in found:
            self.bucket.append(bucket)
            self.weight.append(weight)
        self.start.append(len(self.bucket))
        self.of[word] = len(self.start) - 2
        return self.of[word]

    def _sums(self, words: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((w for own in words for w in own), np.int64)
        row = np.repeat(np.arange(len(words)), [len(own) for own in words])
        start = np.array(self.start)
        size = start[flat + 1] - start[flat]
        at = np.repeat(start[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        place = np.repeat(row, size) * self.dim + np.frombuffer(self.bucket, np.int64)[at] if len(at) else at
        weight = np.frombuffer(self.weight, np.float64)[at] if len(at) else np.zeros(0)
        return np.bincount(place, weight, len(words) * self.dim).reshape(len(words), self.dim)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The vectors of some texts; an empty one has none."""
        out, own, total = [], [], 0

        def settle() -> None:
            nonlocal own, total
            if own:
                v = self._sums(own)
                if self.every:
                    for i in np.flatnonzero(~v.any(axis=1)):
                        bucket, weight = self._signed((texts[len(out) + i] or "").lower().replace("ё", "е"))
                        v[i, bucket] = weight
                norm = np.linalg.norm(v, axis=1)
                out.extend(x / n if n else np.zeros(0) for x, n in zip(v, norm, strict=True))
            own, total = [], 0

        for t in texts:
            if len(self.of) > self.MEMO:
                settle()
                self._clear()
            words = self._words(t)
            own.append([self.of[w] if w in self.of else self._learn(w) for w in words])
            total += len(words)
            if total >= self.STEP:
                settle()
        settle()
        return out

    def __call__(self, text: str) -> list[float]:
        return self.batch([text])[0].tolist()


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


hash_embedding = HashEmbedding()


def embedded(texts: DataFrame, key: str, provider: Callable[[str], list[float]] = hash_embedding) -> DataFrame:
    """(key, embedding): the provider's vector of the squeezed text, [] for blank text; one Arrow pass.

    A provider is a function of a text; one with a method batch(texts) is asked for a batch at once.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column(1).to_pylist()
            if hasattr(provider, "batch"):
                v = provider.batch(said)
                flat = np.concatenate(v) if v else np.zeros(0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum([len(x) for x in v])].astype(np.int32)), pa.array(flat, pa.float64()),
                )
            else:
                lists = pa.array([provider(t) if t else [] for t in said], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "embedding"])

    return texts.select(key, squeeze("text").alias("text")).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def with_fallback(first: Callable, second: Callable = hash_embedding) -> Callable:
    """A provider that answers with the second when the first fails."""

    def provider(text: str) -> list[float]:
        try:
            return first(text)
        except Exception:
            return second(text)

    return provider


def add_documents(rows: DataFrame, collection: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows (entity_id, text, embedding) as rows of a collection: empty embeddings go, ids from the entity or the text's hash, ids that exist already go."""
    i = F.when(
        F.coalesce("entity_id", F.lit("")) != "", F.concat(F.lit(collection + ":"), "entity_id"),
    ).otherwise(F.md5(F.concat(F.lit(collection + ":"), "text").cast("binary")))
    out = rows.where(F.size("embedding") > 0).select(i.alias("id"), F.col("text").alias("document"), "embedding")
    return out if existing is None else out.join(existing.select("id"), "id", "left_anti")


def save_collection(rows: DataFrame, path: str) -> None:
    """Adds rows of a collection to the table at path."""
    rows.write.mode("append").parquet(path)


def load_collection(spark, path: str) -> DataFrame | None:
    """The collection at path, by cosine like any other; None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def grown(rows: DataFrame, collection: str, path: str) -> DataFrame:
    """The collection at path after the rows that it hasn't yet were added."""
    spark = rows.sparkSession
    new = add_documents(rows, collection, load_collection(spark, path)).dropDuplicates(["id"])
    save_collection(new, path)
    return spark.read.parquet(path)


def aku_rows(akus: DataFrame) -> DataFrame:
    return akus.where(F.size("embedding") > 0).select(
        "id", "content", "embedding", F.lit("aku").alias("entry_type"), "document_id",
        F.array_join("entities", ",").alias("entities"),
    )


def bridge_rows(facts: DataFrame) -> DataFrame:
    return facts.where(F.size("embedding") > 0).select(
        "id", "content", "embedding", F.lit("bridging_fact").alias("entry_type"), "entity",
        F.array_join("source_document_ids", ",").alias("source_document_ids"),
    )


def top_k(queries: DataFrame, vectors: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) of each query's k most similar vectors by cosine, ties by id; exact.

    Queries (query_id, embedding) are broadcast in portions of QUERIES; a task multiplies its block of vectors with
    them and keeps k for each query, so what is shuffled is k rows per query and task, never all pairs.
    """
    spark = vectors.sparkSession
    q = [
        (r.query_id, r.embedding) for r in queries.select(
            "query_id", F.col("embedding").cast("array<double>").alias("embedding"),
        ).limit(QUERIES + 1).collect()
    ]
    if len(q) > QUERIES:
        # one group of all rows: cut into blocks of rows and portions of queries, which meet as pairs
        wanted, rows = queries.withColumn("__list", F.lit(0)), vectors.select("id", "embedding", F.lit(0).alias("__list"))
        near = dealt_top_k(wanted, rows, k, decimals, {0: (queries.count(), vectors.count())})
        w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    shared = spark.sparkContext.broadcast(q)
    kq, kv = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mats = _matrices(shared.value)
        for b in batches:
            out = _best(mats, b.column(0).to_pylist(), b.column(1).to_pylist(), k, decimals)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], _arrow(kq)), pa.array(out[1], b.schema.field(0).type), pa.array(out[2], pa.float64())],
                ["query_id", "id", "similarity"],
            )

    near = vectors.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"query_id {kq}, id {kv}, similarity double")
    w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealt_top_k(wanted: DataFrame, rows: DataFrame, k: int, decimals: int | None, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(query_id, id, similarity): of each list that a query wants its k most similar rows, and more.

    wanted: query_id, embedding, __list; rows: id, embedding, __list; sizes: queries and rows of each list. A list is dealt
    into blocks of some BLOCK rows, its queries into portions of some QUERIES; a task multiplies one portion with one
    block. What a task holds is bounded however many rows or queries a list has.
    """
    spark = rows.sparkSession
    kq, kv = wanted.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    parts = F.broadcast(
        spark.createDataFrame([(l, -(-q // QUERIES), max(1, -(-n // BLOCK))) for l, (q, n) in sizes.items()], "__list int, __portions int, __blocks int")
    )

    def dealt(df: DataFrame, mine: str, own: str, all_: str, other: str) -> DataFrame:
        one = df.withColumn("embedding", F.col("embedding").cast("array<double>")).join(parts, "__list")
        one = one.withColumn(mine, F.floor(F.rand(11) * F.col(own)).cast("int"))
        return one.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_) - 1))).drop("__portions", "__blocks")

    q = dealt(wanted.select("query_id", "embedding", "__list"), "__portion", "__portions", "__blocks", "__block")
    v = dealt(rows.select("id", "embedding", "__list"), "__block", "__blocks", "__portions", "__portion")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        mats = _matrices(list(zip(left["query_id"].to_pylist(), left["embedding"].to_pylist(), strict=True)))
        out = _best(mats, right["id"].to_pylist(), right["embedding"].to_pylist(), k, decimals)
        return pa.table(
            [pa.array(out[0], left.schema.field("query_id").type), pa.array(out[1], right.schema.field("id").type), pa.array(out[2], pa.float64())],
            ["query_id", "id", "similarity"],
        )

    keys = ["__list", "__block", "__portion"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(meet, f"query_id {kq}, id {kv}, similarity double")


def _packs(df: DataFrame, key: str, most: int) -> DataFrame:
    """(keys, vectors): rows of df, as many as `most` in one; written, for every pack of the other side reads them again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = pa.array(np.r_[np.arange(0, b.num_rows, most), b.num_rows].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, b.column(0)), pa.ListArray.from_arrays(ends, b.column(1))], [key, f"{key}_vectors"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col("embedding").cast("array<double>"))
    return written(rows.mapInArrow(run, f"{key} array<{kind}>, {key}_vectors array<array<double>>"), "packs")


def _whole(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors by length, of those that aren't empty and have no nulls."""
    flat = lists.flatten()
    size = lists.value_lengths().fill_null(0).to_numpy()
    start = np.cumsum(size) - size
    empty = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    values = flat.fill_null(0.0).to_numpy()
    good = (size > 0) & (empty[start + size] == empty[start])
    by = {}
    for d in np.unique(size[good]):
        at = np.flatnonzero(good & (size == d))
        by[int(d)] = at, values[start[at][:, None] + np.arange(d)]
    return by


def cosines(queries: DataFrame, vectors: DataFrame, decimals: int) -> DataFrame:
    """(query_id, id, similarity) of every pair, rounded: 0 for null, empty, zero or differently long vectors, as cosine() has it.

    There are as many rows as pairs, whatever is done. Queries and vectors are written once, in packs of QUERIES at most; packs meet
    without a shuffle, so what is on disk grows with the vectors and not with the pairs. A task multiplies TOGETHER queries with a pack.
    """
    kq, kv = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, right, names, left = (b.column(c) for c in ("id", "id_vectors", "query_id", "query_id_vectors"))
            for n in range(b.num_rows):
                every, y, asked = ids[n].values, _whole(right[n].values), names[n].values
                for first in range(0, len(asked), TOGETHER):
                    some = asked.slice(first, TOGETHER)
                    x = _whole(left[n].values.slice(first, TOGETHER))
                    sim = np.zeros((len(some), len(every)))
                    for d in x.keys() & y.keys():
                        (i, u), (j, v) = x[d], y[d]
                        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                            norm = np.sqrt((u * u).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
                            sim[np.ix_(i, j)] = np.where(norm == 0, 0.0, u @ v.T / norm)
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.take(pa.array(np.repeat(np.arange(len(some)), len(every)))), every.take(pa.array(np.tile(np.arange(len(every)), len(some)))),
                            pa.array(sim.ravel()),
                        ], ["query_id", "id", "similarity"],
                    )

    met = _packs(vectors, "id", QUERIES).crossJoin(_packs(queries, "query_id", QUERIES))
    return met.mapInArrow(meet, f"query_id {kq}, id {kv}, similarity double").withColumn("similarity", F.round("similarity", decimals))


def _matrices(queries: list[tuple]) -> dict[int, tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries that have any, by their length."""
    by: dict[int, list[int]] = {}
    for n, (_, v) in enumerate(queries):
        if v:
            by.setdefault(len(v), []).append(n)
    out = {}
    for d, at in by.items():
        m = np.array([queries[n][1] for n in at], dtype=float)
        out[d] = ([queries[n][0] for n in at], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
    return out


def _best(mats: dict, ids: list, vectors: list, k: int, decimals: int | None) -> tuple[list, list, list]:
    """Query, id and cosine of the k best of a block for each query, ties by id (null first); a cosine that isn't finite is 0."""
    out: tuple[list, list, list] = ([], [], [])
    take = min(k, len(ids))
    if not take:
        return out
    place = np.empty(len(ids), dtype=int)
    place[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, 0 if ids[i] is None else ids[i]))] = np.arange(len(ids))
    length = np.array([len(v) if v else 0 for v in vectors])
    for d, (names, m) in mats.items():
        at = np.flatnonzero(length == d)
        if len(at):
            x = np.array([vectors[i] for i in at], dtype=float)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = (x / np.where(norm > 0, norm, 1)).T
        # some queries at a time: the products of all of them would be a worker's largest piece of memory
        for first in range(0, len(names), TOGETHER):
            some = slice(first, first + TOGETHER)
            sim = np.zeros((len(names[some]), len(ids)))
            if len(at):
                with np.errstate(over="ignore", invalid="ignore"):
                    sim[:, at] = m[some] @ x
                sim[~np.isfinite(sim)] = 0
            if decimals is not None:
                sim = np.round(sim, decimals)
            for name, s in zip(names[some], sim, strict=True):
                i = np.flatnonzero(s >= np.partition(s, -take)[-take])
                i = i[np.lexsort((place[i], -s[i]))][:take]
                out[0].extend([name] * len(i))
                out[1].extend(ids[j] for j in i)
                out[2].extend(s[i].tolist())
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
