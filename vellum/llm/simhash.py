"""SimHash near-duplicates by pivot distance tables.

A table holds every distinct fingerprint's Hamming distances to PIVOTS fixed reference fingerprints. By the triangle
inequality two fingerprints at distance d differ by at most d in every coordinate. Fingerprints meet in buckets. There
they are sorted by the first coordinate, so that each one's possible partners are the next few cells of that order;
pairs whose difference is over 3 in any of the other coordinates are discarded, and only survivors' bits are compared.

Buckets: of four blocks of 16 bits one must be equal within 3 differing bits, so a fingerprint is in four buckets, and
no link is lost. A bucket of more than BUCKET fingerprints is dealt anew by the same rule, to four blocks of 12 of its
other 48 bits. Cells of pivot distances alone don't deal a large table: a random pair agrees within 3 in one
coordinate with a chance of 0.46, and a cell 4 wide with its overlap of 3 makes 1.75 copies, so each halving nearly
doubles the rows. A bucket gives the links of a spanning forest, never all its pairs.

Defined cases: null text is empty; a text without words has fingerprint 0 and links like any other; with fewer words
than the shingle length the whole sequence is one shingle; rows with the same doc_id are one node; rows without one
are nodes of their own, and a component of only such rows has no id; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, written

MOST = 3
#: Fingerprints of a bucket above which it is dealt anew.
BUCKET = 4096
#: Fingerprints in buckets, and pairs of them, that a worker takes at once.
ROWS, PAIRS = 100_000, 2_000_000
#: Shingles whose bits are counted at once.
STEP = 100_000
PIVOTS = 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        joined = [b" ".join(w)]
    else:
        joined = [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)]
    count, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(joined), STEP):
        h = np.array([h64(s, seed) for s in joined[at : at + STEP]], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(joined), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *carried, text = b.columns
        fp = np.fromiter((fingerprint(t, words) for t in text.to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*carried, pa.array(fp.view(np.int64))], [*b.schema.names[:-1], "fp"])


def pivot_table(fp: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """A row for each pivot: the distances of all fingerprints to it."""
    refs = np.random.default_rng(20).integers(0, 2**64, n, dtype=np.uint64)
    return np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in refs])


def near_pairs(key: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of one bucket within `most` bits, by portions."""
    table = pivot_table(fp)
    place = key * 128 + table[0]
    order = np.argsort(place, kind="stable")
    place, table, fp = place[order], table[:, order], fp[order]
    n = len(order)
    count = np.searchsorted(place, place + most, side="right") - np.arange(n) - 1
    total, at = np.cumsum(count), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        c = count[at:to]
        a = np.repeat(np.arange(at, to), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        for column in table[1:]:
            ok = np.abs(column[a] - column[b]) <= most
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= most
        yield order[a[ok]], order[b[ok]]
        at = to


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest position of its group, once a[i] and b[i] are in one group."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets in batches sorted by key; a bucket waits for its last row."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forest(key, fp):
        label = np.arange(len(fp))
        for a, b in near_pairs(key, fp.view(np.uint64), most):
            label = united(label, a, b)
        some = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[label[some]])], ["a", "b"])

    for batch in batches:
        key, fp = np.r_[key, batch.column(0).to_numpy()], np.r_[fp, batch.column(1).to_numpy()]
        if len(key) >= ROWS:
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield forest(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
    if len(key):
        yield forest(key, fp)


def _bits(c: Column, lo: int, n: int) -> Column:
    return F.shiftrightunsigned(c, lo).bitwiseAND((1 << n) - 1)


def buckets(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, fp) of every bucket of the distinct fingerprints."""
    fp = F.col("fp")
    dealt = distinct.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _bits(fp, 16 * n, 16).alias("x")) for n in range(4)))).alias("k"),
    ).select("fp", F.col("k.n").alias("n"), (F.col("k.n") * 65536 + F.col("k.x")).alias("key"))
    large = written(dealt.groupBy("key").count().where(F.col("count") > bucket).select("key", F.lit(True).alias("large")), "buckets")  # at most 4 * 2^16 rows
    dealt = dealt.join(F.broadcast(large), "key", "left")
    # the other 48 bits, turned to the low end
    turned = [F.shiftrightunsigned(fp, s).bitwiseOR(F.shiftleft(fp, 64 - s)) if s else fp for s in (16, 32, 48, 0)]
    rest = F.when(F.col("n") == 0, turned[0]).when(F.col("n") == 1, turned[1]).when(F.col("n") == 2, turned[2]).otherwise(turned[3])
    key = F.col("key") * 32768 + (1 << 40)  # apart from the keys of buckets that stay
    again = F.array(*(key + 4096 * (i + 1) + _bits(rest, 12 * i, 12) for i in range(4)))
    return dealt.select(F.explode(F.when(F.col("large"), again).otherwise(F.array(key))).alias("key"), "fp")


def linked(distinct: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """Links a-b between distinct fingerprints (fp): a spanning forest of each bucket."""
    if not 0 <= most <= MOST:
        raise ValueError("the buckets find links of at most 3 differing bits")
    dealt = buckets(distinct, bucket).repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _links(it, most), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id of every row; most: 3 or fewer differing bits."""
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(lambda it: _fingerprints(it, words), "id long, fp long"), "simhash")
    first = rows.groupBy("fp").agg(F.min("id").alias("id"))
    # rows that share a doc_id but not the fingerprint are one document
    same = rows.where("id IS NOT NULL").groupBy("id").agg(
        F.min("fp").alias("b"), F.max("fp").alias("y"),
    ).where("b <> y").join(rows, "id").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    found = components(linked(first.select("fp"), most).unionByName(same))
    group = first.join(found, first.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("group"))
    named = group.groupBy("group").agg(F.min("id").alias("component_id"))
    return rows.join(group.drop("id").join(named, "group").drop("group"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def one_row_of_each(documents: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, one of its smallest doc_id (null is the largest).

    Rows are linked by their fingerprints alone: unlike texts under one doc_id, or without any, are rows of their own
    groups. A row is known by its doc_id and the 64-bit hash of its text; of rows equal in both, the first by the JSON
    of their columns stays.
    """
    own = [
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id")).alias("__id"),
        F.xxhash64(F.col("text").cast("string")).alias("__h"),
    ]
    rows = documents.select(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), own[1].alias("h"),
        F.col("text").cast("string").alias("text"),
    )
    rows = written(rows.mapInArrow(lambda it: _fingerprints(it, 3), "none boolean, id long, h long, fp long"), "simhash")
    first = rows.groupBy("fp").agg(F.min(F.struct(F.struct("none", "id").alias("id"), "h")).alias("first"))
    found = components(linked(first.select("fp")))
    group = first.join(found, first.fp == found.node, "left").groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first"))
    kept = group.select(F.col("first.id").alias("__id"), F.col("first.h").alias("__h"))
    other = [F.col(f"`{c}`") for c in documents.columns]
    row = documents.select(
        *own, F.struct(*other).alias("r"),
        F.to_json(F.struct(*(c for c, f in zip(other, documents.schema) if f.name != "text"))).alias("__by"),
    )
    alike = row.join(kept, ["__id", "__h"], "left_semi")
    return alike.groupBy("__id", "__h").agg(F.min_by("r", "__by").alias("r")).select("r.*")


def op8_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
