"""Suffix-array substring dedup by threshold-bounded interval expansion.

The frame of anchors.py brings all equal 50-byte strings that occur in two documents to one shard, as segments. A
shard lays out its segments one after another, sorts their suffixes by their first symbols (as many as matter), takes
the Burrows-Wheeler transform and derives the common-prefix array by increasing value: an interval of suffixes that
share a string w is extended backward by each symbol c that precedes it, which gives the interval of cw by the
transform's last-to-first mapping. The first interval that ends at a position fixes the common prefix there to the
length of w, and only such intervals are queued, breadth first. The expansion stops at the minimum length: positions
not fixed by then have a common prefix of at least that length, so maximal runs of them are exactly the repeated
strings. Groups of equal anchors are independent, so a shard works through them in portions of bounded size.

Defined cases: null text is empty; rows with the same doc_id are one document; a null doc_id ranks with the largest
long (rows of either are one document) and stays null; texts shorter than the minimum length lose nothing; other columns are ignored; an empty table gives an empty
result. In text() a character goes only if all its bytes go, so the text stays valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from . import anchors as A
from .common import filled_id, own_id, partitions

MIN_LENGTH = 50
GRAM = 16
#: Symbols of a portion; a group of one anchor that is larger makes a portion of its own.
PORTION = 300_000
#: Blocks for each shuffle partition: a block's arrays, some ten times its text, are held at once. A block
#: answers each shard with a row, so more blocks mean more rows.
BLOCKS = 2


def suffix_order(sym: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, keys of the first symbols in that order, how many): positions sorted by their next `depth` symbols at least."""
    n = len(sym)
    used, code = np.unique(sym, return_inverse=True)
    wide = max(1, int(len(used)).bit_length())
    slot = max(1, int(n - 1).bit_length())
    have = max(1, (63 - slot) // wide)
    key, c = np.zeros(n, np.uint64), np.r_[code, np.zeros(have, code.dtype)].astype(np.uint64)
    for i in range(have):
        key = (key << np.uint64(wide)) | c[i : i + n]
    low = np.uint64((1 << slot) - 1)
    first, slots = have, np.uint64(slot)
    packed = np.sort((key << slots) | np.arange(n, dtype=np.uint64))
    order, head = (packed & low).astype(np.int64), packed >> slots
    rank = np.empty(n, np.uint64)
    value = head
    while True:
        new = np.r_[False, value[1:] != value[:-1]]
        up = np.cumsum(new).astype(np.uint64)
        if have >= depth or up[-1] == n - 1:
            return order, head, first
        rank[order] = up
        nxt = np.zeros(n, np.uint64)
        nxt[: n - have] = rank[have:] + np.uint64(1) if n > have else 0
        if 3 * slot + 1 <= 64:
            packed = np.sort((((rank << np.uint64(slot + 1)) | nxt) << slots) | np.arange(n, dtype=np.uint64))
            order, value = (packed & low).astype(np.int64), packed >> slots
        else:
            key = (rank << np.uint64(32)) | nxt
            order = np.argsort(key, kind="stable")
            value = key[order]
        # head stays that of the first symbols: ties broken later keep their place among them
        have *= 2


def common_prefixes(sym: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, prefix): prefix[i] is the common prefix of the suffixes order[i - 1] and order[i], or -1 for least or more."""
    n = len(sym)
    order, head, known = suffix_order(sym, least)
    known = min(known, least)
    # the first level: common prefixes of fewer than `known` symbols, from the sorted keys
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    s = np.r_[sym, np.full(known, -1, sym.dtype)]
    at = np.flatnonzero(np.r_[False, head[1:] != head[:-1]])
    same = np.zeros(len(at), np.int16)
    alive = np.ones(len(at), bool)
    for i in range(known):
        alive &= s[order[at] + i] == s[order[at - 1] + i]
        same += alive
    at, same = at[~alive], same[~alive]  # the keys may hold more symbols than count
    prefix[at] = same
    # the transform and its last-to-first mapping
    bwt = sym[order - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    # intervals of strings of `known` symbols whose end was fixed last
    bounds = np.r_[0, at, n]
    fixed_last = prefix[bounds[1:]] == known - 1
    fixed_last[-1] = False
    lo, hi = bounds[:-1][fixed_last], bounds[1:][fixed_last]
    for level in range(known, least):
        if not len(lo):
            break
        size = hi - lo
        pos = A.cut(np.arange(n), lo, size)
        packed = np.sort((lf[pos].astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(lo), dtype=np.uint64), size))
        to, src = (packed >> np.uint64(32)).astype(np.int64), packed & np.uint64(0xFFFFFFFF)
        c = s[order[to]]
        new = np.r_[True, (to[1:] != to[:-1] + 1) | (src[1:] != src[:-1]) | (c[1:] != c[:-1])]
        heads = np.flatnonzero(new)
        ends = np.r_[to[heads[1:] - 1], to[-1]] + 1
        push = prefix[ends] < 0
        lo, hi = to[heads][push], ends[push]
        prefix[hi] = level
    return order, prefix[:n]


def window_minima(data: np.ndarray, size: np.ndarray, low: np.ndarray, least: int) -> np.ndarray:
    """For every window of the given segments (text after text), the smallest doc_id among the segments that hold it."""
    n, gap = len(data), len(size)
    ends = np.cumsum(size)
    sym = np.zeros(n + gap, np.int16)
    seg = np.repeat(np.arange(gap), size + 1)
    body = np.ones(n + gap, bool)
    body[ends + np.arange(gap)] = False
    sym[body] = data.astype(np.int16) + 1
    order, prefix = common_prefixes(sym, least)
    windows = np.zeros(n + gap, bool)
    left = np.repeat(ends + np.arange(gap), size + 1) - np.arange(n + gap)  # symbols before the segment's end
    windows[left >= least] = True
    group = np.cumsum(prefix >= 0) - 1
    value = np.where(windows[order], low[seg[order]], np.iinfo(np.int64).max)
    heads = np.flatnonzero(prefix >= 0)
    smallest = np.minimum.reduceat(value, heads)
    out = np.empty(n + gap, np.int64)
    out[order] = smallest[group]
    return out[windows]


def shard_runs(parts: list[dict], least: int) -> list[tuple[bytes, bytes, bytes]]:
    """For each block's distinct segments: runs of windows whose smallest doc_id is equal.

    parts: per block anchor, size, low (arrays) and data (all texts). Gives per block the runs of each segment, the
    windows of each run and their doc_id.
    """
    anchor, size, low = (np.concatenate([p[k] for p in parts]) for k in ("anchor", "size", "low"))
    data = np.concatenate([p["data"] for p in parts])
    begin = np.cumsum(size) - size
    # equal texts of several blocks become one; the hash's arrays are a block's, not the shard's
    key = np.concatenate([A.range_hashes(p["data"], np.cumsum(p["size"]) - p["size"], np.cumsum(p["size"])) for p in parts]) ^ A.mix(anchor)
    rep, of = A.equal_texts(data, begin, size, key)
    by = np.argsort(anchor[rep], kind="stable")
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    rep, of = rep[by], back[of]
    lows = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(lows, of, low)
    # portions of whole anchors
    total = np.cumsum(size[rep] + 1)
    first = np.flatnonzero(np.r_[True, anchor[rep][1:] != anchor[rep][:-1]])
    found, at = [], 0
    while at < len(rep):
        j = np.searchsorted(total[np.r_[first[1:] - 1, len(rep) - 1]], (total[at - 1] if at else 0) + PORTION, side="right")
        j = max(j, np.searchsorted(first, at, side="right"))
        to = int(first[j]) if j < len(first) else len(rep)
        r = rep[at:to]
        found.append(window_minima(A.cut(data, begin[r], size[r]), size[r], lows[at:to], least))
        at = to
    doc = np.concatenate(found)
    windows = size[rep] - least + 1
    stop = np.cumsum(windows)
    cuts = np.r_[True, doc[1:] != doc[:-1]]
    cuts[(stop - windows)] = True
    runs = np.flatnonzero(cuts)
    length, value = np.diff(np.r_[runs, len(doc)]), doc[runs]
    number = np.searchsorted(runs, np.r_[stop - windows, len(doc)])
    each = np.diff(number)  # runs of each distinct text
    out, at = [], 0
    for p in parts:
        mine = of[at : at + len(p["size"])]
        at += len(mine)
        pick = A.cut(np.arange(len(runs)), number[mine], each[mine])
        out.append((each[mine].astype("<i4").tobytes(), length[pick].astype("<i4").tobytes(), value[pick].astype("<i8").tobytes()))
    return out


class Block:
    """The documents of one block, in an order that every pass over them finds again."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("id", "ascending"), ("none", "ascending"), ("bytes", "ascending")])
        self.table = t
        self.ids = t.column("id").to_numpy()
        self.data, self.offsets = A.texts_of(t.column("bytes"))
        self.units, self.unit_offsets = self.data, self.offsets
        self.grams, self.k, self.length = A.byte_grams, GRAM, MIN_LENGTH

    def scan(self):
        self.seg = A.segments(self.units, self.unit_offsets, self.length, self.k, self.grams)
        self.keys, self.twice = A.block_anchors(self.seg, self.ids)
        return self

    def pick(self, masks: dict[int, bytes], shards: int):
        A.choose(self, masks, shards)
        return self

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes, in bytes of data, of some segments."""
        return self.seg.start[which], self.seg.count[which] + self.length - 1

    def texts(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, sizes) of some segments."""
        start, size = self.places(first)
        return A.cut(self.data, start, size), size


KEYS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
MASKS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("mask", pa.binary())])
TEXTS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("anchor", pa.binary()), ("low", pa.binary()), ("size", pa.binary()), ("data", pa.binary())])
RUNS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("each", pa.binary()), ("length", pa.binary()), ("doc", pa.binary())])


def ddl(s: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in s)


def pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def repeated_runs(rows: DataFrame, make, runs_of, finish, out_schema: str) -> DataFrame:
    """The frame of anchors.py over rows (id, bytes, block).

    make(table) gives a Block; runs_of(parts) answers for a shard; finish(block, masks, runs, shards) gives the
    result of a block.
    """
    shards = partitions(rows.sparkSession)

    def send_keys(t: pa.Table) -> pa.Table:
        b = make(t).scan()
        at, n = A.shard_bounds(b.keys, shards), t.column("block")[0].as_py()
        some = [s for s in range(shards) if at[s + 1] > at[s]]
        return pa.table([some, [n] * len(some), [b.keys[at[s] : at[s + 1]].tobytes() for s in some], [A.bits(b.twice[at[s] : at[s + 1]]) for s in some]], schema=KEYS)

    def answer_keys(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        twice = [A.from_bits(x, len(k)) for x, k in zip(t.column("twice").to_pylist(), keys, strict=True)]
        found = A.in_two_documents(keys, twice)
        some = [i for i, f in enumerate(found) if f.any()]
        blocks, shard = t.column("block").to_pylist(), t.column("shard")[0].as_py()
        return pa.table([[blocks[i] for i in some], [shard] * len(some), [A.bits(found[i]) for i in some]], schema=MASKS)

    def picked(t: pa.Table, masks: pa.Table):
        m = dict(zip(masks.column("shard").to_pylist(), masks.column("mask").to_pylist(), strict=True))
        return make(t).scan().pick(m, shards)

    def send_texts(t: pa.Table, masks: pa.Table) -> pa.Table:
        if not t.num_rows or not masks.num_rows:
            return TEXTS.empty_table()
        b, n, rows_ = picked(t, masks), t.column("block")[0].as_py(), []
        for s in range(shards):
            i, j = b.shard_at[s], b.shard_at[s + 1]
            if j > i:
                first = b.distinct.first[i:j]
                data, size = b.texts(first)
                rows_.append((s, n, pack(b.seg.anchor[first]), pack(b.distinct.low[i:j]), pack(size.astype("<i4")), pack(data)))
        return pa.table([list(x) for x in zip(*rows_, strict=True)] if rows_ else [[]] * 6, schema=TEXTS)

    def answer_texts(t: pa.Table) -> pa.Table:
        parts = [{"anchor": unpack(r["anchor"], np.uint64), "low": unpack(r["low"], np.int64), "size": unpack(r["size"], "<i4").astype(np.int64), "data": unpack(r["data"], np.uint8)} for r in t.to_pylist()]
        got = runs_of(parts)
        return pa.table([t.column("block"), t.column("shard"), *[[x[i] for x in got] for i in range(3)]], schema=RUNS)

    def end(t: pa.Table, back: pa.Table) -> pa.Table:
        masks, runs = back.filter(pa.compute.is_valid(back.column("mask"))), back.filter(pa.compute.is_valid(back.column("each")))
        b = picked(t, masks)
        by = {r["shard"]: r for r in runs.to_pylist()}
        order = [by[s] for s in range(shards) if s in by]
        each, length, doc = (np.concatenate([np.frombuffer(r[k], kind) for r in order]).astype(np.int64) if order else np.zeros(0, np.int64) for k, kind in (("each", "<i4"), ("length", "<i4"), ("doc", "<i8")))
        return finish(b, each, length, doc)

    keys = rows.groupBy("block").applyInArrow(send_keys, ddl(KEYS))
    masks = keys.groupBy("shard").applyInArrow(answer_keys, ddl(MASKS))
    texts = rows.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(send_texts, ddl(TEXTS))
    runs = texts.groupBy("shard").applyInArrow(answer_texts, ddl(RUNS))
    back = masks.select("block", "shard", "mask", *(F.lit(None).cast("binary").alias(c) for c in ("each", "length", "doc"))).unionByName(runs.select("block", "shard", F.lit(None).cast("binary").alias("mask"), "each", "length", "doc"))
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda t, r: end(t, r) if t.num_rows else None, out_schema)


def blocks_of(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, none, bytes, x0, x1, ..., block); none: the id was null; x0, x1, ... are the columns to carry."""
    n = BLOCKS * partitions(documents.sparkSession)
    rows = documents.select(filled_id("doc_id").alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"), *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))


def covered(b: Block, each: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Units of the block that a window of a smaller document covers."""
    d, seg = b.distinct, b.seg
    mark = np.zeros(len(b.units) + 1, np.int32)
    if len(d.chosen):
        first = np.cumsum(each) - each
        n = each[d.of]
        run = A.cut(np.arange(len(length)), first[d.of], n)
        seg_of = np.repeat(d.chosen, n)
        ahead = np.cumsum(length) - length  # windows before each run
        begin = seg.start[seg_of] + ahead[run] - np.repeat(ahead[first[d.of]], n)
        take = doc[run] < b.ids[seg.doc[seg_of]]
        begin, size = begin[take], length[run][take]
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + size + b.length - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def removed_spans(b: Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the maximal removed runs; a run ends with its document."""
    fresh = np.zeros(len(gone) + 1, bool)
    fresh[b.unit_offsets] = True
    before = np.r_[False, gone[:-1]] & ~fresh[:-1] if len(gone) else gone
    start = np.flatnonzero(gone & ~before)
    after = np.r_[gone[1:], False] & ~fresh[1:] if len(gone) else gone
    stop = np.flatnonzero(gone & ~after) + 1
    return np.searchsorted(b.unit_offsets, start, side="right") - 1, start, stop


def _finish(b: Block, each, length, doc) -> pa.Table:
    gone = covered(b, each, length, doc)
    row, start, stop = removed_spans(b, gone)
    n = len(b.ids)
    removed, spans = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(removed, row, stop - start)
    np.add.at(spans, row, 1)
    sha, kept, at = [], [], np.searchsorted(row, np.arange(n + 1))
    whole = ~gone
    # a character goes only with all its bytes
    lead = np.flatnonzero((b.data & 0xC0) != 0x80)
    if len(lead):
        some = np.logical_or.reduceat(whole, lead)
        chars = np.repeat(some, np.diff(np.r_[lead, len(whole)]))
    else:
        chars = whole
    for i in range(n):
        o, e = b.offsets[i], b.offsets[i + 1]
        if removed[i]:
            sha.append(hashlib.sha256(b.data[o:e][whole[o:e]].tobytes()).hexdigest())
            kept.append(b.data[o:e][chars[o:e]].tobytes())
        else:
            text = b.data[o:e].tobytes()
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
    pairs = [np.stack([start[at[i] : at[i + 1]], stop[at[i] : at[i + 1]]], 1) - b.offsets[i] for i in range(n)]
    spans_ = pa.array([p.tolist() for p in pairs], pa.list_(pa.list_(pa.int64())))
    return pa.table([pa.array(b.ids), b.table.column("none"), pa.array(np.diff(b.offsets)), pa.array(removed), pa.array(spans), pa.array(sha, pa.string()), spans_, pa.array(kept, pa.binary())], ["id", "none", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


OUT = "id long, none boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary"


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed) and text (what stays)."""
    out = repeated_runs(blocks_of(documents), Block, lambda parts: shard_runs(parts, MIN_LENGTH), _finish, OUT)
    return out.select(own_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", F.col("kept").cast("string").alias("text"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with what stays as their text (and its length as n_chars, if there is such a column)."""
    other = tuple(c for c in documents.columns if c not in ("doc_id", "text", "n_chars"))
    kinds = StructType([StructField("id", LongType()), StructField("none", BooleanType()), StructField("kept", BinaryType()), *(StructField(f"x{i}", documents.schema[c].dataType) for i, c in enumerate(other))])

    def finish(b: Block, each, length, doc) -> pa.Table:
        t = _finish(b, each, length, doc).select(["id", "none", "kept"])
        for i in range(len(other)):
            t = t.append_column(f"x{i}", b.table.column(f"x{i}"))
        return t

    out = repeated_runs(blocks_of(documents, other), Block, lambda parts: shard_runs(parts, MIN_LENGTH), finish, kinds)
    text = F.col("kept").cast("string")
    made = {"doc_id": own_id(), "text": text, "n_chars": F.length(text)} | {c: F.col(f"x{i}") for i, c in enumerate(other)}
    return out.select(*(made[f.name].cast(f.dataType).alias(f.name) for f in documents.schema))


def op1_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
