"""Repeated stretches by content-chosen anchors: the distributed frame of both substring operators.

Every window of `length` units (bytes or words) has an anchor: the smallest hash among its grams. Equal windows have
equal anchors, so the windows of one anchor can be compared in one place and no match is lost. Consecutive windows
with the same anchor form a segment. Documents are dealt to blocks by doc_id, anchors to shards:

1. a block sends each of its distinct anchors once (8 bytes) to the anchor's shard, with a bit that says whether two
   of its documents have it; the shard answers with one bit each: does the anchor occur in two documents anywhere?
2. a block sends the segments of such anchors, each distinct text once with its smallest doc_id, to the shard, which
   finds for every window the smallest doc_id it starts in, and answers with runs of windows of equal doc_id;
3. the block marks what windows of smaller documents cover.

A passage that a third of all documents hold reaches its shard once for each block, not once for each document. All
steps group by block or by shard, whose number follows the cluster's shuffle partitions; the blocks' texts are
shuffled once, as Spark reuses the exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Windows whose hashes are computed at once.
STEP = 1 << 19
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        rest = width - have
        h = np.minimum(h[: len(h) - rest], h[rest:])
    return h


def byte_grams(data: np.ndarray, start: int, stop: int, k: int) -> np.ndarray:
    """Hashes of the k-byte strings that start at start..stop-1; 8 <= k <= 16."""
    buf = np.zeros(stop - start + 16, np.uint8)
    part = data[start : stop + 15]
    buf[: len(part)] = part
    wide = np.ndarray((stop - start + 8,), "<u8", buf, strides=(1,))
    a = np.ascontiguousarray(wide)
    return mix(a[: stop - start] * M1 ^ a[k - 8 : k - 8 + stop - start] * M3)


def unit_grams(units: np.ndarray, start: int, stop: int, k: int) -> np.ndarray:
    """Hashes of the k-unit strings, of units that are 64-bit hashes already."""
    part = np.zeros(stop - start + k, np.uint64)
    got = units[start : stop + k - 1]
    part[: len(got)] = got
    out = np.zeros(stop - start, np.uint64)
    for i in range(k):
        out = out * M1 + part[i : i + stop - start]
    return mix(out)


@dataclass
class Segments:
    """Runs of windows with the same anchor, in the order of the block."""

    start: np.ndarray  # first window, as a position in the block
    count: np.ndarray  # windows
    anchor: np.ndarray
    doc: np.ndarray  # row in the block


def segments(units: np.ndarray, offsets: np.ndarray, length: int, k: int, grams) -> Segments:
    """Segments of a block whose rows are units[offsets[i]:offsets[i + 1]]."""
    n, width = len(units), length - k + 1
    windows = np.maximum(np.diff(offsets) - length + 1, 0)  # of each row
    ok = np.zeros(n + 1, np.int8)
    has = np.flatnonzero(windows)
    ok[offsets[has]] = 1
    ok[offsets[has] + windows[has]] -= 1
    valid = np.cumsum(ok[:n], dtype=np.int8).astype(bool)
    fresh = np.zeros(n, bool)
    fresh[offsets[has]] = True
    parts = []
    for at in range(0, n - length + 1, STEP):
        to = min(at + STEP, n - length + 1)
        low = sliding_min(grams(units, at, to + width - 1, k), width)[: to - at]
        v = valid[at:to]
        new = v & (np.r_[True, low[1:] != low[:-1]] | fresh[at:to] | ~np.r_[False, v[:-1]])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # a run ends at the next run, or where windows stop being valid
        total = np.cumsum(v, dtype=np.int32)
        upto = np.r_[total[first[1:] - 1], total[-1]]
        parts.append((first + at, upto - (total[first] - 1), low[first]))
    if not parts:
        z = np.zeros(0, np.int64)
        return Segments(z, z, z.astype(np.uint64), z)
    start, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Segments(start, count.astype(np.int64), mix(anchor), np.searchsorted(offsets, start, side="right") - 1)


def hash_prefix(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(H, Q) such that range_hash() can hash any range of units."""
    n = len(units)
    base = int(M1) | 1
    p, q = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    np.cumprod(p, out=p)
    np.cumprod(q, out=q)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * p[:n], out=h[1:])
    return h, q


def range_hash(hq: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of units[start:stop] for arrays of ranges, the same wherever the range stands."""
    h, q = hq
    return mix((h[stop] - h[start]) * q[start] + (stop - start).astype(np.uint64) * M2)


def range_hashes(units: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """range_hash() of ascending ranges, with arrays of about STEP units at once."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = int(np.searchsorted(start, start[at] + STEP))
        lo, hi = start[at], stop[at:to].max()
        out[at:to] = range_hash(hash_prefix(units[lo:hi]), start[at:to] - lo, stop[at:to] - lo)
        at = to
    return out


def unlike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the ranges a..a+size of data differ from the ranges b..b+size, by portions of about STEP bytes."""
    out = np.zeros(len(size), bool)
    some = np.flatnonzero(a != b)
    a, b, size = a[some], b[some], size[some]
    total, at = np.cumsum(size), 0
    while at < len(some):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + STEP, side="right")))
        hit = np.flatnonzero(cut(data, a[at:to], size[at:to]) != cut(data, b[at:to], size[at:to]))
        out[some[at + np.searchsorted(total[at:to] - base, hit, side="right")]] = True
        at = to
    return out


def equal_texts(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the texts data[start:start + size] numbered so that those of equal bytes, and no others, share a number.

    key: a hash that equal texts share. It only proposes what may be equal; the bytes decide.
    """
    order = np.lexsort((size, key))
    k, n = key[order], size[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])] if len(key) else np.zeros(0, bool)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    wrong = np.flatnonzero(unlike(data, start, start[first[of]], size))
    seen: dict[tuple[int, bytes], int] = {}
    more = []
    for i in wrong.tolist():
        text = int(of[i]), data[start[i] : start[i] + size[i]].tobytes()
        if text not in seen:
            seen[text] = len(first) + len(more)
            more.append(i)
        of[i] = seen[text]
    return np.r_[first, np.array(more, np.int64)], of


@dataclass
class Distinct:
    """The distinct texts among some segments of a block."""

    first: np.ndarray  # of each distinct text, the segment that shows it
    of: np.ndarray  # of each chosen segment, its distinct text
    low: np.ndarray  # of each distinct text, the smallest doc_id
    chosen: np.ndarray  # the segments


def distinct_texts(b, chosen: np.ndarray) -> Distinct:
    """The distinct texts among a block's chosen segments, in the order of their anchors."""
    seg = b.seg
    start, count = seg.start[chosen], seg.count[chosen]
    key = range_hashes(b.units, start, start + count + b.length - 1) ^ mix(seg.anchor[chosen])
    first, of = equal_texts(b.data, *b.places(chosen), key)
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, of, b.ids[seg.doc[chosen]])
    by = np.argsort(seg.anchor[chosen[first]], kind="stable")
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return Distinct(chosen[first[by]], back[of], low[by], chosen)


def block_anchors(seg: Segments, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct anchors in ascending order, and which of them two of its documents have."""
    order = np.argsort(seg.anchor, kind="stable")
    a, d = seg.anchor[order], ids[seg.doc[order]]
    heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    if not len(heads):
        return a, np.zeros(0, bool)
    return a[heads], np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys start in ascending keys."""
    cuts = np.array([(i << 64) // shards for i in range(shards)], dtype=np.uint64)
    return np.r_[np.searchsorted(keys, cuts), len(keys)]


def in_two_documents(keys: list[np.ndarray], twice: list[np.ndarray]) -> list[np.ndarray]:
    """For each block's keys: which occur in two documents, of one block or of several."""
    k, t = np.concatenate(keys), np.concatenate(twice)
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    more = np.add.reduceat(t.astype(np.int64), heads) > 0
    more |= np.diff(np.r_[heads, len(k)]) > 1
    found = np.empty(len(k), bool)
    found[order] = np.repeat(more, np.diff(np.r_[heads, len(k)]))
    return np.split(found, np.cumsum([len(x) for x in keys])[:-1])


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def from_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def texts_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    parts, lengths = [], []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        c = c.cast(pa.large_binary())
        if not len(c):
            continue
        o = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        n = np.diff(o)
        if c.null_count:
            n = np.where(np.asarray(c.is_valid()), n, 0)
            c = c.fill_null(b"")
            o = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        lengths.append(n)
        if c.buffers()[2] is not None:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[o[0] : o[-1]])
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return data, np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int64) if lengths else np.zeros(1, np.int64)


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges start..start+size of data, one after the other."""
    total = int(size.sum())
    if not total:
        return data[:0]
    step = np.ones(total, np.int64)
    ends = np.cumsum(size)
    keep = size > 0
    s, n, at = start[keep], size[keep], (ends - size)[keep]
    step[at] = s - np.r_[0, s[:-1] + n[:-1] - 1]
    return data[np.cumsum(step)]


def choose(b, masks: dict[int, bytes], shards: int) -> None:
    """Chooses a block's segments whose anchor occurs in two documents, and orders their distinct texts by shard."""
    bounds = shard_bounds(b.keys, shards)
    hit = np.zeros(len(b.keys), bool)
    for s, m in masks.items():
        hit[bounds[s] : bounds[s + 1]] = from_bits(m, bounds[s + 1] - bounds[s])
    chosen = np.flatnonzero(hit[np.searchsorted(b.keys, b.seg.anchor)]) if len(b.keys) else np.zeros(0, np.int64)
    b.distinct = distinct_texts(b, chosen)
    b.shard_at = shard_bounds(b.seg.anchor[b.distinct.first], shards)
