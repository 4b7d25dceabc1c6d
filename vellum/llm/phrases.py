"""Substring dedup with repeated-phrase automata.

The frame of anchors.py brings the windows of 50 words that may recur to one shard. The shard confirms, word by word,
which of them recur and in which document each starts first; runs of windows with the same first document are the
recurring passages. Each block of documents then compiles the passages that concern it into Aho-Corasick automata (in
portions of bounded size, each distinct word being one symbol) and streams all its documents through them, which locates every
occurrence. Words of an occurrence in a later document than the passage's first one are removed.

Defined cases: null text has no words; fewer than 50 words lose nothing; rows with the same doc_id are one document;
a null doc_id ranks with the largest long (rows of either are one document) and stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import own_id
from .suffix_array import blocks_of, repeated_runs

WINDOW = 50
GRAM = 5
#: Words of the passages of one automaton; it needs some hundred bytes for each.
AUTOMATON = 300_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordBlock:
    """The documents of one block as words. Its interface is that of suffix_array.Block."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("id", "ascending"), ("none", "ascending"), ("bytes", "ascending")])
        self.none = t.column("none")
        self.ids = t.column("id").to_numpy()
        data, offsets = A.texts_of(t.column("bytes"))
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        stop = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        self.unit_offsets = np.searchsorted(start, offsets)
        # words joined by one space
        self.data = A.cut(np.r_[data, np.uint8(32)], start, stop - start + 1).copy()
        self.at = np.r_[0, np.cumsum(stop - start + 1)]
        self.data[self.at[1:] - 1] = 32
        # a word's code tells it from the block's other words; its hash, the same in all blocks, chooses anchors only
        pool = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(self.at), pa.py_buffer(self.data)],
        ).dictionary_encode()
        self.codes = pool.indices.to_numpy()
        self.units = np.fromiter(map(xxhash.xxh64_intdigest, pool.dictionary.to_pylist()), np.uint64, len(pool.dictionary))[self.codes]
        self.grams, self.k, self.length = A.unit_grams, GRAM, WINDOW

    def scan(self):
        self.seg = A.segments(self.units, self.unit_offsets, self.length, self.k, self.grams)
        self.keys, self.twice = A.block_anchors(self.seg, self.ids)
        return self

    def pick(self, masks: dict[int, bytes], shards: int):
        A.choose(self, masks, shards)
        return self

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes, in bytes of data, of some segments."""
        a = self.seg.start[which]
        b = a + self.seg.count[which] + self.length - 1
        return self.at[a], self.at[b] - self.at[a]

    def texts(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all segments, each ended by a line feed; words of each)."""
        start, size = self.places(first)
        data = A.cut(self.data, start, size)
        data[np.cumsum(size) - 1] = 10
        return data, self.seg.count[first] + self.length - 1


def passage_runs(parts: list[dict]) -> list[tuple[bytes, bytes, bytes]]:
    """For each block's distinct segments: runs of windows whose smallest doc_id is equal, confirmed on the words."""
    low: dict[tuple[int, bytes], int] = {}
    texts: dict[int, list[bytes]] = {}
    each = []
    for p in parts:
        mine = list(zip(p["anchor"].tolist(), p["data"].tobytes().split(b"\n")[:-1], strict=True))
        for key, doc in zip(mine, p["low"].tolist(), strict=True):
            old = low.get(key)
            if old is None:
                texts.setdefault(key[0], []).append(key[1])
            if old is None or doc < old:
                low[key] = doc
        each.append(mine)
    runs: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
    for anchor, own in texts.items():
        if len(own) == 1:
            n = own[0].count(b" ") + 2 - WINDOW
            runs[anchor, own[0]] = ([n], [low[anchor, own[0]]])
            continue
        first: dict[bytes, int] = {}
        windows = []
        for text in own:
            raw = np.frombuffer(text, np.uint8)
            at = np.r_[0, np.flatnonzero(raw == 32) + 1, len(text) + 1].tolist()
            w = [text[at[i] : at[i + WINDOW] - 1] for i in range(len(at) - WINDOW)]
            windows.append(w)
            doc = low[anchor, text]
            for x in w:
                if first.get(x, doc) >= doc:
                    first[x] = doc
        for text, w in zip(own, windows, strict=True):
            docs = np.array([first[x] for x in w], np.int64)
            heads = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            runs[anchor, text] = (np.diff(np.r_[heads, len(docs)]).tolist(), docs[heads].tolist())
    out = []
    for mine in each:
        got = [runs[k] for k in mine]
        out.append(
            (
                np.array([len(g[0]) for g in got], "<i4").tobytes(),
                np.array([x for g in got for x in g[0]], "<i4").tobytes(),
                np.array([x for g in got for x in g[1]], "<i8").tobytes(),
            )
        )
    return out


def passages(b: WordBlock, each: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, first document) of the passages that some document of the block must lose."""
    d, seg = b.distinct, b.seg
    if not len(d.first):
        z = np.zeros(0, np.int64)
        return z, z, z
    most = np.full(len(d.first), -(2**63), np.int64)
    np.maximum.at(most, d.of, b.ids[seg.doc[d.chosen]])
    of = np.repeat(np.arange(len(each)), each)
    ahead = np.cumsum(length) - length
    start = seg.start[d.first][of] + ahead - np.repeat(ahead[np.cumsum(each) - each], each)
    take = doc < most[of]
    return start[take], length[take] + b.length - 1, doc[take]


def locate(b: WordBlock, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words of the block that an occurrence of a passage of a smaller document covers."""
    import ahocorasick

    mark = np.zeros(len(b.units) + 1, np.int64)
    rows = np.repeat(np.arange(len(b.ids)), np.diff(b.unit_offsets))
    place = np.arange(len(b.units)) + rows  # one symbol between documents
    total = np.cumsum(size)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AUTOMATON, side="right")))
        words = A.cut(b.codes, start[at:to], size[at:to])
        known = np.unique(words)

        def symbols(x, known=known):
            i = np.minimum(np.searchsorted(known, x), len(known) - 1)
            c = np.where(known[i] == x, i + 2, 1)
            return np.where(c >= 0xD800, c + 0x800, c).astype("<u4")

        text = np.ones(len(b.units) + len(b.ids), "<u4")
        text[place] = symbols(b.codes)
        phrase = symbols(words).tobytes().decode("utf-32-le")
        ends = np.cumsum(size[at:to]).tolist()
        found: dict[str, int] = {}
        for e, n, m in zip(ends, size[at:to].tolist(), doc[at:to].tolist(), strict=True):
            p = phrase[e - n : e]
            found[p] = min(found.get(p, m), m)
        machine = ahocorasick.Automaton()
        for p, m in found.items():
            machine.add_word(p, (len(p), m))
        machine.make_automaton()
        hits = [(e, n, m) for e, (n, m) in machine.iter(text.tobytes().decode("utf-32-le"))]
        if hits:
            e, n, m = np.array(hits, np.int64).T
            first = np.searchsorted(place, e - n + 1)
            ok = m < b.ids[rows[first]]
            np.add.at(mark, first[ok], 1)
            np.add.at(mark, first[ok] + n[ok], -1)
        at = to
    return np.cumsum(mark[:-1]) > 0


def _finish(b: WordBlock, each, length, doc) -> pa.Table:
    gone = locate(b, *passages(b, each, length, doc))
    n, o = np.diff(b.unit_offsets), b.unit_offsets
    before = np.r_[0, np.cumsum(gone)]
    removed = before[o[1:]] - before[o[:-1]]
    sha, kept = [], []
    sizes = np.diff(b.at)
    for i in range(len(n)):
        a, e = o[i], o[i + 1]
        if removed[i]:
            text = A.cut(b.data, b.at[a:e][~gone[a:e]], sizes[a:e][~gone[a:e]]).tobytes()[:-1]
        else:
            text = b.data[b.at[a] : max(b.at[a], b.at[e] - 1)].tobytes()
        sha.append(hashlib.sha256(text).hexdigest())
        kept.append(text)
    return pa.table(
        [
            pa.array(b.ids), b.none, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)),
            pa.array(sha, pa.string()), pa.array(kept, pa.binary()),
        ],
        ["id", "none", "n_words", "n_removed", "kept_sha256", "kept"],
    )


def dedup_phrases(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and text (the kept words joined by one space)."""
    out = repeated_runs(
        blocks_of(documents), WordBlock, passage_runs, _finish,
        "id long, none boolean, n_words long, n_removed long, kept_sha256 string, kept binary",
    )
    return out.select(own_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("text"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup_phrases(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
