"""Best-fit packing by minimum bin slack.

Documents become token ids and pieces of at most CAPACITY ids. Which lengths share a sequence depends only on how many
pieces there are of each length, a table of at most CAPACITY rows however large the input: the driver plans from it.
The longest length left opens a sequence; a bitset dynamic program over the lengths still available (bit s of an
integer is set if some combination sums to s) finds the fullest feasible combination with it. That combination is
removed as often as the counts allow, so no combination is looked for twice. Pieces then find their place from their
rank among the pieces of their length. Ranks are counted in parts dealt by a hash, so a length that a third of the
pieces have isn't ranked by one task.

Defined cases: null text is empty; an empty text is its end id alone; rows with the same doc_id are packed each; a
null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import cut as gathered
from .anchors import texts_of
from .common import partitions, table, written

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Elements whose ids a worker remembers.
MEMO = 300_000
#: Bytes of text whose elements are told apart at once, and ids put together at once.
AT_ONCE, STEP = 2_000_000, 1_000_000
#: Characters of a text above which it is cut at white space, and put together again.
LONG = 4 * AT_ONCE
WHITE = re.compile(rb"[ \t-\r]")


# The rules of VOCABULARY that Tokens relies on; a file with other rules is used as it is, text by text.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def byte_kinds() -> np.ndarray:
    """Kind of each byte. Odd are the apostrophe and the bar, which may begin contractions and control strings, and all that isn't printable ASCII."""
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = MARK
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[[0x27, 0x7C]] = ODD
    return kind


KIND = byte_kinds()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER[0x09:0x0E] = 0x20


def elements(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places in the texts, starts in the bytes): texts cut into elements that the tokenizer encodes one by one as it would the whole.

    An element is a run of Latin letters (lower-cased), a run of marks or a digit; a word that holds anything else is
    one element, as it is. White space goes. Each text ends with white space; each starts an element, maybe an empty one.
    """
    kind, data = KIND[raw], LOWER[raw]
    wide = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF, of which two are signs
    last = raw[wide + 1]
    wide, last = wide[(last != 0x97) & (last != 0xB7)], last[(last != 0x97) & (last != 0xB7)]
    kind[wide] = kind[wide + 1] = LETTER
    data[wide[last < 0x9F] + 1] += 0x20
    cut = np.empty(len(raw), bool)
    cut[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut &= kind != SPACE
    cut |= kind == DIGIT
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        space = np.flatnonzero(kind == SPACE)
        at = np.unique(np.searchsorted(space, odd))
        start, stop = np.r_[-1, space][at] + 1, space[at]
        step = np.zeros(len(raw) + 1, np.int8)
        step[start] = 1
        step[stop] = -1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        np.copyto(data, raw, where=inside)
        cut &= ~inside
        cut[start] = True
    cut[offsets[:-1]] = True
    white = kind == SPACE
    start = np.flatnonzero(cut)
    gone = np.cumsum(white, dtype=np.int32 if len(raw) < 2**31 else np.int64)
    return data[~white], start, start - gone[start] + white[start]


def cut_at_spaces(text: bytes, size: int) -> list[bytes]:
    """A text cut behind white space to parts of `size` bytes, or more where a word is longer."""
    parts, at = [], 0
    while at < len(text):
        to = at + size
        if to < len(text):
            m = WHITE.search(text, to)
            to = m.end() if m else len(text)
        parts.append(text[at:to])
        at = to
    return parts


class Tokens:
    """Token ids of whole texts as the tokenizer gives them, by the ids of distinct elements.

    The tokenizer lower-cases, drops white space and never joins across it, nor across the edge of letters, digits and
    marks. A run of lower-case Latin letters is left alone by its normalizer and is one pre-token, so many such runs
    are encoded by one call without those steps: the last id of each, and no other, ends a word. All other elements
    are encoded by the tokenizer as it is.
    """

    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    AT_ONCE = 5000

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        split = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = (
            (rules["normalizer"] or {}).get("normalizers") == NORMALIZER
            and [x.get("type") for x in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": SPLIT}
            and rules["model"].get("end_of_word_suffix") == "</w>"
            and all(
                "|" in t["content"] and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"]
            )
        )
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.memo: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for word, i in self.tokenizer.get_vocab().items():
            self.ends[i] = word.endswith("</w>")

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        plain, rest = [], []
        for w in new:
            (plain if self.LETTERS.fullmatch(w) else rest).append(w)
        for at in range(0, len(plain), self.AT_ONCE):
            some = plain[at : at + self.AT_ONCE]
            said = [w.decode() for w in some]
            ids = np.array(self.letters.encode_batch_fast([" ".join(said)], add_special_tokens=False)[0].ids, "<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stop) == len(some):
                raw = ids.tobytes()
                start = [0, *stop[:-1].tolist()]
                self.memo.update(zip(some, [raw[i:j] for i, j in zip(start, stop.tolist(), strict=True)], strict=True))
            else:
                rest += some  # never so far; one by one they are right in any case
        self.memo.update(zip(rest, self._each([w.decode("utf-8", "surrogatepass") for w in rest]), strict=True))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:  # the older half goes
            for w in list(self.memo)[: len(self.memo) // 2]:
                del self.memo[w]
            new = [w for w in words if w not in self.memo]
        self._learn(new)
        return [self.memo[w] for w in words]

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty. Memory is some twenty times the texts; a very long text comes alone."""
        if not self.known:
            for t in texts.to_pylist():
                yield np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4")
            return
        if len(texts) == 1 and len(texts[0].as_py() or "") > LONG:
            yield np.concatenate(
                list(self.encode(pa.array(cut_at_spaces(texts[0].as_py().encode("utf-8", "surrogatepass"), AT_ONCE), pa.large_binary())))
            )
            return
        texts = pc.binary_join_element_wise(
            texts.cast(pa.large_binary()), *(pa.scalar(x, pa.large_binary()) for x in (b"", b" ")),
            null_handling="replace", null_replacement=b"",
        )
        raw, offsets = texts_of(texts)
        data, place, start = elements(raw, offsets)
        pool = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(data)]), pa.py_buffer(data)],
        )
        pool = pool.dictionary_encode()
        ids = self._ids(pool.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        of = pool.indices.to_numpy()
        first, begin = np.searchsorted(place, offsets), np.cumsum(size) - size
        # the texts' ids are put together in portions of bounded size
        ahead = np.r_[0, np.cumsum(size[of])][first]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + STEP, side="right")) - 1)
            some = of[first[at] : first[to]]
            out = gathered(flat, begin[some], size[some])
            for i in range(at, to):
                yield out[ahead[i] - ahead[at] : ahead[i + 1] - ahead[at]]
            at = to


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """A worker's tokenizer of a file with its memo, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to runs of rows of about `size` bytes of text at most, one row at least."""
    for b in batches:
        total, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
            yield b.slice(at, to - at)
            at = to


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens, end = tokens_of(path or vocabulary_path()), np.array([END], "<u4").tobytes()
    for t in _portions(batches, AT_ONCE):
        rows: list[list] = [[], [], [], [], []]
        for doc, own in zip(t.column(0).to_pylist(), tokens.encode(t.column(1)), strict=True):
            ids = own.tobytes() + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for to, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    to.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
            ["id", "piece", "start", "length", "ids_crc32"],
        )


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """The fullest combination of available lengths with the longest one in it; ties prefer longer lengths."""
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []  # steps: (length, copies, sums reachable before)
    for i, n in enumerate(lengths):
        left = min(counts[n] - (i == 0), room // n)
        copies = 1
        while left > 0 and not reach >> room & 1:
            take = min(copies, left)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & mask
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = [lengths[0]]
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [n] * take
            total -= n * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces in each, first offset): where pieces of a length go."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    out, sequence = [], 0
    while left:
        chosen = fullest(left, capacity)
        each = {n: chosen.count(n) for n in chosen}
        times = min(left[n] // k for n, k in each.items())
        offset = 0
        for n, k in each.items():
            out.append((n, used[n], used[n] + k * times, sequence, k, offset))
            used[n] += k * times
            offset += n * k
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequence += times
    return out


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: path of the tokenizer's file."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(lambda it: _pieces(it, vocabulary, capacity), "id long, piece int, start long, length long, ids_crc32 long")
    # dealt by a number of their own, so that equal texts under one id, or under none, are spread too
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(partitions(spark))).cast("int")
    pieces = written(made.withColumn("part", part), "pieces")
    have = written(pieces.groupBy("length", "part").count(), "lengths")
    counts = {r.length: r.n for r in have.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    have = have.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    # no more copies of a piece than a part holds share a window
    within = Window.partitionBy("length", "part").orderBy("id", "piece")
    ranked = pieces.withColumn(
        "rank", F.row_number().over(within) - 1,
    ).join(have, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))

    def place(batches):
        key = slots[:, 0] * (1 << 40) + slots[:, 1]
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            if not len(n):
                continue
            s = slots[np.searchsorted(key, n * (1 << 40) + r, side="right") - 1]
            k = r - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 5] + k % s[:, 4] * n)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
