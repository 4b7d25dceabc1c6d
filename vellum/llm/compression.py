"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into windows of WINDOW
consecutive words (lower-cased; one window begins at the last word of the one before, so any two neighbours share a
window), every window is compressed with both dictionaries, and the difference of the two lengths says which text it
resembles. How many windows differ by at least each of THRESHOLDS bytes, and the largest differences, go through a
calibrated logistic curve. Windows get a fixed run of padding, for zstandard stores very short input as it is.

Toxic documents are mostly ordinary text, and a dictionary trained on all of theirs tells hardly anything (README), so
the toxic one learns from the parts of windows (runs of 1 to WINDOW words) whose document frequency in the two classes
differs significantly by the log-likelihood ratio; near copies of a row count once. The ordinary one learns from all
windows of the ordinary sample but those with a run that is FOREIGN times as frequent in toxic rows. The toxic compressor
has its own dictionary before the ordinary one: toxic text is ordinary language too. Ordinary strings then lie as
far behind a window for both compressors and cost the same, and only what is specific to toxic text makes lengths differ.

Dictionaries and curve are fitted on at most PER_CLASS labelled rows of each class and SAMPLE_BYTES of their whole texts
(those of smallest hash, none held out); the curve on the part that the dictionaries haven't seen. Every document is
scored on all its windows.

Defined cases: null text is empty; an empty text has one empty window; a missing class gives that class's constant
score, no labels at all 0.5; rows with the same doc_id are scored one by one; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import M1, mix
from .common import fit_logistic, held_out, labelled_sample, probability, table

PER_CLASS, SAMPLE_BYTES = 4000, 12_000_000
DICTIONARY = 16384
WINDOW = 4
#: Bytes that a compressor matches at least.
MATCH = 4
PAD = b" " * 64
#: Bytes of windows that are compressed by one call; a window is never cut.
PORTION = 1 << 20
#: Bytes of difference that windows are counted by.
THRESHOLDS = (1, 2, 3, 4, 6)
#: A run that is so many times as frequent in toxic documents is a mistake of the labels in ordinary ones.
FOREIGN = 10
#: Largest differences that count by themselves.
TOP = 3
#: What stands at the end of a trained dictionary's tables, before its text: the usual repeated offsets 1, 4 and 8.
OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def windows(w: list[bytes], size: int = WINDOW, end: bytes = b"") -> Iterator[bytes]:
    """Runs of `size` words with the spaces around them, then `end`; each begins at the last word of the one before."""
    for i in range(0, max(len(w) - 1, 1), size - 1):
        yield b" ".join((b"", *w[i : i + size], end))


class Distance:
    """Compressed length with the ordinary dictionary less that with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.parts, self.pair = (ordinary, toxic), None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.__init__(*parts)

    def _compressors(self):
        import zstandard

        made = []
        for d in self.parts:
            p = zstandard.ZstdCompressionParameters.from_level(3, dict_size=max(len(d), 1), source_size=128, min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2, search_log=4, hash_log=16, chain_log=16, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None
            if data:
                data.precompute_compress(compression_params=p)
            made.append(zstandard.ZstdCompressor(dict_data=data, compression_params=p).multi_compress_to_buffer)
        return made

    def __call__(self, some: list[bytes]) -> list[int]:
        """The differences of padded windows, which are compressed by one call for each dictionary."""
        if self.pair is None:
            self.pair = self._compressors()
        a, b = (map(len, k(some)) for k in self.pair)
        return list(map(int.__sub__, a, b))

    def features(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        """A row for each text; its windows are compressed with those of other texts, PORTION bytes at a time."""
        sizes, found, some, held = [], array("i"), [], 0
        for w in texts:
            many = 0
            for x in windows(w, end=PAD):
                some.append(x)
                held += len(x)
                many += 1
                if held >= PORTION:
                    found.extend(self(some))
                    some, held = [], 0
            sizes.append((len(w), many))
        if some:
            found.extend(self(some))
        out, at = np.empty((len(sizes), TOP + len(THRESHOLDS) + 1)), 0
        for k, (n, many) in enumerate(sizes):
            d = sorted((x for x in found[at : at + many] if x > 0), reverse=True)
            at += many
            top = d[:TOP] + [0] * (TOP - len(d))
            out[k] = [*top, *(math.log1p(sum(x >= t for x in d)) for t in THRESHOLDS), math.log1p(n)]
        return out


def dictionary(samples: list[bytes]) -> bytes:
    """The text of a trained dictionary, without its tables; with too little text to train on, that text."""
    import zstandard

    try:
        made = zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)
    at = made.find(OFFSETS)
    return made[at + len(OFFSETS) :] if at >= 0 else made


def runs_of(w: list[bytes]) -> list[bytes]:
    """Runs of 1 to WINDOW words, shorter ones first."""
    return [b" ".join(w[i : i + n]) for n in range(1, WINDOW + 1) for i in range(len(w) - n + 1)]


def run_hashes(w: list[bytes]) -> np.ndarray:
    """The hashes of runs_of(w)."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    out = [h]
    for n in range(1, min(WINDOW, len(w))):
        out.append(mix(out[-1][:-1] * M1 ^ mix(h[n:])))
    return np.concatenate(out)


def unlike_rows(hashes: list[np.ndarray], alike: float = 0.5) -> list[int]:
    """The rows but for near copies: those whose runs have a Jaccard of `alike` with the runs of a row before.

    Rows with one of their smallest hashes of the longest runs in common are compared.
    """
    kept, by = [], {}
    for i, h in enumerate(hashes):
        own = np.unique(h)
        words = (len(h) + WINDOW * (WINDOW - 1) // 2) // WINDOW
        signs = np.unique(h[len(h) - max(words - WINDOW + 1, 0) :])[:4].tolist() or own[:1].tolist()
        found = {j for s in signs for j in by.get(s, ())}
        for j in found:
            both = len(np.intersect1d(own, hashes[j]))
            if both >= alike * (len(own) + len(np.unique(hashes[j])) - both):
                break
        else:
            kept.append(i)
            for s in signs:
                by.setdefault(s, []).append(i)
    return kept


def specific_runs(sample: list[tuple[bytes, int]]) -> list[tuple[bytes, int, bool]]:
    """(run, toxic documents, FOREIGN times as frequent in them) of the runs that are significantly more frequent in toxic documents, rarest first."""
    every = [run_hashes(text.split()) for text, _ in sample]
    use = unlike_rows(every)
    n = [sum(sample[i][1] == k for i in use) for k in (0, 1)]
    known, a = np.unique(np.concatenate([np.unique(every[i]) for i in use if sample[i][1]]), return_counts=True)
    many = len(known)
    known, a = known[a > 1], a[a > 1].astype(float)
    if not len(known):
        return []
    b = np.zeros(len(known))
    for i in use:
        if not sample[i][1]:
            h = np.unique(every[i])
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            b[at[known[at] == h]] += 1
    p = (a + b) / sum(n)
    ratio = np.zeros(len(known))
    for k, m, q in ((a, n[1], p), (n[1] - a, n[1], 1 - p), (b, n[0], p), (n[0] - b, n[0], 1 - p)):
        ratio += np.where(k > 0, 2 * k * np.log(np.maximum(k, 1) / m / np.maximum(q, 1e-12)), 0)
    # few of so many pass by chance
    marked = (a / n[1] > b / n[0]) & (ratio >= 2 * math.log(many + 1) + 6)
    foreign = a / n[1] >= FOREIGN * b / max(n[0], 1)
    wanted, df, said = known[marked], dict(zip(known[marked].tolist(), zip(a[marked].astype(int).tolist(), foreign[marked].tolist(), strict=True), strict=True)), {}
    for i in use:
        some = np.flatnonzero(np.isin(every[i], wanted)) if sample[i][1] else ()
        if len(some):
            own = runs_of(sample[i][0].split())
            said |= {int(every[i][j]): own[j] for j in some}
    return sorted(((r, *df[h]) for h, r in said.items()), key=lambda x: (x[1], x[0]))


class Model:
    def __init__(self, distance: Distance | None, curve: np.ndarray):
        self.distance, self.curve = distance, curve

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.distance is None:
            return probability(np.zeros((len(texts), 1)), self.curve)
        return probability(self.distance.features(map(words, texts)), self.curve)


def fit(sample: list[tuple[bytes, int]], counts: list[int]) -> Model:
    """sample: (words joined by spaces, label) of each row, in a fixed order; counts: labelled rows of each class."""
    y = np.array([s[1] for s in sample], int)
    if not len(y) or y.min() == y.max():
        return Model(None, np.array([0.0, 0.0 if not len(y) else (30.0 if y[0] else -30.0)]))
    part = np.arange(len(y)) % 4 == 3
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    learn = [s for s, later in zip(sample, part, strict=True) if not later]
    specific = specific_runs(learn)
    marked = {r for r, _, foreign in specific if foreign}
    plain = [x for t, k in learn if not k for x in windows(t.split(), 2 * WINDOW)]
    heads = {r.split()[0] for r in marked}  # a window without one has no run to look for
    ordinary = dictionary([x for x in plain for w in [x.split()] if heads.isdisjoint(w) or marked.isdisjoint(runs_of(w))])
    many = [b" " + r + b" " for r, df, _ in specific for _ in range(df)]
    width = max(1, len(many) // 8)
    distance = Distance(ordinary, dictionary([b"".join(many[i::width]) for i in range(width)]) + ordinary)
    use = np.flatnonzero(part) if part.any() else np.arange(len(y))
    x = distance.features(sample[i][0].split() for i in use)
    own = np.array([counts[k] / max((y == k).sum(), 1) for k in (0, 1)])
    pull = own[y[use]] * len(use) / own[y[use]].sum()
    return Model(Distance(*distance.parts), fit_logistic(x, y[use], pull, ridge=0.1))


def trained(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    rows, counts = labelled_sample(documents, labels, label, per_class, sample_bytes)
    got = rows.select(F.col("doc_id").cast("long"), "text", "y").collect()  # at most sample_bytes of each class
    got.sort(key=lambda r: (hash((r.doc_id, 0)) & 0xFFFF, r.doc_id, r.y, r.text))
    return fit([(b" ".join(words(r.text)), r.y) for r in got], counts)


def scored(documents: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, label))  # two dictionaries

    def score(batches):
        own = model.value
        for b in batches:
            p = own.scores([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64())], ["doc_id", "held_out", "score"])

    rows = documents.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that aren't predicted to be toxic, in one pass over them."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents, labels))
    at = documents.columns.index("text")

    def keep(batches):
        own = model.value
        for b in batches:
            p = own.scores([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(p < threshold))

    return documents.mapInArrow(keep, documents.schema)


def op6_query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
