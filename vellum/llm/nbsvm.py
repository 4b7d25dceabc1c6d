"""Quality scores by naive Bayes support vectors.

A text's features are indicators of its byte n-grams (2, 3 and 4 bytes), hashed to 2^18 buckets. Each is scaled by its
class log-count ratio, and a linear hinge-loss model is fitted to the scaled, length-normalised indicators by dual
coordinate descent. A logistic curve fitted to the margins of a part of the sample that the model hasn't seen turns
margins into probabilities.

The model is fitted on at most PER_CLASS labelled rows of each class and SAMPLE_BYTES of their text (the rows of smallest
hash, whole texts, none held out); every document is scored on its whole text. Only bucket numbers of the sample reach the driver.

Defined cases: null text is empty; an empty text has no features, its score is the curve at the intercept; a missing
class gives that class's constant score, no labels at all 0.5; rows with the same doc_id are scored one by one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import M1, mix, texts_of
from .common import fit_logistic, held_out, labelled_sample, probability, table

BITS = 18
SIZES = (2, 3, 4)
PER_CLASS, SAMPLE_BYTES = 4000, 12_000_000
#: Bytes of text whose n-grams are hashed at once.
STEP = 1 << 20


def features(data: np.ndarray) -> np.ndarray:
    """Distinct buckets of a whole text's n-grams, ascending."""
    seen = []
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            if len(part) < n:
                continue
            g = np.full(len(part) - n + 1, n, np.uint64)
            for i in range(n):
                g = (g << np.uint64(8)) | part[i : len(part) - n + 1 + i]
            seen.append(np.unique((mix(g * M1) >> np.uint64(64 - BITS)).astype(np.uint32)))
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint32)


def batch_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every row's distinct n-grams; rows are data[offsets[i]:offsets[i + 1]]."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    left = offsets[1:][row.astype(np.int64)] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    wide = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    keys = []
    g = np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        g = (g << np.uint64(8)) | wide[n - 1 : n - 1 + len(data)]
        if n in SIZES:
            ok = left >= n
            h = mix((g[ok] | np.uint64(n << (8 * n))) * M1) >> np.uint64(64 - BITS)
            keys.append((row[ok] << np.uint64(BITS)) | h)
    k = np.sort(np.concatenate(keys))
    k = k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k
    return (k >> np.uint64(BITS)).astype(np.int64), (k & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: log-count ratio times hinge weight
    bias: float
    curve: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        margin, count = np.zeros(n), np.zeros(n)
        first = 0
        while first < n:  # rows of about STEP bytes at once
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, side="right")) - 1)
            if offsets[last] - offsets[first] > 4 * STEP:
                f = features(data[offsets[first] : offsets[last]])
                margin[first], count[first] = self.weight[f].sum(), len(f)
            else:
                row, f = batch_features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                margin[first:last] = np.bincount(row, self.weight[f], last - first)
                count[first:last] = np.bincount(row, minlength=last - first)
            first = last
        return probability((margin / np.sqrt(np.maximum(count, 1)) + self.bias)[:, None], self.curve)


def hinge_weights(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 1,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model by dual coordinate descent (Hsieh et al.)."""
    sign = 2 * y - 1
    alpha, w, bias = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    x = [ratio[f] / np.sqrt(max(len(f), 1)) for f in rows]
    norm = np.array([v @ v + 1 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            d = (new - alpha[i]) * sign[i]
            if d:
                w[rows[i]] += d * x[i]
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3 * cost.max():
            break
    return w, bias


def fit(sample: list[tuple[np.ndarray, int]], counts: list[int]) -> Model:
    """sample: (buckets, label) of each row, in a fixed order; counts: labelled rows of each class."""
    y = np.array([s[1] for s in sample], int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 0.0, np.array([0.0, 0.0 if not len(y) else (30.0 if y[0] else -30.0)]))
    rows = [s[0] for s in sample]
    part = np.arange(len(y)) % 4 == 3  # for the curve
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    learn = np.flatnonzero(~part)
    seen = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for i in learn:
        seen[y[i]][rows[i]] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    balance = np.array([len(learn) / 2 / max((y[learn] == k).sum(), 1) for k in (0, 1)])
    w, bias = hinge_weights([rows[i] for i in learn], y[learn], ratio, balance[y[learn]])
    weight = ratio * w
    use = np.flatnonzero(part) if part.any() else learn
    margin = np.array([weight[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + bias for i in use])
    own = np.array([counts[k] / max((y == k).sum(), 1) for k in (0, 1)])
    pull = own[y[use]] * len(use) / own[y[use]].sum()
    return Model(weight, bias, fit_logistic(margin[:, None], y[use], pull, ridge=1.0))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, o = texts_of(b.column(1))
        got = [features(data[o[i] : o[i + 1]]).tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), b.column(2)], ["doc_id", "f", "y"])


def trained(
    documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    rows, counts = labelled_sample(documents, labels, label, per_class, sample_bytes)
    got = rows.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(_sampled, "doc_id long, f binary, y int").collect()
    got.sort(key=lambda r: (hash((r.doc_id, 0)) & 0xFFFF, r.doc_id, r.y, bytes(r.f)))
    return fit([(np.frombuffer(r.f, np.uint32), r.y) for r in got], counts)


def scored(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, label))  # 2^18 weights, whatever the input

    def score(batches):
        for b in batches:
            data, o = texts_of(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(model.value.scores(data, o))], ["doc_id", "held_out", "score"],
            )

    rows = documents.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double",
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
