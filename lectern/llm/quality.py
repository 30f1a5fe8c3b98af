"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is cut into runs of letters, digits or marks. Its features are the run
itself, the pair with the run before (equal neighbours share one feature) and the
shapes of three runs in line, all hashed into a table of ``2**BITS`` weights; a
feature counts by its share of the text. A score is a sparse dot product.

Rows: a null or empty text has no features and scores by the intercept alone; a
null doc_id is scored and not held out; repeated rows score alike; without labels
every score is one half. Labels enter by doc_id only. A very long text is walked in
slices; it has at most 2**BITS different features, and learning stops taking rows
beyond FEATURES_HELD.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, plain, schema, texts_of
from .rules import DIGIT, LOWER, UPPER, _traits
from .vec import BLANK, U64, code_points, mix, mix_int, offsets, per_document, slices, span_hashes

BITS = 18
#: Labelled rows learned from at most, taken in the order of a hash of doc_id.
LABELLED = 8000
#: Features of the rows learned from at most (rows beyond are left out), which bounds what the learning task holds at about 200 MB.
FEATURES_HELD = 12_000_000
EPOCHS = 6
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-5, 1e-5
#: Feature values are shares of a text times this.
SCALE = 8.0

_REPEAT = mix_int(11)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 blank, 1 letter, 2 digit, 3 mark."""
    t = _traits()
    out = np.full(0x110000, 3, np.uint8)
    out[(t & (LOWER | UPPER)) > 0] = 1
    out[t == DIGIT] = 2
    out[BLANK] = 0
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all features of the texts, and where those of each text begin."""
    kinds, traits = _kinds(), _traits()
    hs, shapes, owners = [], [], []
    for docs, at, joined in slices(texts):
        codes = code_points(joined)
        kind = kinds[codes]
        edge = np.zeros(len(codes) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[at] = True
        cuts = np.flatnonzero(edge)
        start, end = cuts[:-1], cuts[1:]
        solid = kind[start] > 0
        start, end = start[solid], end[solid]
        upper = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(traits[codes] == UPPER, out=upper[1:])
        n_upper, size = upper[end] - upper[start], end - start
        first = traits[codes[start]] == UPPER
        case = np.where(n_upper == 0, 0, np.where(n_upper == size, np.where(size > 1, 3, 1), np.where(first & (n_upper == 1), 1, 2)))
        h = span_hashes(codes, start, end)
        k = kind[start]
        shape = (k.astype(np.int64) * 4 + case) * 8 + np.minimum(size, 7) * (k > 1)
        shape = np.where(k == 3, (h & U64(0xFFFFFF)).astype(np.int64) + 4096, shape)
        hs.append(h)
        shapes.append(shape.astype(U64))
        owners.append(docs[np.searchsorted(at, start, "right") - 1])
    h = np.concatenate(hs) if hs else np.zeros(0, U64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    shape, doc = np.concatenate(shapes), np.concatenate(owners)
    off = offsets(doc, len(texts))
    n = len(h)
    pos = np.arange(n) - off[doc]
    one = mix(h + U64(1))
    before = np.concatenate([h[:1], h[:-1]])
    two = np.where(h == before, U64(_REPEAT), mix(before * U64(0x9E3779B97F4A7C15) + h + U64(2)))
    two = np.where(pos >= 1, two, mix(h + U64(3)))
    s1 = np.concatenate([shape[:1], shape[:-1]])
    s2 = np.concatenate([shape[:2], shape[:-2]])[:n]
    s1, s2 = np.where(pos >= 1, s1, U64(1)), np.where(pos >= 2, s2, U64(1))
    three = mix((s2 * U64(0xC2B2AE3D27D4EB4F) + s1) * U64(0x165667B19E3779F9) + shape + U64(4))
    shift = U64(64 - BITS)
    return (np.stack([one, two, three], axis=1) >> shift).astype(np.int64).ravel(), off * 3


class Model:
    """Weights of the hashed features and an intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str]) -> np.ndarray:
        idx, off = grams(texts)
        share = SCALE / np.maximum(np.diff(off), 1)
        logit = self.bias + per_document(self.weights[idx].astype(np.float64), off) * share
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """Follow the regularised leader, coordinate by coordinate, over rows (label, feature indices, values) in their order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for label, idx, val in rows:
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ val, -40, 40)))
            g = (p - label) * val
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[idx] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def label_sample(labels: DataFrame, rows: int, keep=None) -> DataFrame:
    """At most ``rows`` labelled (doc_id, quality), in the order of a hash; of several labels of a document the lowest."""
    named = plain(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    if keep is not None:
        named = named.where(keep)
    named = named.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _feature_maker():
    def step(batch: pa.RecordBatch):
        idx, off = grams(texts_of(batch.column("text")))
        rows = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            u, c = np.unique(idx[a:b], return_counts=True)
            rows.append((u.astype(np.int32), (c * (SCALE / max(b - a, 1))).astype(np.float32)))
        return [batch.column("doc_id"), batch.column("quality"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))]

    return step


def _trainer(batches):
    rows, held = [], 0
    for b in batches:
        for y, i, v in zip(b.column("quality").to_pylist(), b.column("idx"), b.column("val"), strict=True):
            held += len(i.values)
            if held > FEATURES_HELD:
                break
            idx = np.append(np.asarray(i.values, np.int64), 1 << BITS)
            rows.append((min(max(y, 0), 1), idx, np.append(np.asarray(v.values, np.float64), 1.0)))
    m = train(rows)
    yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], names=["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Model:
    """Learns from at most ``rows`` labelled documents outside the held-out fold, in one task; the weights come to the driver (1 MB)."""
    sample = label_sample(labels, rows, ~held_out())
    named = plain(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    vectors = arrow_map(named, _feature_maker, "doc_id long, quality int, idx array<int>, val array<float>")
    ordered = vectors.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = ordered.mapInArrow(_trainer, schema("weights binary, bias double")).collect()
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["bias"])


def held_out(column: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, in one pass and without a shuffle."""

    def make():
        def step(batch: pa.RecordBatch):
            s = model.score(texts_of(batch.column("text")))
            return [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return step

    named = plain(docs, "doc_id", "text").withColumn("held_out", held_out())
    return arrow_map(named, make, "doc_id long, held_out boolean, score double, predicted int")
