"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plugload.llm.common import released, slices

ORDERS = (3, 4, 5, 6)
#: n-grams are hashed into 2 ** BUCKET_BITS buckets.
BUCKET_BITS = 20
#: Bound of the labelled rows that are learnt from, and the partitions they are counted in.
MAX_TRAIN_ROWS = 16_384
TRAIN_PARTITIONS = 8
#: Features that the classifier keeps.
MAX_FEATURES = 2_000
_CHUNK = 1 << 18
_EDGE = 7


@dataclass(frozen=True)
class Model:
    """Buckets in ascending order, the log-count ratio times the weight of each, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between blanks and an edge mark, and where each text starts."""
    lowered = [f" {t.lower()} \x07" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) for t in lowered])
    codes[codes <= 32] = 32
    codes[ends - 1] = _EDGE
    return codes, np.append(0, ends[:-1])


def _grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order and chunk of bounded size: where the chunk starts, the buckets from there, which stay within a text."""
    longest = max(ORDERS)
    for start in range(0, len(codes), _CHUNK):
        some = codes[start : start + _CHUNK + longest - 1]
        own = min(_CHUNK, len(codes) - start)
        key = some * np.uint32(0x9E3779B1)
        edge = np.flatnonzero(some == _EDGE)
        for n in range(2, longest + 1):
            if len(some) < n:
                break
            key = key[: len(some) - n + 1] * np.uint32(0x01000193) + some[n - 1 :]
            if n not in ORDERS:
                continue
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
            mixed ^= mixed >> np.uint32(13)
            bucket = ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))[:own]
            inside = np.ones(len(bucket), bool)
            for k in range(n):
                at = edge - k
                inside[at[(at >= 0) & (at < len(bucket))]] = False
            yield start, bucket, inside


def _all_present(text: str, place: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text. ``place`` is working space of one number per bucket."""
    codes, _ = _codes([text])
    buckets = np.concatenate([bucket[inside] for _, bucket, inside in _grams(codes)])
    order = np.arange(len(buckets), dtype=np.int32)
    place[buckets] = order  # of equal buckets the last one stays
    return buckets[place[buckets] == order]


def _present(texts: list[str], wanted: np.ndarray, index: np.ndarray, n_features: int) -> np.ndarray:
    """present[text, feature] for the wanted buckets, numbered by index."""
    codes, starts = _codes(texts)
    present = np.zeros((len(texts), n_features), bool)
    for start, bucket, inside in _grams(codes):
        at = np.flatnonzero(inside & wanted[bucket])
        present[np.searchsorted(starts, at + start, "right") - 1, index[bucket[at]]] = True
    return present


def _lookup(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted, index = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS, np.int32)
    wanted[buckets], index[buckets] = True, np.arange(len(buckets))
    return wanted, index


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


# -- learning --------------------------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(text, label) of at most max_rows labelled documents, those of the least hashes of the id, in a fixed number of partitions.

    The ids are bounded, so they are broadcast and the texts are not shuffled for the join.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "label")
    return rows.repartition(TRAIN_PARTITIONS)


def _counts(rows: DataFrame) -> np.ndarray:
    """counts[label, bucket]: documents that hold the bucket. One packed vector of fixed size per training partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, place = np.zeros((2, 1 << BUCKET_BITS), np.int32), np.empty(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for text, label in zip(_texts(batch), batch.column(1).to_pylist()):
                counts[int(label > 0), _all_present(text, place)] += 1
        packed = zlib.compress(counts.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["packed"])

    counts = np.zeros((2, 1 << BUCKET_BITS))
    for r in rows.mapInArrow(run, "packed binary").collect():
        counts += np.frombuffer(zlib.decompress(bytes(r["packed"])), np.int32).reshape(2, -1)
    return counts


def choose_features(counts: np.ndarray, max_features: int, min_docs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with the strongest dependence on the label, ascending, and their log-count ratios."""
    toxic, clean = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    seen = counts.sum(axis=0)
    strength = np.where(seen >= min_docs, ratio * ratio * np.minimum(toxic, clean + toxic), 0)
    best = np.argsort(-strength, kind="stable")[:max_features]
    best = np.sort(best[strength[best] > 0])
    return best, ratio[best]


def _examples(rows: DataFrame, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, document of each present feature, feature) of the bounded training rows, brought to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, index = _lookup(buckets)
        for batch in slices(batches, "text", 1 << 20):
            present = _present(_texts(batch), wanted, index, len(buckets))
            packed = [np.flatnonzero(x).astype(np.int32).tobytes() for x in present]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], ["label", "features"])

    got = rows.mapInArrow(run, "label int, features binary").toArrow()
    lists = [np.frombuffer(x.as_py(), np.int32) for x in got.column("features")]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return np.asarray(got.column("label")), doc, np.concatenate([*lists, np.empty(0, np.int32)])


def fit_logistic(label, doc, feature, scale, penalty: float = 1.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on scale[feature] where present; L-BFGS, squared penalty."""
    values = scale[feature]
    target = label.astype(float)

    def loss(x):
        margin = np.bincount(doc, values * x[feature], len(target)) + x[-1]
        residual = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target
        gradient = np.append(np.bincount(feature, values * residual[doc], len(scale)) + penalty * x[:-1], residual.sum())
        value = np.logaddexp(0, margin).sum() - (target * margin).sum() + penalty / 2 * (x[:-1] ** 2).sum()
        return value, gradient

    x = np.zeros(len(scale) + 1)
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, alphas = -gradient, []
        for s, y in reversed(steps):
            alphas.append(s @ direction / (s @ y))
            direction = direction - alphas[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            direction = direction + (a - y @ direction / (s @ y)) * s
        size, slope = (1.0 if steps else 1 / max(np.abs(gradient).sum(), 1e-9)), gradient @ direction
        while True:
            new = x + size * direction
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = new - x, new_gradient - gradient
        done = value - new_value <= 1e-7 * abs(value)
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
        if s @ y > 1e-10:
            steps = [*steps[-9:], (s, y)]
    return x[:-1], float(x[-1])


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_FEATURES,
) -> Model:
    """Learn from at most ``max_rows`` of the labelled documents; labels are 0 or 1, null labels are left out.

    Only the labels' ids choose the rows; the score sees nothing but text. Without labelled rows, or with one class
    only, the model has no features and gives the share of class 1 (0.5 without any row).
    """
    rows = training_rows(docs, labels, doc_id, text, label, max_rows).persist()
    try:
        counts = _counts(rows)
        buckets, ratio = choose_features(counts, max_features)
        marks, doc, feature = _examples(rows, buckets)
    finally:
        rows.unpersist()
    positive = int(marks.sum())
    if not 0 < positive < len(marks):
        share = (positive + 0.5) / (len(marks) + 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    weights, bias = fit_logistic(marks, doc, feature, ratio)
    return Model(buckets, weights * ratio, bias)


# -- scoring ---------------------------------------------------------------------------------------------------------


def score_texts(texts: list[str], model: Model, lookup: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Probability of label 1 for each text."""
    present = _present(texts, *(lookup or _lookup(model.buckets)), len(model.buckets))
    margin = present @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def score(
    docs: DataFrame, model: Model, carry: Sequence[str] | None = None, text: str = "text", name: str = "score"
) -> DataFrame:
    """The ``carry`` columns of all rows (all columns unless given) with the score of the whole text.

    One narrow pass without shuffle. A null text scores as an empty one; repeated rows score alike; an empty table
    stays empty. A column of the new name is replaced.
    """
    kept = [c for c in (carry or docs.columns) if c != name]
    row = F.struct(*kept).alias("row")  # one column, so that no name can clash
    schema = StructType([docs.select(row).schema["row"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(model.buckets)
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(_texts(batch), model, lookup))], ["row", "score"])

    scored = docs.select(row, F.col(text).alias("text")).mapInArrow(released(run), schema)
    return scored.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("score").alias(name))
