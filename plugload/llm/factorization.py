"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x. Its score is the logistic function of

    bias + sum_i w_i x_i + sum_(i < j) <v_i, v_j> x_i x_j,

where each feature has a vector v_i of ``RANK`` numbers. The double sum equals half of the sum over the ranks of
(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2, so a document is scored in time linear in its features.

Features are the document's words, hashed to buckets, with log counts scaled to length one; statistics of its structure,
each as one of ``BINS`` intervals whose borders are quantiles of the training rows; and numeric metadata columns, treated
likewise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plugload.llm.common import as_bytes, slices
from plugload.session import materialized

BUCKET_BITS = 20
RANK = 8
BINS = 8
#: Bound of the labelled rows that are learnt from, and the partitions they are counted in.
MAX_TRAIN_ROWS = 16_384
TRAIN_PARTITIONS = 8
#: Word buckets that the model keeps.
MAX_WORDS = 2_048
MIN_DOCS = 4
#: Passes over the training rows, and gradient steps at least.
EPOCHS = 12
MIN_STEPS = 300
BATCH = 512
_CACHE = 200_000

STATISTICS = [
    "bytes", "words", "bytes_per_word", "lines", "words_per_line", "distinct_words", "repeated_lines", "upper", "digits", "sentence_marks",
    "commas", "exclamations", "symbols", "brackets", "blanks", "non_ascii", "longest_word",
]
# The ASCII characters that a statistic counts.
_CLASSES = {
    "upper": bytes(range(65, 91)), "digits": b"0123456789", "sentence_marks": b".?", "commas": b",;:", "exclamations": b"!",
    "symbols": b"#*$%&|<>@^~=+_\\/", "brackets": b"()[]{}\"'`", "blanks": b" \t\n\x0b\x0c\r",
}


def _class_matrix() -> np.ndarray:
    matrix = np.zeros((256, len(_CLASSES) + 1))
    for k, members in enumerate(_CLASSES.values()):
        matrix[list(members), k] = 1
    matrix[128:, -1] = 1
    return matrix


_MATRIX = _class_matrix()


class Words:
    """Buckets of words, remembered for a bounded number of them."""

    def __init__(self, bits: int = BUCKET_BITS):
        self.bits, self.known = bits, {}

    def bucket(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            found = self.known[word] = xxhash.xxh64_intdigest(word) >> (64 - self.bits)
        return found

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of a text, ascending, and log(1 + count) of each, scaled to length one."""
        times = Counter(words)
        buckets = np.fromiter(map(self.bucket, times), np.int64, len(times))
        some, place = np.unique(buckets, return_inverse=True)
        weight = np.log1p(np.bincount(place, np.fromiter(times.values(), float, len(times))) if len(times) else np.empty(0))
        return some, weight / max(np.sqrt((weight * weight).sum()), 1e-12)


def structure(text: bytes, words: list[bytes]) -> np.ndarray:
    """The values of STATISTICS for one text."""
    n, m = max(len(text), 1), max(len(words), 1)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MATRIX / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m, np.log1p(len(lines)), m / max(len(lines), 1),
        len(set(words)) / m, 1 - len(set(lines)) / max(len(lines), 1), *shares, np.log1p(max(map(len, words), default=0)),
    ])


def _split(text: bytes) -> list[bytes]:
    return text.lower().split()


# -- learning ---------------------------------------------------------------------------------------------------------


def training_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, metadata: Sequence[str], max_rows: int
) -> DataFrame:
    """(hash, label, text, metadata) of at most ``max_rows`` labelled documents, those of the least hashes of the id.

    Of repeated labels of an id the greatest counts, of repeated documents the one whose text comes first. The ids are
    bounded, so they are broadcast and texts are only shuffled where their document is chosen.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.withColumn("hash", F.xxhash64("_id", F.lit(12))).orderBy("hash", "_id").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.struct(as_bytes(text).alias("text"), _numbers(metadata)).alias("row"))
    rows = rows.join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_id", "hash", "label").agg(F.min("row").alias("row"))
    return rows.select("hash", "label", "row.text", "row.numbers").repartition(TRAIN_PARTITIONS)


def _numbers(metadata: Sequence[str]) -> Column:
    """Metadata as doubles; what is missing or no number is NaN."""
    values = [F.coalesce(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in metadata]
    return F.array(*values).cast("array<double>").alias("numbers")


def _presence(rows: DataFrame, bits: int) -> np.ndarray:
    """counts[label, bucket]: training documents that hold a word of the bucket. One pair of vectors per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashed = np.zeros((2, 1 << bits), np.int32), Words(bits)
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                counts[int(label > 0), hashed.counts(_split(text.as_py()))[0]] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([
            pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([counts[:, used].tobytes()], pa.binary())
        ], ["buckets", "counts"])

    total = np.zeros((2, 1 << bits))
    for r in rows.mapInArrow(run, "buckets binary, counts binary").collect():
        used = np.frombuffer(bytes(r["buckets"]), np.int32)
        total[:, used] += np.frombuffer(bytes(r["counts"]), np.int32).reshape(2, -1)
    return total


def choose_words(counts: np.ndarray, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> np.ndarray:
    """The buckets, ascending, whose presence depends most on the label, by the likelihood ratio."""
    seen, totals = counts.sum(axis=0), np.maximum(counts.sum(axis=1, keepdims=True), 1)
    rows = max(counts.max(initial=1), 1)
    expected = np.maximum(seen * totals / totals.sum(), 1e-12)
    strength = (np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-12) / expected), 0)).sum(axis=0) / rows
    strength = np.where(seen >= min_docs, np.abs(strength) + seen * 1e-12, 0)
    best = np.argsort(-strength, kind="stable")[:max_words]
    return np.sort(best[strength[best] > 0])


@dataclass(frozen=True)
class Model:
    """words: the kept buckets; borders: of each statistic and metadata column; weights and factors of all features.

    Features are the words, then per statistic or column BINS + 1 intervals, the last for missing values.
    """

    words: np.ndarray
    borders: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    bits: int = BUCKET_BITS

    def features(self, text: bytes, numbers: Sequence[float], hashed: Words) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of one document."""
        words = _split(text)
        buckets, weight = hashed.counts(words)
        at = np.searchsorted(self.words, buckets)
        here = np.flatnonzero(at < len(self.words))
        here = here[self.words[at[here]] == buckets[here]]
        values = np.concatenate([structure(text, words), numbers])
        binned = len(self.words) + _bins(values, self.borders)
        return np.concatenate([at[here], binned]), np.concatenate([weight[here], np.full(len(binned), 1 / np.sqrt(max(len(binned), 1)))])


def _bins(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    inside = (values[:, None] > borders).sum(axis=1)
    return np.arange(len(values)) * (BINS + 1) + np.where(np.isnan(values), BINS, inside)


def margins(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """bias + linear part + pairwise part of documents given as (features, values), by the sum-of-squares identity."""
    sizes = np.array([len(f) for f, _ in rows])
    feature, value = np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    parts = model.factors[feature] * value[:, None]
    total = np.add.reduceat(parts, starts, axis=0)
    squares = np.add.reduceat(parts * parts, starts, axis=0)
    linear = np.add.reduceat(model.weights[feature] * value, starts)
    return model.bias + linear + 0.5 * (total * total - squares).sum(axis=1)


def fit_machine(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_features: int, rank: int = RANK, epochs: int = EPOCHS,
    penalty: float = 2e-4, rate: float = 0.02, seed: int = 0,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by adaptive gradient steps on the logistic loss, in a fixed order of the rows."""
    rng = np.random.default_rng(seed)
    share = (label.sum() + 0.5) / (len(label) + 1)
    bias = np.array([np.log(share / (1 - share))])
    parameters = [bias, np.zeros(n_features), rng.normal(0, 0.05, (n_features, rank))]
    batches = -(-len(rows) // BATCH)
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    step = 0
    for _ in range(max(epochs, -(-MIN_STEPS // batches))):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            some = order[start : start + BATCH]
            x = np.zeros((len(some), n_features))
            for k, i in enumerate(some):
                x[k, rows[i][0]] = rows[i][1]
            bias, weights, factors = parameters
            inner, square = x @ factors, x * x
            margin = bias + x @ weights + 0.5 * (inner * inner - square @ (factors * factors)).sum(axis=1)
            residual = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label[some]) / len(some)
            gradients = [
                np.array([residual.sum()]), x.T @ residual + penalty * weights,
                x.T @ (inner * residual[:, None]) - factors * (square.T @ residual)[:, None] + penalty * factors,
            ]
            step += 1
            for k, g in enumerate(gradients):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                parameters[k] = parameters[k] - rate * move
    return float(parameters[0][0]), parameters[1], parameters[2]


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    metadata: Sequence[str] = (), max_rows: int = MAX_TRAIN_ROWS, max_words: int = MAX_WORDS, bits: int = BUCKET_BITS,
) -> Model:
    """Learn from at most ``max_rows`` of the labelled documents; labels are 0 or 1, null labels are left out.

    The chosen rows do not depend on how the tables are spread, nor does the model. Without labelled rows, or with one
    class only, the model has no weights and gives the share of class 1 (0.5 without any row).
    """
    rows = materialized(training_rows(docs, labels, doc_id, text, label, metadata, max_rows))
    words = choose_words(_presence(rows, bits), max_words)
    blank = Model(words, np.zeros((len(STATISTICS) + len(metadata), BINS - 1)), 0.0, np.empty(0), np.empty(0), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, statistics = Words(bits), len(STATISTICS) + len(metadata)
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for text, numbers in zip(batch.column(2), batch.column(3).to_pylist()):
                data = text.as_py()
                feature, value = blank.features(data, numbers, hashed)
                feature, value = feature[:-statistics], value[:-statistics]
                found.append((feature.astype(np.int32).tobytes(), value.tobytes(), np.append(structure(data, _split(data)), numbers).tobytes()))
            packed = [pa.array(c, pa.binary()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["hash", "label", "feature", "value", "numbers"])

    got = rows.mapInArrow(run, "hash bigint, label int, feature binary, value binary, numbers binary").toArrow()
    examples = sorted(zip(*(c.to_pylist() for c in got.columns)))  # at most max_rows, each with max_words features at most
    marks = np.array([x[1] > 0 for x in examples], float)
    n_features = len(words) + len(blank.borders) * (BINS + 1)
    if not 0 < marks.sum() < len(marks):
        share = (marks.sum() + 0.5) / (len(marks) + 1)
        return Model(words, blank.borders, float(np.log(share / (1 - share))), np.zeros(n_features), np.zeros((n_features, RANK)), bits)
    values = np.array([np.frombuffer(x[4]) for x in examples])
    borders = np.array([_quantiles(column) for column in values.T])
    binned = len(words) + np.array([_bins(v, borders) for v in values])
    weight = 1 / np.sqrt(binned.shape[1])
    sparse = [
        (np.append(np.frombuffer(x[2], np.int32), b), np.append(np.frombuffer(x[3]), np.full(len(b), weight)))
        for x, b in zip(examples, binned)
    ]
    return Model(words, borders, *fit_machine(sparse, marks, n_features), bits)


def _quantiles(values: np.ndarray) -> np.ndarray:
    known = values[~np.isnan(values)]
    return np.quantile(known, np.arange(1, BINS) / BINS, method="lower") if len(known) else np.zeros(BINS - 1)


# -- scoring ----------------------------------------------------------------------------------------------------------


def score_texts(texts: list[bytes], numbers: Sequence[Sequence[float]], model: Model, hashed: Words | None = None) -> np.ndarray:
    """Probability of label 1 for each text with its metadata."""
    hashed = hashed or Words(model.bits)
    margin = margins(model, [model.features(t, n, hashed) for t, n in zip(texts, numbers)])
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def score(
    docs: DataFrame, model: Model, metadata: Sequence[str] = (), carry: Sequence[str] | None = None, text: str = "text",
    name: str = "score",
) -> DataFrame:
    """The ``carry`` columns of all rows (all columns unless given) with the score of the whole text.

    One narrow pass without shuffle. A null text scores as an empty one, missing metadata have an interval of their
    own; equal rows score alike; an empty table stays empty. A column of the new name is replaced.
    """
    kept = [c for c in (carry or docs.columns) if c != name]
    row = F.struct(*kept).alias("row")  # one column, so that no name can clash
    schema = StructType([docs.select(row).schema["row"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words(model.bits)
        for batch in slices(batches, "text", 1 << 20):
            scores = score_texts([t.as_py() for t in batch.column(1)], batch.column(2).to_pylist(), model, hashed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "score"])

    scored = docs.select(row, as_bytes(text).alias("text"), _numbers(metadata)).mapInArrow(run, schema)
    return scored.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("score").alias(name))
