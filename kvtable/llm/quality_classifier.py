"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of hashed n-grams: byte n-grams of the text, byte
n-grams of its shape (letters, capitals and digits each mapped to one
symbol) and n-grams of equal neighbouring words.  Each indicator is scaled by
its class log-count ratio ``r``, counted over all training labels, and the
scaled vector is brought to unit length.  A linear hinge-loss model is fitted
to these by dual coordinate descent with a bias feature and class weights,
and Platt's sigmoid, fitted on training rows that the descent did not see,
turns margins into scores from 0 to 1.

Counting is distributed; the descent runs on the driver over at most
``max_per_class`` rows and ``max_bytes`` of n-gram numbers of each class (the
bounds of the sample, taken by hash order).  The model is a few arrays of ``N_FEATURES`` numbers.  Scoring is
map-only and reads nothing but the text.

NULL texts count as empty; texts without n-grams score by the bias alone.
If the training labels lack a class the score is constant: 0 if there are
only labels 0, else 1 (nothing is known against any text).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import in_slices, released
from kvtable.llm.labels import held_out, with_labels
from kvtable.llm.shared import removed, written

N_FEATURES = 1 << 16
MAX_PER_CLASS = 3000
#: Bytes of n-gram numbers (two each) that the driver takes of each class: all of the rows above, unless many texts are very long.
MAX_BYTES = 96 << 20
RAW_GRAM, SHAPE_GRAMS = 4, (2, 5)
MAX_EQUAL_RUN = 5
ACCEPT = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


def _hashed(data: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Feature numbers of the byte n-grams of ``data``."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(size, salt, np.uint64)
    for k in range(n):
        value = (value ^ data[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value & np.uint64(N_FEATURES - 1)


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-grams that occur in the text."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    seen = np.zeros(N_FEATURES, bool)
    seen[_hashed(data, RAW_GRAM, 1)] = True
    shape = _SHAPE[data]
    for n in SHAPE_GRAMS:
        seen[_hashed(shape, n, 100 + n)] = True
    words = text.split()
    run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        if 1 < run <= MAX_EQUAL_RUN:
            seen[_hashed(np.array([run], np.uint8), 1, 200)] = True
    return np.flatnonzero(seen).astype(np.uint16)


@dataclass(frozen=True)
class Model:
    """``weights`` already include the log-count ratios; ``ratios`` give the length of a text's vector."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def margin(self, numbers: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratios[numbers]).sum()))
        return (float(self.weights[numbers].sum()) / length if length else 0.0) + self.bias

    def score(self, numbers: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(numbers) + self.offset
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def _numbers(text: Column) -> Column:
    """BINARY: the feature numbers as little-endian 16-bit integers."""

    @F.arrow_udf("binary")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            yield pa.array([features(t).tobytes() for t in in_slices(texts)], pa.binary())

    return extract(text)


def _log_count_ratios(labelled: DataFrame, text_col: str) -> np.ndarray:
    """Over all labelled rows, with add-one smoothing; a task sends at most one row per feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, N_FEATURES), np.int64)
        for batch in released(batches):
            for text, label in zip(in_slices(batch.column(0)), in_slices(batch.column(1)), strict=True):
                counts[1 if label else 0][features(text)] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["f", "n0", "n1"]
        )

    parts = labelled.select(text_col, "label").mapInArrow(count, "f int, n0 bigint, n1 bigint")
    rows = parts.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    total = np.ones((2, N_FEATURES))
    at = rows.column("f").to_numpy()
    total[0][at] += rows.column("n0").to_numpy()
    total[1][at] += rows.column("n1").to_numpy()
    return np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())


class Vectors(Sequence):
    """The rows' scaled vectors with the bias feature, made from the 16-bit numbers when asked for."""

    def __init__(self, numbers: list[bytes], ratios: np.ndarray, bias_value: float):
        self.numbers, self.ratios, self.bias_value = numbers, ratios, bias_value

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(self.numbers[i], "<u2").astype(np.int64)
        values = self.ratios[at]
        length = np.sqrt(values @ values)
        return np.append(at, N_FEATURES), np.append(values / length if length else values, self.bias_value)


def dual_coordinate_descent(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, costs: np.ndarray, n: int, epochs: int = 30, tol: float = 0.01
) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model; rows are (feature numbers, values)."""
    w, alpha = np.zeros(n), np.zeros(len(rows))
    square = np.array([v @ v for _, v in rows])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            gradient = y[i] * (w[at] @ values) - 1
            projected = min(gradient, 0) if alpha[i] <= 0 else max(gradient, 0) if alpha[i] >= costs[i] else gradient
            worst = max(worst, abs(projected))
            if projected and square[i]:
                new = min(max(alpha[i] - gradient / square[i], 0.0), costs[i])
                w[at] += (new - alpha[i]) * y[i] * values
                alpha[i] = new
        if worst < tol:
            break
    return w


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    b = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(b):
        z = x @ b
        return float(np.logaddexp(0, z).sum() - target @ z) + 1e-3 * b[0] ** 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        gradient = x.T @ (p - target) + np.array([2e-3 * b[0], 0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    max_per_class: int = MAX_PER_CLASS,
    max_bytes: int = MAX_BYTES,
    cost: float = 1.0,
    bias_value: float = 0.3,
) -> Model:
    """``labels`` are the training rows, ``doc_id, label``."""
    flat = np.zeros(N_FEATURES)
    counts = {int(r["label"]): r["count"] for r in labels.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model(flat, flat, 0.0, 0.0, 0.0, constant=0.0 if counts.get(0) else 1.0)
    ratios = _log_count_ratios(with_labels(docs.select("doc_id", text_col), labels), text_col)
    parts = [labels.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for c in (0, 1)]
    sample = parts[0].union(parts[1])
    numbers, path = written(
        with_labels(docs.select("doc_id", text_col), sample).select(
            "doc_id", "label", _numbers(F.col(text_col)).alias("f"), held_out(folds=3, fold=1).alias("late"), F.xxhash64("doc_id").alias("h")
        )
    )
    taken = F.lit(False)  # up to this place in the hash order of a class the bytes are within the bound
    for c in (0, 1):
        sizes = sorted(tuple(r) for r in numbers.where(F.col("label") == c).select("h", F.octet_length("f")).collect())
        upto = np.cumsum([n for _, n in sizes]) <= max_bytes
        if upto.any():
            taken = taken | ((F.col("label") == c) & (F.col("h") <= sizes[int(upto.sum()) - 1][0]))
    rows = sorted(numbers.where(taken).select("doc_id", "label", "f", "late").collect(), key=lambda r: (r["doc_id"], bytes(r["f"])))
    removed(docs.sparkSession, path)
    y = np.array([1.0 if r["label"] else -1.0 for r in rows])
    late = np.array([r["late"] for r in rows], bool)
    if len(set(y[late])) < 2 or len(set(y[~late])) < 2:
        late = np.ones(len(rows), bool)  # too few rows to set some aside
        early = late
    else:
        early = ~late
    if len(set(y)) < 2:
        return Model(flat, flat, 0.0, 0.0, 0.0, constant=0.0 if counts.get(0) and (len(y) == 0 or y[0] < 0) else 1.0)

    share = np.where(y > 0, 2 * (y > 0).mean(), 2 * (y < 0).mean())
    descended = np.flatnonzero(early)
    vectors = Vectors([rows[i]["f"] for i in descended], ratios, bias_value)
    w = dual_coordinate_descent(vectors, y[early], (cost / share)[early], N_FEATURES + 1)
    model = Model(w[:-1] * ratios, ratios, float(w[-1] * bias_value), 1.0, 0.0)
    margins = np.array([model.margin(np.frombuffer(rows[i]["f"], "<u2")) for i in np.flatnonzero(late)])
    slope, offset = platt(margins, y[late])
    # the sample is even by class, the labels are not: shift the log odds to the labels' own
    shift = np.log(counts[1] / counts[0]) - np.log((y > 0).sum() / (y < 0).sum())
    return Model(model.weights, ratios, model.bias, slope, offset + float(shift))


def scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``; a column of that name is replaced.

    The model goes to the tasks as two arrays of ``N_FEATURES`` numbers, whatever the corpus.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = sent.value
        for texts in released(batches):
            yield pa.array([fitted.score(features(t)) for t in in_slices(texts)], pa.float64())

    return docs.withColumn(out, score(F.col(text_col)))
