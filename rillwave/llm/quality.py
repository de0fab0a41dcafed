"""Quality classifier: naive-Bayes-scaled n-gram indicators under a linear hinge loss, fitted by dual coordinate descent.

Indicators of a text (all hashed into `dims` columns):

* lower-cased words and pairs of neighbouring words,
* word forms (the set of character classes in a word and the class of its last character), pairs of forms,
* forms, and repetitions of the word before, once more for each share of the text's words that they reach.

Each column is scaled by its class log-count ratio, each row to unit length. Fitting uses a bounded sample of the labelled
rows (`max_rows`, the lowest hashes of doc_id); scoring covers every whole text. Passes over the sample end when no variable
moved by more than `TOLERANCE`, or after `PASSES` with a warning.

Defined results: a null or empty text has the indicator "empty" alone and so gets a score like any other; a very long text
is one row, scored whole; rows with a null label or id are not learned from; several labels of one doc_id count as their
rounded mean, and rows that repeat a labelled doc_id are learned from each; ties in the sample's order go by id and label,
equal texts have equal scores; with labels of one class only, or none, every score is that class's (0.5: none); an empty
table gives no rows; extra columns pass through whatever their names, and one named like the score is replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import crc_bucket, numbered

DIMS = 1 << 18
MAX_ROWS = 6000
SHARES = (0.02, 0.1, 0.3)
PASSES, TOLERANCE = 60, 1e-3

_klass = np.zeros(256, np.uint64)
for _b in range(256):
    if 0x41 <= _b <= 0x5A:
        _bit = 0
    elif 0x61 <= _b <= 0x7A or _b >= 0x80:
        _bit = 1
    elif 0x30 <= _b <= 0x39:
        _bit = 2
    else:
        _bit = 3 + (_b * 7 + (_b >> 4)) % 58
    _klass[_b] = 1 << _bit
_KLASS = _klass


def indicators(raw: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, column) pairs of a block of texts, as two arrays."""
    words = K.Words(raw, offs, K.NOT_SPACE, lower=False)
    n = len(offs) - 1
    keys = [np.flatnonzero(words.counts == 0).astype(np.int64) * dims]
    if len(words):
        low = K.Words(raw, offs, K.NOT_SPACE)
        rows, h = words.rows(), low.hashes
        cut = words.starts
        letters = words.raw[np.flatnonzero(K.NOT_SPACE[words.raw])]
        heads = np.cumsum(words.lengths) - words.lengths
        form = np.bitwise_or.reduceat(_KLASS[letters], heads) * K.U64(31) + _KLASS[words.raw[words.stops - 1]]
        same_row = np.append(rows[1:] == rows[:-1], False)
        pairs = np.flatnonzero(same_row)
        repeat = np.zeros(len(cut), bool)
        repeat[pairs + 1] = h[pairs] == h[pairs + 1]

        def put(row: np.ndarray, value: np.ndarray, kind: int) -> None:
            col = K.mix(value + K.U64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % K.U64(dims - 1) + K.U64(1)
            keys.append(row.astype(np.int64) * dims + col.astype(np.int64))

        put(rows, h, 1)
        put(rows[pairs], h[pairs] * K.U64(3) + h[pairs + 1], 2)
        put(rows[pairs], form[pairs] * K.U64(5) + form[pairs + 1], 3)
        token = np.concatenate((form, np.zeros(int(repeat.sum()), np.uint64)))
        at = np.concatenate((rows, rows[repeat]))
        code, col = np.unique(token, return_inverse=True)
        seen, times = K.distinct(at * len(code) + col, counts=True)
        row, what = seen // len(code), code[seen % len(code)]
        share = times / words.counts[row]
        put(row, what, 4)
        for level, least in enumerate(SHARES):
            often = (share >= least) & (times > 1)
            put(row[often], what[often], 5 + level)
    key = K.distinct(np.concatenate(keys))
    return key // dims, key % dims


@dataclass
class QualityModel:
    """weight: of each column, class log-count ratios included; norm2: squared ratio, for a row's length."""

    weight: np.ndarray
    norm2: np.ndarray
    bias: float
    scale: float

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, col = indicators(raw, offs, len(self.weight))
        n = len(offs) - 1
        dot = np.bincount(row, self.weight[col], n)
        length = np.sqrt(np.bincount(row, self.norm2[col], n))
        margin = dot / np.maximum(length, 1e-9) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * margin, -30, 30)))


def log_count_ratios(cols: list[np.ndarray], y: np.ndarray, dims: int, smooth: float = 1.0) -> np.ndarray:
    up, down = np.full(dims, smooth), np.full(dims, smooth)
    for c, label in zip(cols, y, strict=True):
        (up if label > 0 else down)[c] += 1
    return np.log((up / up.sum()) / (down / down.sum()))


def dual_coordinate_descent(cols: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, passes: int = PASSES, seed: int = 11) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM: one dual variable at a time goes to its optimum within [0, C]; C is balanced between the classes. A warning tells where the passes end before the tolerance is met."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    top = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    values = [ratio[c] / max(1e-9, np.sqrt((ratio[c] ** 2).sum())) for c in cols]
    rng = np.random.default_rng(seed)
    moved = 0.0
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (values[i] @ w[cols[i]] + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), top[i])  # rows have length 1, and 1 more for the bias
            step = (new - alpha[i]) * y[i]
            if step:
                w[cols[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < TOLERANCE:
            break
    else:
        if len(y):
            warnings.warn(f"after {passes} passes a variable still moved by {moved:.2g}", stacklevel=2)
    return w, bias


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, dims: int = DIMS) -> QualityModel:
    """Learn from at most `max_rows` labelled rows; callers leave held-out rows out of `labels`.

    Of the rows that share an id one is learned from, that of the text with the least hash.
    """
    # the join below sends at most max_rows pairs of an id and a label
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_rows)
        .groupBy("_id")
        .agg(F.round(F.avg("_y")).cast("int").alias("_y"))
    )
    chosen = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    # one row an id, so no more rows than ids are collected, however often an id occurs
    order = F.struct(F.xxhash64("_text"), F.coalesce("_text", F.lit("")))
    chosen = chosen.groupBy("_id", "_y").agg(F.min_by("_text", order).alias("_text"))

    @K.released
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column("_text"))
            out = []
            for lo, hi in K.blocks(offs):
                row, col = indicators(raw, offs[lo : hi + 1], dims)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                out += [col[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_y"), pa.array(out, pa.binary())], names=["id", "y", "cols"])

    rows = sorted(chosen.mapInArrow(featurise, "id string, y int, cols binary").collect(), key=lambda r: (len(r.id), r.id, r.cols))
    y = np.array([1 if r.y > 0 else -1 for r in rows])
    if not len(y) or abs(y.sum()) == len(y):
        return QualityModel(np.zeros(dims), np.zeros(dims), float(np.sign(y.sum())) * 5, 4.0)
    cols = [np.frombuffer(r.cols, np.int32) for r in rows]
    ratio = log_count_ratios(cols, y, dims)
    w, bias = dual_coordinate_descent(cols, y, ratio)
    return QualityModel((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 4.0)


def score(documents: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows of `documents` (all columns, or those in `keep`) with the score of the whole text; the model's size is fixed by `dims`."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in documents.schema.fields if f.name != score_col and (keep is None or f.name in keep)]
    columns = [f.name for f in fields]
    names = [*columns, *([] if text_col in columns else [text_col])]
    read, text = numbered(documents, names), names.index(text_col)

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(text))
            parts = [sent.value.scores(raw, offs[lo : hi + 1]) for lo, hi in K.blocks(offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*columns, score_col])

    return read.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))


def train_labels(labels: DataFrame, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text is not `held_out` modulo `modulus`."""
    return labels.where(crc_bucket(id_col, modulus) != held_out)
