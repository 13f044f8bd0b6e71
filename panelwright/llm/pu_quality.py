"""A quality classifier from trusted positives and unlabelled texts (positive-unlabelled learning).

Texts become numbers that do not depend on the language: shares of bytes,
repeated words and shingles, lengths.  Each is cut into bins at its quantiles.
A logistic model minimises the non-negative unbiased risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

by Newton steps.  Every step sums gradient and curvature over all rows in
tasks; only matrices of model size meet at the driver.  The class prior is the
least ratio of unlabelled to positive mass above a score, as a region without
negatives attains it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import frozen
from .shared_arrays import per_group
from .words import Words, chunks

FEATURES = (
    "log_words", "word_bytes", "distinct", "top_word", "same_as_next", "repeated_shingles", "upper", "digits", "bars",
    "calls", "symbols", "stops", "lines", "symbol_ends", "short_words", "non_ascii", "line_words", "single_bytes",
)
BINS = 8
STEPS = 8
RIDGE, RIDGE_ROWS = 1e-4, 5
#: Buckets in which partial sums meet before they reach the driver.
BUCKETS = 16
_ENDS = np.array([b < 128 and not chr(b).isalnum() and chr(b) not in ",.;:?'\"-)" for b in range(256)])
_SYMBOLS = np.array([b < 128 and chr(b) in "#$%&*^~@=+_<>\\/{}[]" for b in range(256)])


def _per_doc(codes: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different codes in each text, and how often its most frequent one occurs."""
    keys = np.sort((doc.astype(np.uint64) << np.uint64(42)) | (codes >> np.uint64(22)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    owner = (keys[first] >> np.uint64(42)).astype(int)
    most = np.zeros(rows)
    np.maximum.at(most, owner, np.diff(np.append(first, len(keys))))
    return np.bincount(owner, minlength=rows), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    words = Words(texts)
    rows, doc = len(texts), words.doc_of_word()
    size = np.diff(words.offsets)
    letters = np.zeros((rows, 256))
    if len(words.data):
        owner = np.repeat(np.arange(rows, dtype=np.int64), size)
        letters = np.bincount(owner * 256 + words.data, minlength=rows * 256).reshape(rows, 256)
    hashes, count, length = words.hashes(), words.count, words.end - words.start

    def share(part, whole):
        return part / np.maximum(whole, 1)

    def words_where(mask):
        return share(np.bincount(doc[mask], minlength=rows), count)

    distinct, most = _per_doc(hashes, doc, rows)
    starts = words.windows(5)
    own = doc[starts] if len(starts) else np.zeros(0, int)
    shingles = np.bincount(own, minlength=rows)
    different, _ = _per_doc(Words.window_hashes(hashes, starts, 5) if len(starts) else hashes[:0], own, rows)
    next_same = np.zeros(len(hashes), bool)
    next_same[:-1] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    upper, lower = letters[:, 65:91].sum(1), letters[:, 97:123].sum(1)
    lines = letters[:, 10]
    return np.column_stack([
        np.log1p(count), share(np.bincount(doc, length, rows), count), share(distinct, count), share(most, count),
        words_where(next_same), share(shingles - different, shingles), share(upper, upper + lower),
        share(letters[:, 48:58].sum(1), size), share(letters[:, 124], size), share(letters[:, 33], size),
        share(letters[:, _SYMBOLS].sum(1), size), share(letters[:, [44, 46]].sum(1), size), share(lines, size),
        words_where(_ENDS[words.data[words.end - 1]]) if len(hashes) else np.zeros(rows), words_where(length <= 3),
        share(letters[:, 128:].sum(1), size), np.log1p(share(count, lines + 1)), words_where(length == 1),
    ])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        values = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c) for c in values.T]], ["id", *FEATURES]
        )


def design(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A constant and, for each feature, marks of the bins that it lies above."""
    columns = [np.ones(len(values))]
    for i, cuts in enumerate(edges):
        columns += [(values[:, i] > cut).astype(float) for cut in cuts]
    return np.column_stack(columns)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


def _moments(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over unlabelled and positive rows: number, losses, gradients, curvatures and score histogram."""
    size = len(weights)
    total = np.zeros((2, 3 + 2 * size + size * size + 400))
    for batch in batches:
        x = design(_values(batch), edges)
        g = x @ weights
        p = _sigmoid(g)
        for kind, mask in enumerate((np.ones(len(g), bool), batch.column("positive").to_numpy(zero_copy_only=False))):
            own, score, chance = x[mask], g[mask], p[mask]
            curve = (own * (chance * (1 - chance))[:, None]).T @ own
            bins = np.bincount(np.clip((score + 20) * 10, 0, 399).astype(int), minlength=400)
            total[kind] += np.concatenate([
                [len(score), np.logaddexp(0, score).sum(), np.logaddexp(0, -score).sum()], own.sum(0),
                (own * chance[:, None]).sum(0), curve.ravel(), bins,
            ])
    bucket = TaskContext.get().partitionId() % BUCKETS
    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([total.tobytes()])], ["bucket", "sums"])


def _add(key: tuple, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blobs = [b for batch in batches for b in batch.column("sums").to_pylist()]
    total = sum(np.frombuffer(b) for b in blobs)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])


class _Sums:
    def __init__(self, rows: DataFrame, edges: list[np.ndarray], weights: np.ndarray):
        parts = rows.mapInArrow(partial(_moments, edges=edges, weights=weights), "bucket int, sums binary")
        blobs = [np.frombuffer(r["sums"]) for r in per_group(parts, ["bucket"], _add, "sums binary").collect()]
        size = len(weights)
        both = sum(blobs).reshape(2, -1) if blobs else np.zeros((2, 3 + 2 * size + size * size + 400))
        self.count = both[:, 0]
        mean = both[:, 1:] / np.maximum(self.count, 1)[:, None]
        self.loss_negative, self.loss_positive = mean[:, 0], mean[:, 1]
        self.x, self.px = mean[:, 2 : 2 + size], mean[:, 2 + size : 2 + 2 * size]
        self.curve = mean[:, 2 + 2 * size : 2 + 2 * size + size * size].reshape(2, size, size)
        self.scores = mean[:, -400:]


def _prior(sums: _Sums) -> float:
    """Least share of unlabelled to positive mass above a score that a tenth of the positives reach."""
    unlabelled, positive = (np.cumsum(s[::-1]) for s in sums.scores)
    enough = positive >= 0.1
    return float(np.clip((unlabelled[enough] / positive[enough]).min(), 0.05, 0.99)) if enough.any() else 0.5


def fit(rows: DataFrame, edges: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights and class prior from feature rows with a boolean ``positive``."""
    weights, prior = np.zeros(1 + sum(map(len, edges))), 0.5
    for step in range(2 * STEPS):
        sums = _Sums(rows, edges, weights)
        if not sums.count[1]:
            return weights, prior  # nothing to learn from: every text scores one half
        if step >= STEPS // 2:
            prior = _prior(sums)
        below = sums.loss_negative[0] - prior * sums.loss_negative[1]
        if below >= 0:
            slope = -prior * sums.x[1] + sums.px[0]
            curve = sums.curve[0]
        else:  # the estimated risk of the negatives may not fall below zero: only positives count
            slope = -prior * (sums.x[1] - sums.px[1])
            curve = prior * sums.curve[1]
        # As strong as a few observations, so that few positives fit few bins.
        ridge = np.full(len(weights), RIDGE + RIDGE_ROWS / sums.count[1])
        ridge[0] = RIDGE
        move = np.linalg.solve(curve + np.diag(ridge), slope + ridge * weights)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        weights = weights - move
        if step > STEPS and np.abs(move).max() < 1e-4:
            break
    return weights, prior


def _scored(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = _sigmoid(design(_values(batch), edges) @ weights)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether the checksum of the key's text is divisible by ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 0


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """One row per input row: key, held_out and score, the chance that the text is good.

    The model learns from texts outside the held-out fold: positives are those
    with label 1, and all of them, labelled or not, are the unlabelled texts.
    Labels other than 1 are not used; of several labels of a key the largest
    counts; null keys have none.  Null and empty texts get a score like any
    other.  Without a positive every score is one half.  Repeated rows stay
    rows of their own; other columns are not looked at.
    """
    rows = _measure(docs, key, text)
    edges, weights = _learn(rows, labels, key, label)
    scored = rows.mapInArrow(partial(_scored, edges=edges, weights=weights), "id bigint, score double")
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score")


def _measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    given = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return frozen(given.mapInArrow(_measured, "id bigint, " + ", ".join(f"{f} double" for f in FEATURES)))


def _learn(rows: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    good = labels.where(F.col(f"`{label}`") == 1).select(F.col(f"`{key}`").cast("bigint").alias("id")).distinct()
    train = rows.where(~held_out(F.col("id"))).join(good.withColumn("_good", F.lit(True)), "id", "left")
    train = frozen(train.withColumn("positive", F.coalesce("_good", F.lit(False))).drop("_good"))
    cuts = [i / BINS for i in range(1, BINS)] + [0.01, 0.05, 0.95, 0.99]
    found = train.agg(*[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    edges = [np.unique(found[f]) if found[f] else np.zeros(0) for f in FEATURES]
    return edges, fit(train, edges)[0]


def _good_rows(
    batches: Iterator[pa.RecordBatch], text: str, edges: list[np.ndarray], weights: np.ndarray, least: float,
) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, text):
        score = _sigmoid(design(features(batch.column(text)), edges) @ weights)
        yield batch.filter(pa.array(score >= least))


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float, key: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more.

    Learns like ``score_quality``; the texts are scored where they are read, so
    they are not shuffled.
    """
    edges, weights = _learn(_measure(docs, key, text), labels, key, label)
    return docs.mapInArrow(partial(_good_rows, text=text, edges=edges, weights=weights, least=least), docs.schema)
