"""Hard negatives of anchor vectors, by a secondary-sort shuffle of packed pair scores.

The anchors are written to the shared folder.  Tasks compare their rows with
them block by block, so no task holds all anchors, and combine what they send:
of each anchor the first rows of its label, and in a second pass the first rows
of other labels in the window below each positive.  A pair is a key of bytes
whose order is (anchor, descending score, positives first, id).  Keys are dealt
out by anchor and sorted inside partitions; one pass over them opens a window
at each positive and emits negatives as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, functions as F

from ..session import frozen
from .shared_arrays import _open

#: Rows of a task and anchors that are compared at once.
ROWS, ANCHORS = 8192, 256
#: Scores below this are exact in double precision.
_EXACT = float(1 << 53)
#: A key: bytes in this order sort by anchor, falling score, kind and id.
_KEY = np.dtype([("anchor", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
_HALF = np.uint64(1 << 63)
POSITIVE, NEGATIVE = 0, 1
_NONE = np.iinfo(np.int64).max


def _unsigned(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) ^ _HALF


def _signed(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.uint64) ^ _HALF).view(np.int64)


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys of pairs, as binary values."""
    keys = np.empty(len(anchor), _KEY)
    keys["anchor"], keys["fall"] = _unsigned(anchor), ~_unsigned(score)
    keys["kind"], keys["id"] = kind, _unsigned(ids)
    size = _KEY.itemsize
    places = np.arange(len(keys) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(places), pa.py_buffer(keys.tobytes())])


def unpack(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """Anchor, score, kind and id of each key."""
    rows = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    return _signed(rows["anchor"]), _signed(~rows["fall"].astype(np.uint64)), rows["kind"], _signed(rows["id"])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of equal width; what a shorter vector lacks is zero."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    full = np.zeros((len(sizes), int(sizes.max(initial=0))))
    full[np.arange(full.shape[1]) < sizes[:, None]] = flat
    return full


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products; they must be exact."""
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    if width * np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) >= _EXACT:
        raise ValueError("inner products of 2**53 or more are not exact")
    return anchors @ rows.T


def _best(scores: np.ndarray, open_: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` highest open scores of each row, ties by column."""
    shown = np.where(open_, scores, -np.inf)
    if shown.shape[1] > count:
        least = np.partition(shown, -count, axis=1)[:, -count]
        open_ = open_ & (shown >= least[:, None])
    row, column = np.nonzero(open_)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < count], column[rank < count]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of up to ROWS rows, in the order of ids; null ids last."""
    held: list[pa.RecordBatch] = []

    def block(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = pc.fill_null(table["id"], _NONE).to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = table["vector"].combine_chunks() if isinstance(table["vector"], pa.ChunkedArray) else table["vector"]
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        return ids[order], table["label"].to_numpy()[order], _matrix(vectors)[order]

    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            piece = batch.slice(first, ROWS)
            if sum(b.num_rows for b in held) + piece.num_rows > ROWS:
                yield block(held)
                held = []
            held.append(piece)
    if held and sum(b.num_rows for b in held):
        yield block(held)


def _anchors(path: str) -> Iterator[pa.RecordBatch]:
    """The written anchors, a block at a time."""
    fs, base = _open(path)
    yield from ds.dataset(base, filesystem=fs, format="parquet").scanner(
        batch_size=ANCHORS, batch_readahead=1, fragment_readahead=1, use_threads=False
    ).to_batches()


def _pairs(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pack(anchor, score, kind, ids)], ["anchor", "key"])


def _first_positives(batches: Iterator[pa.RecordBatch], path: str, count: int) -> Iterator[pa.RecordBatch]:
    for ids, labels, rows in _blocks(batches):
        for block in _anchors(path):
            if not block.num_rows:
                continue
            number, own, label = (block.column(c).to_numpy() for c in ("anchor", "id", "label"))
            scores = _scores(_matrix(block.column("vector")), rows)
            a, r = _best(scores, (label[:, None] == labels) & (own[:, None] != ids), count)
            if len(a):
                yield _pairs(number[a], scores[a, r], POSITIVE, ids[r])


def _first_negatives(
    batches: Iterator[pa.RecordBatch], path: str, positives: int, count: int, share: tuple[int, int],
) -> Iterator[pa.RecordBatch]:
    for ids, labels, rows in _blocks(batches):
        for block in _anchors(path):
            if not block.num_rows:
                continue
            number, label = (block.column(c).to_numpy() for c in ("anchor", "label"))
            scores = _scores(_matrix(block.column("vector")), rows)
            other = label[:, None] != labels
            tops = _matrix(block.column("scores"))
            there = pc.list_value_length(block.column("scores")).to_numpy(zero_copy_only=False)
            wanted = np.zeros(scores.shape, bool)
            for k in range(tops.shape[1]):
                top = tops[:, k]
                low = -((-share[0] * top.astype(np.int64)) // share[1])
                window = other & (scores >= low[:, None]) & (scores <= top[:, None]) & (there > k)[:, None]
                wanted[_best(scores, window, count)] = True
            a, r = np.nonzero(wanted)
            if len(a):
                yield _pairs(number[a], scores[a, r], NEGATIVE, ids[r])


def _leading(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """The first ``count`` keys of each anchor, unpacked."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, score, _, ids = unpack(batch.column("key"))
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[0] = anchor[0] != last
        run = np.cumsum(new)
        begin = np.flatnonzero(new)
        rank = np.arange(len(anchor)) - np.concatenate([[-seen], begin])[run]
        last, seen = anchor[-1], int(rank[-1]) + 1
        keep = rank < count
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (anchor, rank, score, ids)], ["anchor", "rank", "score", "id"]
        )


def _windows(batches: Iterator[pa.RecordBatch], count: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Negatives of every positive, from keys in order; open windows are all that is held of an anchor."""
    last, open_ = None, []
    for batch in batches:
        out = []
        for anchor, score, kind, key in zip(*(x.tolist() for x in unpack(batch.column("key")))):
            if anchor != last:
                last, open_ = anchor, []
            if kind == POSITIVE:
                open_.append([key, score, 0])
                continue
            # A window closes for good once the scores have fallen below it.
            open_ = [w for w in open_ if w[2] < count and share[1] * score >= share[0] * w[1]]
            for window in open_:
                if score <= window[1]:
                    window[2] += 1
                    out.append((anchor, window[0], window[2], key, window[1], score))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                ["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )


def _sorted_keys(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("anchor").sortWithinPartitions("key")


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """For the rows where ``anchors`` holds: rank, id and score of the negatives of each positive.

    Components become floor(scale * x).  An anchor's positives are the first
    ``positives`` other rows of its label, by falling inner product and rising
    id.  A positive's negatives are the first ``negatives`` rows of other labels
    whose score is at most the positive's and at least ``share`` of it.

    Rows with a null label, a null vector, or a component that is null or not
    finite take no part.  Rows with an anchor's own key are never its
    positives; other repeated rows are rows of their own, and a repeated anchor
    is mined once for each of its rows.  Null keys come last among ties and are
    never anchors.  Components that a shorter vector lacks are zero; an empty
    vector scores 0.  Inner products of 2**53 or more are refused.  An empty
    table gives no rows; other columns are not looked at.  Keys must be integers.
    """
    number = F.col(f"`{vector}`").cast("array<double>")
    broken = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(f"`{label}`").isNotNull() & number.isNotNull() & ~F.coalesce(broken, F.lit(True)))
    columns = (
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
        F.transform(number, lambda x: F.floor(x * scale).cast("double")).alias("vector"),
    )
    asked = frozen(
        rows.where(anchors).select(F.monotonically_increasing_id().alias("anchor"), *columns).where("id IS NOT NULL")
    )
    rows = rows.select(*columns)
    first = _sorted_keys(rows.mapInArrow(
        partial(_first_positives, path=asked._scratch_path, count=positives), "anchor bigint, key binary"
    )).mapInArrow(partial(_leading, count=positives), "anchor bigint, rank bigint, score bigint, id bigint")
    first = frozen(first)
    tops = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False).alias("scores"))
    known = frozen(asked.join(tops, "anchor"))
    pairs = rows.mapInArrow(
        partial(_first_negatives, path=known._scratch_path, positives=positives, count=negatives, share=share),
        "anchor bigint, key binary",
    )
    opened = first.mapInArrow(_as_keys, "anchor bigint, key binary")
    mined = _sorted_keys(opened.unionByName(pairs)).mapInArrow(
        partial(_windows, count=negatives, share=share),
        "anchor bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    )
    names = asked.select("anchor", F.col("id").alias("anchor_id"))
    ids = {c: F.nullif(F.col(c), F.lit(_NONE)) for c in ("positive_id", "negative_id")}
    return names.join(mined.withColumns(ids), "anchor").drop("anchor")


def _as_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, score, ids = (batch.column(c).to_numpy() for c in ("anchor", "score", "id"))
        yield _pairs(anchor, score, POSITIVE, ids)
