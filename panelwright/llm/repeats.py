"""Words of documents that lie in a window which also begins earlier in the corpus.

Two passes.  First every task sketches the hashes of its windows: the cells of
a count-min sketch of two rows, whose width follows the size of the corpus.
The sketches are merged by range of cells; what remains is one bit per cell,
"hit twice or more".  A window that is repeated hits such cells in both rows,
so no repeat is lost.  Only windows estimated repeated are then grouped
exactly, by 96-bit hash, for the place where each begins first.

A place is key, row number and start.  Where all keys differ the row number is
0; otherwise rows are numbered in a written copy, so a place belongs to one text.

Bit tables and first places are arrays in the shared folder, which tasks map
into memory.  Shuffles carry compressed arrays, not a row per window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import frozen, scratch_path
from .shared_arrays import expand, expand_sorted, load, per_group, save, squeeze, squeeze_sorted
from .words import Words, chunks, ids, mix

#: Windows that a task gathers before it sends them on: of all, and of those estimated repeated.
FLUSH, FLUSH_REPEATED = 1 << 22, 1 << 20
#: Cells of each row for a window, at the average.
CELLS = 5
#: Cells of one merged part of the sketch, and windows of one exact group at the average.
PART_CELLS = 1 << 25
GROUP_WINDOWS = 1 << 20
ROWS = 2
#: Added to the row numbers of null keys, which come after the largest key.
_NULL = 1 << 62
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Shape:
    """A sketch row of ``parts`` parts of ``2**bits`` cells."""

    parts: int
    bits: int

    @classmethod
    def of(cls, windows: int) -> Shape:
        """At least CELLS cells for each window."""
        parts = windows * CELLS // PART_CELLS + 1
        bits = PART_CELLS.bit_length() - 1
        return cls(parts, bits if parts > 1 else max(10, min(bits, (windows * CELLS).bit_length())))

    @property
    def edges(self) -> np.ndarray:
        return np.arange(self.parts + 1, dtype=np.uint64) << np.uint64(self.bits)

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        mixed = hashes * _MIX[row]
        part = ((mixed >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
        return (part << np.uint64(self.bits)) | ((mixed >> np.uint64(6)) & np.uint64((1 << self.bits) - 1))


def _sketch(batches: Iterator[pa.RecordBatch], window: int, shape: Shape) -> Iterator[pa.RecordBatch]:
    """Sorted cells of each row that the windows of a task hit, a cell at most twice, cut by part."""
    gathered: list[np.ndarray] = []
    edges = shape.edges

    def flush() -> pa.RecordBatch:
        hashes = np.concatenate(gathered)
        gathered.clear()
        rows = []
        for row in range(ROWS):
            cells = np.sort(shape.cells(hashes, row))
            keep = np.ones(len(cells), bool)
            keep[2:] = cells[2:] != cells[:-2]
            cells = cells[keep]
            cut = np.searchsorted(cells, edges)
            for part in range(len(edges) - 1):
                if cut[part + 1] > cut[part]:
                    rows.append((row, part, squeeze_sorted((cells[cut[part] : cut[part + 1]] - edges[part]).astype(np.uint32))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["row", "part", "cells"]
        )

    for batch in chunks(batches, "text"):
        words = Words(batch.column("text"))
        starts = words.windows(window)
        if len(starts):
            gathered.append(Words.window_hashes(words.hashes(), starts, window))
            if sum(map(len, gathered)) >= FLUSH:
                yield flush()
    if gathered:
        yield flush()


def _merge(key: tuple, groups: Iterator[pa.RecordBatch], folder: str, shape: Shape) -> Iterator[pa.RecordBatch]:
    row, part = (k.as_py() for k in key)
    counts = np.zeros(1 << shape.bits, np.uint8)
    for batch in groups:
        for blob in batch.column("cells"):
            cells = expand_sorted(blob.as_py())
            again = cells[1:][cells[1:] == cells[:-1]]
            counts[cells] = np.minimum(counts[cells] + 1, 2)
            counts[again] = 2
    save(folder, f"bits-{row}-{part}", np.packbits(counts >= 2, bitorder="little"))
    yield pa.RecordBatch.from_arrays(
        [pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([int((counts >= 2).sum())], pa.int64())],
        ["row", "part", "cells"],
    )


class _Sketch:
    """The merged sketch, mapped into memory part by part."""

    def __init__(self, folder: str, shape: Shape, names: list[tuple[int, int]]):
        self.shape = shape
        none = np.zeros((1 << shape.bits) // 8, np.uint8)  # of a part that no window hit
        there = {(row, part): load(folder, f"bits-{row}-{part}") for row, part in names}
        self.parts = [[there.get((row, p), none) for p in range(shape.parts)] for row in range(ROWS)]

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes hit cells that are hit twice in every row."""
        left = np.arange(len(hashes))
        for row in range(ROWS):
            cells = self.shape.cells(hashes[left], row)
            order = np.argsort(cells)
            cells = cells[order]
            cut = np.searchsorted(cells, self.shape.edges)
            hit = np.zeros(len(cells), bool)
            for part, table in enumerate(self.parts[row]):
                own = cells[cut[part] : cut[part + 1]] - self.shape.edges[part]
                hit[cut[part] : cut[part + 1]] = (table[own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8)) & 1
            left = np.sort(left[order[hit]])
        mask = np.zeros(len(hashes), bool)
        mask[left] = True
        return mask


def _firsts_of(*columns: np.ndarray) -> np.ndarray:
    """Rows (h1, h2, doc, row, start) that come first, by place, among those of their hash."""
    order = np.lexsort(columns[::-1])
    h1, h2 = columns[0][order], columns[1][order]
    first = np.ones(len(order), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return order[first]


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Row numbers, those of null keys after all others."""
    return batch.column("row").to_numpy() + np.where(batch.column("id").is_null().to_numpy(zero_copy_only=False), _NULL, 0)


def _suspects(batches: Iterator[pa.RecordBatch], window: int, folder: str, shape: Shape, names: list, groups: int) -> Iterator[pa.RecordBatch]:
    """Windows estimated repeated, each once per flush with its first place, cut by range of the hash."""
    sketch, gathered, seen = None, [], 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*gathered)]
        gathered.clear()
        first = _firsts_of(*columns)
        h1, h2, doc, row, start = (c[first] for c in columns)
        group = ((h1 >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        cut = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
        rows = [
            (g, squeeze_sorted(h1[a:b]), *(squeeze(c[a:b]) for c in (h2, doc, row, start)))
            for g, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a
        ]
        kinds = (pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["group", "h1", "h2", "doc", "row", "start"]
        )

    for batch in chunks(batches, "text"):
        sketch = sketch or _Sketch(folder, shape, names)
        words = Words(batch.column("text"))
        starts = words.windows(window)
        if not len(starts):
            continue
        hashes = Words.window_hashes(words.hashes(), starts, window)
        mask = sketch.repeated(hashes)
        starts = starts[mask]
        if len(starts):
            second = Words.window_hashes(words.hashes(seed=1), starts, window, 1)
            doc = np.searchsorted(words.doc_start, starts, side="right") - 1
            place = (starts - words.doc_start[doc]).astype(np.uint32)
            own = (ids(batch, "id")[doc], _numbers(batch)[doc])
            gathered.append((hashes[mask], (second >> np.uint64(32)).astype(np.uint32), *own, place))
        seen += len(starts)
        if seen >= FLUSH_REPEATED:
            yield flush()
            seen = 0
    if gathered:
        yield flush()


def _shelf(doc: np.ndarray, row: np.ndarray, shelves: int) -> np.ndarray:
    """Shelf of texts, whatever pattern their keys and row numbers have."""
    return (mix(mix(doc.astype(np.uint64)) ^ row.astype(np.uint64)) % np.uint64(shelves)).astype(np.int64)


def _group(key: tuple, groups: Iterator[pa.RecordBatch], shelves: int) -> Iterator[pa.RecordBatch]:
    """First place of every window of a hash range, cut by document."""
    parts = [
        (expand_sorted(h1.as_py()), *(expand(x.as_py()) for x in rest))
        for batch in groups for h1, *rest in zip(*[batch.column(c) for c in ("h1", "h2", "doc", "row", "start")])
    ]
    columns = [np.concatenate(c) for c in zip(*parts)]
    first = _firsts_of(*columns)
    doc, row, start = (c[first] for c in columns[2:])
    shelf = _shelf(doc, row, shelves)
    order = np.lexsort((start, row, doc, shelf))
    doc, row, start = doc[order], row[order], start[order]
    cut = np.searchsorted(shelf[order], np.arange(shelves + 1))
    rows = [
        (s, *(squeeze(c[a:b]) for c in (doc, row, start))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["shelf", "doc", "row", "start"]
    )


def _shelve(key: tuple, groups: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    parts = [
        tuple(expand(x.as_py()) for x in place)
        for batch in groups for place in zip(*[batch.column(c) for c in ("doc", "row", "start")])
    ]
    doc, row, start = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((start, row, doc))
    doc, row = doc[order], row[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    name = key[0].as_py()
    save(folder, f"doc-{name}", doc[begin])
    save(folder, f"row-{name}", row[begin])
    save(folder, f"begin-{name}", np.append(begin, len(doc)))
    save(folder, f"start-{name}", start[order])
    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([len(doc)], pa.int64())], ["shelf", "n"])


class _Firsts:
    """First places by text, mapped into memory."""

    def __init__(self, folder: str, shelves: int, names: list[int]):
        self.shelves = shelves
        self.arrays = {n: tuple(load(folder, f"{c}-{n}") for c in ("doc", "row", "begin", "start")) for n in names}

    def of(self, key: int, number: int) -> np.ndarray:
        shelf = int(_shelf(np.array([key]), np.array([number]), self.shelves)[0])
        doc, row, begin, start = self.arrays.get(shelf, (np.zeros(0, np.int64),) * 4)
        low, high = (int(np.searchsorted(doc, key, side)) for side in ("left", "right"))
        at = low + int(np.searchsorted(row[low:high], number))
        return start[begin[at] : begin[at + 1]] if at < high and row[at] == number else start[:0]


def _keep(
    batches: Iterator[pa.RecordBatch], window: int, folder: str, shape: Shape, names: list, shelves: int, shelf_names: list[int],
    texts: bool,
) -> Iterator[pa.RecordBatch]:
    sketch = firsts = None
    for batch in chunks(batches, "text"):
        sketch = sketch or _Sketch(folder, shape, names)
        firsts = firsts or _Firsts(folder, shelves, shelf_names)
        words = Words(batch.column("text"))
        starts = words.windows(window)
        drop = np.zeros(len(words.start) + 1, np.int64)
        if len(starts):
            hashes = Words.window_hashes(words.hashes(), starts, window)
            again = np.zeros(len(words.start), bool)
            again[starts[sketch.repeated(hashes)]] = True
            doc = np.searchsorted(words.doc_start, np.flatnonzero(again), side="right") - 1
            keys, numbers = ids(batch, "id"), _numbers(batch)
            for d in np.unique(doc):
                again[words.doc_start[d] + firsts.of(int(keys[d]), int(numbers[d]))] = False
            again = np.flatnonzero(again)
            np.add.at(drop, again, 1)
            np.add.at(drop, again + window, -1)
        kept = np.cumsum(drop[:-1]) == 0
        yield _row_results(batch, words, kept, texts)


def _row_results(batch: pa.RecordBatch, words: Words, kept: np.ndarray, texts: bool) -> pa.RecordBatch:
    doc = words.doc_of_word()
    n_kept = np.bincount(doc[kept], minlength=batch.num_rows)
    # Bytes of the kept words, and the one white space after each but a text's last.
    at = np.flatnonzero(kept)
    last = np.ones(len(at), bool)
    last[:-1] = doc[at[1:]] != doc[at[:-1]]
    stay = np.zeros(len(words.data) + 2, np.int8)
    stay[words.start[at]] += 1
    np.add.at(stay, words.end[at] + ~last, -1)
    stay = np.cumsum(stay[: len(words.data)], dtype=np.int8).astype(bool)
    data = words.data.copy()
    data[words.end[at[~last]]] = 32
    place = np.concatenate([[0], np.cumsum(stay)])[words.offsets]
    body = data[stay].tobytes()
    parts = [body[a:b] for a, b in zip(place[:-1], place[1:])]
    arrays = [
        batch.column("id"), pa.array(words.count.astype(np.int64)), pa.array((words.count - n_kept).astype(np.int64)),
        pa.array([p.decode() for p in parts] if texts else [hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept"])


def drop_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, digest: bool = False,
) -> DataFrame:
    """One row per input row: key, n_words, n_removed and ``kept``, the words left joined by one space.

    A word goes if a window of ``window`` words over it has the same words as
    one that begins earlier: in a smaller key, or earlier in the same text.
    ``digest`` gives ``kept`` as SHA-256 in hex.  Null and empty texts have no
    words.  Null keys come after all others; rows that share a key, or have
    none, are texts of their own, one after the other in the order of a written
    copy, so of equal rows the first keeps its words.  Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("row", F.lit(0).cast("bigint"))
    else:
        rows = frozen(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape.of(int(size // 6))  # about as many windows as words of six bytes
    folder = scratch_path(spark, "repeats")
    sketch = rows.mapInArrow(partial(_sketch, window=window, shape=shape), "row int, part int, cells binary")
    merged = per_group(
        sketch, ["row", "part"], partial(_merge, folder=folder, shape=shape), "row int, part int, cells bigint"
    )
    tables = [(r["row"], r["part"], r["cells"]) for r in merged.collect()]  # one row per PART_CELLS cells
    names = [(row, part) for row, part, _ in tables]
    groups = max(1, sum(cells for row, _, cells in tables if row == 0) // GROUP_WINDOWS * 4)
    shelves = groups
    suspects = rows.mapInArrow(
        partial(_suspects, window=window, folder=folder, shape=shape, names=names, groups=groups),
        "group int, h1 binary, h2 binary, doc binary, row binary, start binary",
    )
    firsts = per_group(suspects, ["group"], partial(_group, shelves=shelves), "shelf int, doc binary, row binary, start binary")
    shelved = per_group(firsts, ["shelf"], partial(_shelve, folder=folder), "shelf int, n bigint")
    shelf_names = [r["shelf"] for r in shelved.collect()]  # one row per group of windows
    return rows.mapInArrow(
        partial(
            _keep, window=window, folder=folder, shape=shape, names=names, shelves=shelves, shelf_names=shelf_names,
            texts=not digest,
        ),
        "id bigint, n_words bigint, n_removed bigint, kept string",
    ).withColumnRenamed("id", key)
