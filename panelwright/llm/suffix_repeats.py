"""Bytes of documents that lie in a long repeated string, from suffix order and longest previous factors.

A window is a string of ``window`` bytes of one text.  Every window has an
anchor, its leftmost least hash of 32 bytes, which depends on the window alone,
so equal windows have equal anchors at equal places.  Neighbouring windows with
one anchor form a context, about one for 85 bytes.

1. Contexts are grouped by the hash at their anchor.  A context whose anchor
   occurs once has no repeated window.  Equal contexts, told by 128-bit names,
   are repeated as a whole, and only the first of them is looked at further.
2. Where contexts that differ share an anchor, their bytes are brought
   together.  The suffixes that begin their windows are put in order, common
   prefixes of neighbours are measured, and the previous and next smaller place
   in suffix order give the longest previous factor of each.
3. Texts are read once more and the marked windows covered.

An anchor with very many different contexts, such as a common line in ever
different surroundings, is not brought together: its windows go by their own
128-bit names, which spread over all groups.

Texts are numbered in a written copy that also deals them to units of bounded
size.  What comes back to a unit lies in files of its own, so a task reads only
those of the units it works on.  Shuffles carry compressed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import frozen, scratch_path
from .shared_arrays import expand, expand_sorted, load, per_group, save, squeeze, squeeze_sorted
from .words import chunks, ids, text_bytes

#: Bytes that an anchor's hash is of.
GRAM = 32
#: Bytes of text in a unit, and of a text that are worked on at once.
UNIT_BYTES, PIECE_BYTES = 1 << 25, 1 << 20
#: Different contexts of one anchor that a unit sends on, and that are brought together; beyond, windows go by name.
PER_UNIT, TOGETHER = 16, 2048
#: Contexts of a group at the average, and windows whose suffixes are ordered at once.
GROUP_CONTEXTS, SORTED = 1 << 19, 1 << 18
#: Contexts or windows that a task holds before it sends them on.
FLUSH = 1 << 19
WHOLE, SEND, MARK = 1, 2, 4
#: What comes back to units: contexts, anchors that go by window, runs of windows, names of windows; those found by a key.
CONTEXTS, ANCHORS, RUNS, NAMES = range(4)
KEYED = (CONTEXTS, NAMES)
_LOW = np.uint64((1 << 27) - 1)
_STIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def stir(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= _STIR[0]
    x ^= x >> np.uint64(29)
    x *= _STIR[1]
    x ^= x >> np.uint64(32)
    return x


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    sixteen = stir(stir(eight[:-8].copy()) + eight[8:])
    return stir(stir(sixteen[:-16].copy()) + sixteen[16:])


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every ``size`` neighbours."""
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(values) - size + 1
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


class Contexts:
    """Contexts of one piece of text: windows ``first`` to ``last`` (byte places in the piece) share ``anchor``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        none = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.doc = none
        self.hash = self.name = none.astype(np.uint64)
        self.gram = grams(data)
        if len(data) < window:
            return
        starts = len(data) - window + 1
        edge = np.zeros(starts + 1, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= window)
        edge[offsets[long]] += 1
        edge[offsets[long + 1] - window + 1] -= 1
        valid = np.cumsum(edge[:starts], dtype=np.int8).astype(bool)
        place = np.arange(len(self.gram), dtype=np.uint64)
        least = _least((self.gram & ~_LOW) | place, window - GRAM + 1) & _LOW
        new, end = valid.copy(), valid.copy()
        change = least[1:] != least[:-1]
        new[1:] &= change | ~valid[:-1]
        end[:-1] &= change | ~valid[1:]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(end)
        self.anchor = least[self.first].astype(np.int64)
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1
        self.hash = self.gram[self.anchor]
        self.name = self._chain(self.first, self.last + window, 0) + self._seed(2)

    def _seed(self, seed: int) -> np.ndarray:
        lead, span = self.anchor - self.first, self.last - self.first
        return stir((lead * 4096 + span + seed).astype(np.uint64))

    def _chain(self, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        """Name of the bytes from ``begin`` to ``end``, at least 32."""
        name = stir((end - begin + (seed << 32)).astype(np.uint64))
        at, last = begin.copy(), end - GRAM
        live = np.arange(len(begin))
        while len(live):
            name[live] = stir(name[live] + self.gram[np.minimum(at[live], last[live])])
            live = live[at[live] < last[live]]
            at[live] += GRAM
        return name

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context, first byte and two names of all windows of some contexts."""
        size = self.last[which] - self.first[which] + 1
        owner = np.repeat(which, size)
        start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.first[owner]
        return owner, start, *(self._chain(start, start + self.window, seed) for seed in (5, 6))


def _pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Byte place, bytes and text offsets of pieces; a very long text comes in several that overlap."""
    data, offsets = text_bytes(batch.column("text"))
    if batch.num_rows > 1 or len(data) <= 2 * PIECE_BYTES:
        yield 0, data, offsets
        return
    for begin in range(0, len(data) - window + 1, PIECE_BYTES):
        part = data[begin : begin + PIECE_BYTES + window - 1]
        yield begin, part, np.array([0, len(part)])


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return stir(first + np.uint64(1)) ^ second


def _group(hashes: np.ndarray, groups: int) -> np.ndarray:
    return ((stir(hashes.copy()) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def _changed(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table of columns begins a new value."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _deal(kind: int, target: np.ndarray, unit: np.ndarray, columns: list[np.ndarray], width: int) -> pa.RecordBatch:
    """One row for each target and unit, with the columns as compressed arrays."""
    order = np.lexsort((unit, target))
    target, unit = target[order], unit[order]
    cut = np.append(np.flatnonzero(_changed(target, unit)), len(target))
    columns = [c[order] for c in columns]
    blobs = [[squeeze(c[a:b]) for a, b in zip(cut[:-1], cut[1:])] for c in columns]
    count = len(cut) - 1
    blobs += [[b""] * count] * (width - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, kind, np.int32)), pa.array(target[cut[:-1]].astype(np.int64)), pa.array(unit[cut[:-1]])]
        + [pa.array(b, pa.binary()) for b in blobs],
        ["kind", "target", "unit", *[f"c{i}" for i in range(width)]],
    )


def _schema(width: int) -> str:
    return "kind int, target bigint, unit bigint, " + ", ".join(f"c{i} binary" for i in range(width))


def _undeal(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Unit and columns of all rows of a group."""
    units, parts = [], []
    for batch in batches:
        for unit, *blobs in zip(batch.column("unit").to_pylist(), *[batch.column(f"c{i}") for i in range(width)]):
            parts.append([expand(b.as_py()) for b in blobs])
            units.append(np.full(len(parts[-1][0]), unit, np.int64))
    return np.concatenate(units), [np.concatenate(c) for c in zip(*parts)]


def _firsts(
    unit: np.ndarray, first: np.ndarray, second: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray,
) -> tuple[list[np.ndarray], np.ndarray]:
    """Each (unit, first, second) once with its first place, and 1 or 2 for once or more often."""
    order = np.lexsort((pos, row, doc, second, first, unit))
    columns = [c[order] for c in (unit, first, second, doc, row, pos)]
    begin = np.flatnonzero(_changed(*columns[:3]))
    times = np.minimum(np.diff(np.append(begin, len(order))), 2).astype(np.uint8)
    return [c[begin] for c in columns], times


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number and a unit."""
    part = TaskContext.get().partitionId() << 33
    row, unit, size = part, part, 0
    for batch in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.arange(row, row + batch.num_rows)), pa.array(np.full(batch.num_rows, unit)), batch.column("text")],
            ["id", "row", "unit", "text"],
        )
        row += batch.num_rows
        size += text_bytes(batch.column("text"))[1][-1]
        if size >= UNIT_BYTES:
            unit, size = unit + 1, 0


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in chunks(batches, "text"):
        units = batch.column("unit").to_numpy()
        cut = np.append(np.flatnonzero(_changed(units)), len(units))
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(units[a]), batch.slice(a, b - a)


def _places(batch: pa.RecordBatch, begin: int, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, row number and place in its text of windows of a piece."""
    return ids(batch, "id")[doc], batch.column("row").to_numpy()[doc], (start - offsets[doc] + begin).astype(np.uint32)


def _anchored(batches: Iterator[pa.RecordBatch], window: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Contexts, each once per unit, by group of their anchor; an anchor with too many is sent as a mark."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        (unit, hashes, name, doc, row, pos), times = _firsts(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        begin = np.flatnonzero(_changed(unit, hashes))
        count = np.diff(np.append(begin, len(unit)))
        many = np.repeat(count > PER_UNIT, count)
        times[many] = MARK
        stay = ~many
        stay[begin] = True
        return _deal(0, _group(hashes, groups)[stay], unit[stay], [c[stay] for c in (hashes, name, times, doc, row, pos)], 6)

    size = 0
    for unit, batch in _by_unit(batches):
        for begin, data, offsets in _pieces(batch, window):
            found = Contexts(data, offsets, window)
            if len(found.first):
                place = _places(batch, begin, offsets, found.doc, found.first)
                held.append((np.full(len(found.first), unit), found.hash, found.name, *place))
                size += len(found.first)
        if size >= FLUSH:
            yield flush()
            size = 0
    if held:
        yield flush()


def _compared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each unit has to know of its contexts: repeated as a whole, to be sent, or to go by window."""
    unit, (hashes, name, times, doc, row, pos) = _undeal(batches, 6)
    order = np.lexsort((pos, row, doc, name, hashes))
    unit, hashes, name, times, doc, row, pos = (c[order] for c in (unit, hashes, name, times, doc, row, pos))
    anchor, same = _changed(hashes), _changed(hashes, name)
    of_anchor, of_same = np.cumsum(anchor) - 1, np.cumsum(same) - 1
    entries = np.bincount(of_anchor)
    marked = np.bincount(of_anchor, times == MARK) > 0
    kinds = np.bincount(of_anchor[same])
    by_name = (marked | ((kinds > 1) & (entries > TOGETHER)))[of_anchor]
    whole = (np.bincount(of_same, times) > 1)[of_same] & ~by_name
    send = (kinds > 1)[of_anchor] & ~by_name  # the first of each context will be
    lead = np.flatnonzero(same)[of_same]
    flag = (whole * WHOLE + send * SEND).astype(np.uint8)
    tell = flag > 0
    yield _deal(CONTEXTS, unit[tell], unit[tell], [c[tell] for c in (hashes, name, flag, row[lead], pos[lead])], 5)
    hot = np.unique(np.column_stack([unit[by_name].view(np.uint64), hashes[by_name]]), axis=0)
    yield _deal(ANCHORS, hot[:, 0].view(np.int64), hot[:, 0].view(np.int64), [np.ascontiguousarray(hot[:, 1])], 5)


def _shelve(key: tuple, batches: Iterator[pa.RecordBatch], folder: str, widths: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Write what came back to one unit: columns of each kind, by a key of the first two, or by the first."""
    unit = key[0].as_py()
    table = pa.Table.from_batches(batches)
    for kind, width in widths.items():
        rows = table.filter(pa.array(table["kind"].to_numpy() == kind))
        if rows.num_rows:
            _, columns = _undeal(rows.to_batches(), width)
        else:
            columns = [np.zeros(0, np.uint64)] * width
        columns = [c.astype(np.int64).view(np.uint64) if c.dtype.kind != "u" else c.astype(np.uint64) for c in columns]
        order = np.argsort(_key(*columns[:2]) if kind in KEYED else columns[0], kind="stable")
        save(folder, f"{kind}-{unit}", np.array([c[order] for c in columns]))
    yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64())], ["unit"])


class _Told:
    """What came back to a unit: contexts, anchors that go by window, marked runs, repeated windows."""

    def __init__(self, folder: str, unit: int, last: bool):
        self.contexts = np.asarray(load(folder, f"{CONTEXTS}-{unit}"))
        self.hot = np.asarray(load(folder, f"{ANCHORS}-{unit}"))[0]
        self.context_key = _key(*self.contexts[:2])
        if last:
            self.runs = np.asarray(load(folder, f"{RUNS}-{unit}")).astype(np.int64)
            self.names = np.asarray(load(folder, f"{NAMES}-{unit}"))
            self.name_key = _key(*self.names[:2])

    @staticmethod
    def _find(keys: np.ndarray, table: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of those found, and their column in the table."""
        if not len(keys) or not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, _key(first, second)), len(keys) - 1)
        found = np.flatnonzero((table[0][at] == first) & (table[1][at] == second))
        return found, at[found]

    def of_contexts(self, found: Contexts) -> tuple[np.ndarray, np.ndarray]:
        return self._find(self.context_key, self.contexts, found.hash, found.name)

    def by_window(self, found: Contexts) -> np.ndarray:
        """Contexts whose windows go by name."""
        if not len(self.hot):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hot, found.hash), len(self.hot) - 1)
        return np.flatnonzero(self.hot[at] == found.hash)


def _sent(batches: Iterator[pa.RecordBatch], window: int, groups: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Bytes of contexts that must be brought together (kind 0) and names of single windows (kind 1)."""
    contexts: list[tuple] = []
    windows: list[tuple] = []
    told, own = None, None

    def flush() -> Iterator[pa.RecordBatch]:
        if contexts:
            unit, hashes, doc, row, pos, size, body = (np.concatenate(c) for c in zip(*contexts))
            contexts.clear()
            # Bytes go with the lengths, a group at a time.
            target = _group(hashes, groups)
            order = np.lexsort((unit, target))
            begin = (np.cumsum(size) - size)[order]
            target, unit, hashes, doc, row, pos, size = (c[order] for c in (target, unit, hashes, doc, row, pos, size))
            body = body[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]
            cut = np.append(np.flatnonzero(_changed(target, unit)), len(target))
            byte = np.concatenate([[0], np.cumsum(size)])[cut]
            rows = [
                (0, int(target[a]), int(unit[a]), *(squeeze(c[a:b]) for c in (hashes, doc, row, pos, size)), squeeze(body[x:y]))
                for a, b, x, y in zip(cut[:-1], cut[1:], byte[:-1], byte[1:])
            ]
            types = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kind", "target", "unit", *[f"c{i}" for i in range(6)]]
            )
        if windows:
            (unit, one, two, doc, row, pos), times = _firsts(*(np.concatenate(c) for c in zip(*windows)))
            windows.clear()
            yield _deal(1, _group(one, groups), unit, [one, two, times, doc, row, pos], 6)

    size = 0
    for unit, batch in _by_unit(batches):
        if unit != own:
            told, own = _Told(folder, unit, False), unit
        for begin, data, offsets in _pieces(batch, window):
            found = Contexts(data, offsets, window)
            doc, row, pos = _places(batch, begin, offsets, found.doc, found.first)
            which, at = told.of_contexts(found)
            send = which[
                (told.contexts[2][at] & np.uint64(SEND) > 0) & (told.contexts[3][at] == row[which].astype(np.uint64))
                & (told.contexts[4][at] == pos[which])
            ]
            if len(send):
                length = found.last[send] - found.first[send] + window
                inside = np.arange(length.sum()) + np.repeat(found.first[send] - (np.cumsum(length) - length), length)
                contexts.append((
                    np.full(len(send), unit), found.hash[send], doc[send], row[send], pos[send], length.astype(np.int64), data[inside],
                ))
                size += 4 * len(send)
            hot = told.by_window(found)
            if len(hot):
                owner, start, one, two = found.windows(hot)
                windows.append((np.full(len(start), unit), one, two, *_places(batch, begin, offsets, found.doc[owner], start)))
                size += len(start)
        if size >= FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def longest_previous(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Longest common prefix of each suffix with one at a smaller place, 0 if below ``least``.

    Suffixes are in order; ``common[i]`` is the common prefix of suffixes i - 1
    and i.  The nearest smaller place on either side has the longest one;
    pointers to it jump over larger places and carry the least common prefix
    on their way.
    """
    best = np.zeros(len(place), common.dtype)
    for step in (-1, 1):
        there = np.arange(len(place)) + step
        low = common.copy() if step < 0 else np.append(common[1:], common.dtype.type(0))
        if len(low):
            low[0 if step < 0 else -1] = 0
        open_ = np.flatnonzero(low >= least)
        open_ = open_[place[there[open_]] >= place[open_]]
        while len(open_):
            over = there[open_]
            low[open_] = np.minimum(low[open_], low[over])
            there[open_] = there[over]
            open_ = open_[low[open_] >= least]
            open_ = open_[place[there[open_]] >= place[open_]]
        np.maximum(best, np.where(low >= least, low, 0), out=best)
    return best


def _ordered(body: np.ndarray, start: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each window, and its longest common prefix with any other, both up to ``window``."""
    views = np.lib.stride_tricks.sliding_window_view(body, window)
    rows = np.ascontiguousarray(views[start])
    order = np.argsort(rows.view(f"S{window}").reshape(-1), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.zeros(len(order), np.int16)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    after = np.append(common[1:], np.int16(0))
    previous, other = np.empty_like(common), np.empty_like(common)
    previous[order] = longest_previous(place[order], common, window)
    other[order] = np.maximum(common, after)
    return previous, other


def _suffixes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of the contexts of a group: row, first and last place, and if they occur earlier."""
    unit, hashes, doc, row, pos, size, bodies = [], [], [], [], [], [], []
    for batch in batches:
        for u, *blobs in zip(batch.column("unit").to_pylist(), *[batch.column(f"c{i}") for i in range(6)]):
            parts = [expand(b.as_py()) for b in blobs]
            for column, part in zip((hashes, doc, row, pos, size, bodies), parts):
                column.append(part)
            unit.append(np.full(len(parts[0]), u, np.int64))
    unit, hashes, doc, row, pos, size, body = (np.concatenate(c) for c in (unit, hashes, doc, row, pos, size, bodies))
    order = np.lexsort((pos, row, doc, hashes))
    begin = (np.cumsum(size) - size)[order]
    unit, hashes, doc, row, pos, size = (c[order] for c in (unit, hashes, doc, row, pos.astype(np.int64), size))
    count = size - window + 1
    cut = [0]  # anchors of about SORTED windows at a time
    edges = np.append(np.flatnonzero(_changed(hashes)), len(hashes))
    windows = np.concatenate([[0], np.cumsum(count)])
    for edge in edges[1:]:
        if windows[edge] - windows[cut[-1]] >= SORTED or edge == edges[-1]:
            cut.append(int(edge))
    for a, b in zip(cut[:-1], cut[1:]):
        length = size[a:b]
        held = body[np.arange(length.sum()) + np.repeat(begin[a:b] - (np.cumsum(length) - length), length)]
        owner = np.repeat(np.arange(a, b), count[a:b])
        inside = np.arange(len(owner)) - np.repeat(windows[a:b] - windows[a], count[a:b])
        start = inside + np.repeat(np.cumsum(length) - length, count[a:b])
        previous, other = _ordered(held, start, _ranks(doc[owner], row[owner], pos[owner] + inside), window)
        state = (other >= window).astype(np.uint8) + (previous >= window)
        new = _changed(owner, state)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(new)) - 1
        keep = state[at] > 0
        at, end = at[keep], end[keep]
        yield _deal(RUNS, unit[owner[at]], unit[owner[at]], [
            row[owner[at]], pos[owner[at]] + inside[at], pos[owner[at]] + inside[end], state[at],
        ], 5)


def _ranks(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Places as their ranks."""
    order = np.lexsort((pos, row, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(_changed(doc[order], row[order], pos[order]))
    return rank


def _by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, (one, two, times, doc, row, pos) = _undeal(batches, 6)
    order = np.lexsort((pos, row, doc, two, one))
    unit, one, two, times, row, pos = (c[order] for c in (unit, one, two, times, row, pos))
    same = _changed(one, two)
    of_same = np.cumsum(same) - 1
    tell = (np.bincount(of_same, times) > 1)[of_same]
    lead = np.flatnonzero(same)[of_same]
    yield _deal(NAMES, unit[tell], unit[tell], [c[tell] for c in (one, two, row[lead], pos[lead])], 5)


def _resolved(key: tuple, batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    yield from _suffixes(batches, window) if key[0].as_py() == 0 else _by_name(batches)


def _covered(batch: pa.RecordBatch, told: _Told, window: int, first: bool) -> np.ndarray:
    """Which bytes of a batch lie in a marked window."""
    data, whole = text_bytes(batch.column("text"))
    edge = np.zeros(len(data) + 1, np.int32)

    def mark(low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(edge, low, 1)
        np.add.at(edge, high + window, -1)

    rows = batch.column("row").to_numpy()
    for begin, part, offsets in _pieces(batch, window):
        found = Contexts(part, offsets, window)
        if not len(found.first):
            continue
        _, row, pos = _places(batch, begin, offsets, found.doc, found.first)
        which, at = told.of_contexts(found)
        table = told.contexts
        stay = table[2][at] & np.uint64(WHOLE) > 0
        if first:
            stay &= (table[3][at] != row[which].astype(np.uint64)) | (table[4][at] != pos[which])
        which = which[stay]
        mark(found.first[which] + begin, found.last[which] + begin)
        hot = told.by_window(found)
        if len(hot) and len(told.name_key):
            owner, start, one, two = found.windows(hot)
            which, at = told._find(told.name_key, told.names, one, two)
            if first:
                _, row, pos = _places(batch, begin, offsets, found.doc[owner], start)
                which = which[(told.names[2][at] != row[which].astype(np.uint64)) | (told.names[3][at] != pos[which])]
            mark(start[which] + begin, start[which] + begin)
    runs = told.runs
    low, high = np.searchsorted(runs[0], (rows[0], rows[-1] + 1))
    runs = runs[:, low:high]
    if first:
        runs = runs[:, runs[3] > 1]
    text = whole[np.searchsorted(rows, runs[0])]
    mark(text + runs[1], text + runs[2])
    return np.cumsum(edge[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch], window: int, folder: str, first: bool, digest: bool) -> Iterator[pa.RecordBatch]:
    told, own = None, None
    for unit, batch in _by_unit(batches):
        if unit != own:
            told, own = _Told(folder, unit, True), unit
        data, offsets = text_bytes(batch.column("text"))
        gone = _covered(batch, told, window, first)
        count = np.concatenate([[0], np.cumsum(gone)])
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        head[at] = gone[at]
        spans = np.concatenate([[0], np.cumsum(head)])
        kept = data[~gone].tobytes()
        place = offsets - count[offsets]
        parts = [kept[a:b] for a, b in zip(place[:-1], place[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array(np.diff(offsets)), pa.array(np.diff(count[offsets]).astype(np.int64)),
                pa.array(np.diff(spans[offsets]).astype(np.int64)),
                pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()) if digest else pa.array(parts, pa.binary()),
            ],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def drop_repeated_strings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200, keep: str = "first", digest: bool = False,
) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept``, the bytes left.

    With ``keep="first"`` a byte goes if a string of ``window`` bytes over it
    also begins earlier: in a smaller key, or earlier in the same text.  With
    ``keep="none"`` it goes if the string also begins anywhere else.  Strings
    lie inside one text, may overlap their copies, and are judged on the input.
    ``digest`` gives ``kept`` as SHA-256 in hex, else it is binary, as a cut may
    fall inside a character.

    Null and empty texts have no bytes.  Null keys come after all others; rows
    that share a key are texts of their own in the order of a written copy.  An
    empty table gives no rows.  Other columns, whatever their names, are not
    looked at.  Keys must be integers; ``window`` is 64 to 2,000.
    """
    if keep not in ("first", "none") or not 2 * GRAM <= window <= 2000:
        raise ValueError("keep is 'first' or 'none', window 64 to 2,000")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = frozen(rows.mapInArrow(_numbered, "id bigint, row bigint, unit bigint, text string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, 2 * size // (window - GRAM) // GROUP_CONTEXTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = scratch_path(spark, "strings")
    units = rows.select(F.lit(-1).alias("kind"), F.col("unit").alias("target"), "unit").distinct()

    def shelved(told: DataFrame, widths: dict[int, int]) -> None:
        every = told.unionByName(units.select("*", *[F.lit(None).cast("binary").alias(f"c{i}") for i in range(5)]))
        per_group(every, ["unit"], partial(_shelve, folder=folder, widths=widths), "unit bigint").write.format("noop").mode("overwrite").save()

    anchored = rows.mapInArrow(partial(_anchored, window=window, groups=groups), _schema(6))
    shelved(per_group(anchored, ["target"], _compared, _schema(5)), {CONTEXTS: 5, ANCHORS: 1})
    sent = rows.mapInArrow(partial(_sent, window=window, groups=groups, folder=folder), _schema(6))
    shelved(per_group(sent, ["kind", "target"], partial(_resolved, window=window), _schema(5)), {RUNS: 4, NAMES: 4})
    return rows.mapInArrow(
        partial(_removed, window=window, folder=folder, first=keep == "first", digest=digest),
        "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept " + ("string" if digest else "binary"),
    ).withColumnRenamed("id", key)
