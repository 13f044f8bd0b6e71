"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python object per word.

A word is a maximal run of bytes other than space and the controls 9 to 13.
Its hash mixes eight bytes at a time with their place, so a batch costs a few
vector operations per word.  Hashes of k consecutive words are joined from
those of shorter runs by a function that mixes as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer single text is a batch of its own.
CHUNK_BYTES = 1 << 20

#: Bytes that are part of a word: all but white space, or only letters, digits and what is not ASCII.
SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random_words(seed: int, count: int) -> np.ndarray:
    steps = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15))


#: Factors and offsets of each seed.
_SEEDED = {seed: _random_words(71 + seed, 4) | np.uint64(1) for seed in range(2)}
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each span of at least one byte.

    Eight bytes at a time are mixed with their place in the span before they
    are added up, so no arrangement of equal blocks cancels out.
    """
    factor, offset, step, last = _SEEDED[seed]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    hashes = mix(((eight[starts] & _MASKS[np.minimum(size, 8)]) ^ offset) + size.astype(np.uint64) * factor)
    long = np.flatnonzero(size > 8)
    if len(long):
        blocks = (size[long] - 1) // 8
        begin = np.cumsum(blocks) - blocks
        place = np.arange(blocks.sum()) - np.repeat(begin, blocks) + 1
        at = np.repeat(starts[long], blocks) + 8 * place
        left = np.minimum(np.repeat(ends[long], blocks) - at, 8)
        parts = mix((eight[at] & _MASKS[left]) + place.astype(np.uint64) * step)
        hashes[long] = mix(hashes[long] * last + np.add.reduceat(parts, begin))
    return hashes


def _joined(first: np.ndarray, second: np.ndarray, seed: int) -> np.ndarray:
    """Hash of two strings of words in a row, from theirs."""
    return mix(first * _SEEDED[seed][0] + second + _SEEDED[seed][2])


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the words from each start to its end; spans lie in a row and do not overlap."""
    size = ends - starts
    total = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        begin = np.cumsum(size[full]) - size[full]
        place = np.arange(size[full].sum()) - np.repeat(begin, size[full])
        words = hashes[np.repeat(starts[full], size[full]) + place]
        total[full] = np.add.reduceat(mix(words + (place + 1).astype(np.uint64) * _SEEDED[seed][1]), begin)
    return mix(total + size.astype(np.uint64) * _SEEDED[seed][3])


class Words:
    """Words of the texts of one chunk.

    ``doc_start`` has the first word of each text and the number of words at
    the end; ``start`` and ``end`` are byte places in ``data``.
    """

    def __init__(self, texts: pa.Array, letters: np.ndarray | None = None):
        """``letters`` says for each byte whether it is part of a word; by default all but white space is."""
        self.data, self.offsets = text_bytes(texts)
        data, offsets = self.data, self.offsets
        solid = (SOLID if letters is None else letters)[data]
        space = ~solid
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            full = offsets[1:] > offsets[:-1]
            head, tail = offsets[:-1][full], offsets[1:][full] - 1
            first[head] = solid[head]
            last[tail] = solid[tail]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc_start = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.doc_start)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        return hash_spans(_LOWER[self.data] if lower else self.data, self.start, self.end, seed)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words inside one text."""
        starts = np.arange(max(0, len(self.start) - size + 1))
        doc = self.doc_of_word()
        return starts[doc[: len(starts)] == doc[size - 1 :]] if len(starts) else starts

    @staticmethod
    def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each start on, from hashes of 1, 2, 4 ... words in a row."""
        n, width, done = len(hashes), 1, 0
        level, whole = hashes, hashes[:0]
        while len(starts):
            if size & width:
                whole = _joined(whole[: n - done - width + 1], level[done:], seed) if done else level
                done += width
            if done == size:
                return whole[starts]
            level = _joined(level[: n - 2 * width + 1], level[width:], seed)
            width *= 2
        return hashes[:0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the place where each begins; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece have about CHUNK_BYTES."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A bigint column as numbers; null becomes the largest number, and so comes last."""
    return pc.fill_null(batch.column(column), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
