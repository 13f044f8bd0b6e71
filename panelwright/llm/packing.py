"""Pack token sequences: pattern repeat counts by non-negative least squares.

Texts are tokenised in tasks; only the histogram of piece lengths, which has at
most as many rows as a sequence has places, reaches the driver.  There patterns
of one to four lengths that fill a sequence are enumerated, their repeat counts
are fitted to the histogram, rounded, and the rest is packed best fit first.
Pieces then find their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import frozen
from .words import chunks, hash_spans, text_bytes

#: Places for parts whose ids a worker remembers; a part has two places to be at.
SLOTS = 1 << 20
#: Ids that a worker remembers before it begins anew.
MOST_IDS = 1 << 23
#: First bytes of characters that are certainly visible: others may be white space.
_VISIBLE = np.array([33 <= b <= 126 or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])
#: Bytes of letters, and marks that end a unit of letters; an apostrophe may begin one with letters in it.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([chr(b) in ",.;:!?|()[]{}<>\"-*#%&;/" for b in range(256)])
#: How byte-level encoders of this family cut text before they merge bytes (fixed by the vocabulary file).
_UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of whole texts, put together from the ids of their parts.

    A space before a visible character always begins a new unit of a byte-level
    encoder, and so do a mark after a letter and white space after other
    characters.  Texts are cut there, on their bytes, and the ids of a text are
    those of its parts in a row.  Parts are told apart by 128-bit names and
    looked up all at once in a table of those met before; a part not met before
    is cut into units, whose ids the vocabulary's model gives.  Added tokens of
    the vocabulary, such as an end mark written out in a text, are cut out
    first; what lies between them is a text of its own.
    ``encode_special_tokens`` is the tokenizer's flag of that name: special
    ones among them are then text like any other.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        if not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or tokenizer.normalizer is not None:
            raise ValueError("a byte-level vocabulary without normaliser is needed")
        tokenizer.encode_special_tokens = encode_special_tokens
        self.tokenize = tokenizer.model.tokenize
        self.full = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        added = {
            n: t for n, t in tokenizer.get_added_tokens_decoder().items() if not (t.special and encode_special_tokens)
        }
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in or ask for what is beside them are not known")
        self.added = {t.content: n for n, t in added.items() if t.content}
        # As the tokenizer does: those outside normalisation first, and the longest where several begin.
        self.cuts = [
            re.compile("(" + "|".join(map(re.escape, sorted(some, key=len, reverse=True))) + ")")
            for late in (False, True) if (some := [t.content for t in added.values() if t.content and t.normalized == late])
        ]
        # The printable stand-in of each byte: itself, or the next free code from 256 on.
        stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
        free = iter(range(256, 512))
        self.shown = {b: b if b in stay else next(free) for b in range(256)}
        # Parts are encoded many at a time, one a line, if a line break is a unit with an id of its own.
        self.break_id = tokenizer.token_to_id(chr(self.shown[10]))
        self.lines = self.break_id is not None and not any("\n" in content for content in self.added)
        self._forget()

    def _forget(self) -> None:
        # Entry 0 is nothing; slots hold the entry of a part, under either of its names.
        self.names = np.zeros((2, SLOTS), np.uint64)
        self.entry = np.zeros(SLOTS, np.int32)
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.entries = 1
        self.used = 0

    def _remember(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of new parts, whose ids come in a row."""
        entries = self.entries + np.arange(len(sizes))
        while self.entries + len(sizes) > len(self.begin):
            self.begin, self.size = (np.concatenate([c, np.zeros_like(c)]) for c in (self.begin, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[entries], self.size[entries] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.entries += len(sizes)
        return entries

    def _one(self, ids: list[int]) -> int:
        return int(self._remember(np.array(ids, np.uint32), np.array([len(ids)]))[0])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_all(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end_id`` if given, and the place where each begins."""
        if self.used > MOST_IDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        data, offsets = text_bytes(texts)
        marked = np.zeros(len(texts), bool)
        for mark in self.added:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        # A part begins at a space before a visible character, at a mark after a letter, and where a line or a text begins or ends.
        begins = np.zeros(len(data) + 1, bool)
        if len(data):
            begins[:-2] = (data[:-1] == 32) & _VISIBLE[data[1:]]
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            blank, seen = (data >= 9) & (data <= 13), _VISIBLE[data]
            begins[1:-1] |= letter[:-1] & _MARK[data[1:]]
            # The last blank before a visible character is a unit of its own, or begins one.
            begins[1:-1] |= (blank[1:] & (seen | letter)[:-1]) | (blank[:-1] & seen[1:])
            begins[:-2] |= blank[:-1] & seen[1:]
            ends = offsets[1:][offsets[1:] > 1] - 1
            begins[ends] = (blank & np.append(False, (seen | letter)[:-1]))[ends]
        for row in np.flatnonzero(marked):
            begins[offsets[row] : offsets[row + 1]] = False
        begins[offsets[:-1]] = True
        begins = begins[: len(data)]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)
        entry = self._entries(data, start, end, first[:-1][marked])
        for row in np.flatnonzero(marked):
            entry[first[row]] = self._one(self._cut(texts[row].as_py()))
        if end_id is not None:
            entry = np.insert(entry, first[1:], self._one([end_id]))
            first = first + np.arange(len(first))
        size = self.size[entry]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[entry] - (after - size), size) + np.arange(size.sum())]
        return ids, np.concatenate([[0], after])[first]

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Entry of each part; new parts are encoded, ``skipped`` ones are not looked at."""
        one, two = (hash_spans(data, start, end, seed) for seed in (0, 1))
        shift = np.uint64(65 - SLOTS.bit_length())
        entry = np.zeros(len(start), np.int32)
        for slot in (one >> shift, two >> shift):
            hit = (self.names[0][slot] == one) & (self.names[1][slot] == two)
            entry[hit] = self.entry[slot[hit]]
        new = entry == 0
        new[skipped] = False
        new = np.flatnonzero(new)
        if len(new):
            _, lead, same = np.unique(one[new], return_index=True, return_inverse=True)
            lead = new[lead]
            body = data.tobytes()
            found = self._encoded([body[a:b].decode() for a, b in zip(start[lead].tolist(), end[lead].tolist())])
            entry[new] = found[same]
            slot = np.where(self.entry[one[lead] >> shift] == 0, one[lead] >> shift, two[lead] >> shift)
            self.names[0][slot], self.names[1][slot], self.entry[slot] = one[lead], two[lead], found
        return entry

    def _encoded(self, parts: list[str]) -> np.ndarray:
        """Entries of new parts.  A line break between parts without white space at their ends is a unit of its own."""
        lines, plain = [], np.zeros(len(parts), bool)
        for i, part in enumerate(parts):
            bare = part[1:] if part[0] == " " else part
            if bare and not bare[0].isspace() and not bare[-1].isspace() and "\n" not in bare:
                plain[i] = self.lines
                lines.append(part)
        found = np.zeros(len(parts), np.int64)
        if self.lines and lines:
            ids = np.array(self.full("\n".join([*lines, ""])), np.uint32)
            ends = np.flatnonzero(ids == self.break_id)
            sizes = np.diff(ends, prepend=-1) - 1
            found[plain] = self._remember(ids[ids != self.break_id], sizes)
        for i in np.flatnonzero(~plain).tolist():
            found[i] = self._one(self._fresh(parts[i]))
        return found

    def _cut(self, text: str) -> list[int]:
        """Ids of a text with added tokens in it."""
        parts = [(text, False)]
        for cut in self.cuts:
            parts = [
                piece for part, done in parts
                for piece in ([(part, True)] if done else [(p, i % 2 == 1) for i, p in enumerate(cut.split(part)) if p])
            ]
        return [i for p, done in parts for i in ([self.added[p]] if done else self._fresh(p))]

    def _fresh(self, text: str) -> list[int]:
        units = [text] if text.isalpha() or text[0] == " " and text[1:].isalpha() else _UNIT.findall(text)
        shown = [unit.encode().decode("latin-1").translate(self.shown) for unit in units]
        return [token.id for unit in shown for token in self.tokenize(unit)]


_PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part, seen = None, TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for batch in chunks(batches, "text"):
        encoder = encoder or Encoder(tokenizer, encode_special_tokens=False)
        ids, places = encoder.encode_all(batch.column("text"), end_id)
        view = memoryview(ids.astype("<u4", copy=False)).cast("B")
        out = []
        for key, begin, end in zip(batch.column("id").to_pylist(), places[:-1].tolist(), places[1:].tolist()):
            start, piece = begin, 0
            length = (end - begin - 1) % size + 1
            while start < end:
                crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                out.append((key, piece, start - begin, length, crc, part, int(seen[length])))
                seen[length] += 1
                start, piece, length = start + length, piece + 1, size
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
            ))],
            ["id", "piece", "start", "length", "ids_crc32", "part", "local"],
        )


def _spread(values: np.ndarray, count: int) -> np.ndarray:
    return values if len(values) <= count else values[np.linspace(0, len(values) - 1, count).astype(int)]


def patterns(lengths: np.ndarray, size: int, each: int = 12) -> np.ndarray:
    """Rows of up to four of the given lengths (0: none) that fill ``size`` to within 1/256.

    For every length: its partner, and triples and quadruples around ``each``
    spread second and third lengths.  The number of rows depends on ``size``
    and ``each`` only, not on the number of texts.
    """
    lengths = np.sort(lengths[(lengths > 0) & (lengths < size)])
    if not len(lengths):
        return np.zeros((0, 4), np.int64)
    rows = []

    def closed(head: np.ndarray) -> None:
        # Close each row with the longest given length that still fits.
        gap = size - head.sum(axis=1)
        at = np.searchsorted(lengths, gap, side="right") - 1
        ok = at >= 0
        tail = lengths[at[ok]]
        fits = gap[ok] - tail <= size // 256
        full = np.column_stack([head[ok][fits], tail[fits]])
        rows.append(np.pad(full, ((0, 0), (0, 4 - full.shape[1]))))

    closed(lengths[:, None])
    few = _spread(lengths, each)
    pairs = np.array([(a, b) for a in lengths for b in few if a + b < size], np.int64).reshape(-1, 2)
    closed(pairs)
    closed(np.column_stack([_spread(pairs, 4 * len(lengths)), few[np.arange(len(_spread(pairs, 4 * len(lengths)))) % len(few)]]))
    every = np.sort(np.vstack(rows), axis=1)[:, ::-1]
    every = every[every.sum(axis=1) <= size]
    return np.unique(every, axis=0)


def nnls(rows: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the pattern rows with the least squared error to ``wanted`` per length.

    Accelerated projected gradient; a step touches the few entries of each row.
    """
    width = len(wanted)
    used = rows > 0
    pattern = np.nonzero(used)[0]
    length = rows[used]

    def apply(x):
        return np.bincount(length, weights=x[pattern], minlength=width)

    def transpose(r):
        return np.bincount(pattern, weights=r[length], minlength=len(rows))

    x = np.zeros(len(rows))
    probe = np.ones(len(rows))
    for _ in range(20):
        probe = transpose(apply(probe / np.linalg.norm(probe)))
    step = 1 / (1.02 * np.linalg.norm(probe))
    y, momentum = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * transpose(apply(y) - wanted))
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeat counts that use every piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(pattern, repeats: int) -> None:
        for length in pattern:
            left[length] -= repeats
        chosen.append((tuple(int(x) for x in pattern), int(repeats)))

    def most(pattern) -> int:
        lengths, counts = np.unique(pattern, return_counts=True)
        return int((left[lengths] // counts).min())

    if left[size]:
        take((size,), left[size])
    rows = patterns(np.flatnonzero(left), size)
    if len(rows):
        counts = nnls(rows, left.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] < 0.5:
                break
            pattern = rows[i][rows[i] > 0]
            repeats = min(round(counts[i]), most(pattern))
            if repeats > 0:
                take(pattern, repeats)
    while True:  # the rest: the longest piece, then whatever fills its gap best
        present = np.flatnonzero(left)
        if not len(present):
            return chosen
        pattern, gap = [int(present[-1])], size - int(present[-1])
        spare = left[present].copy()
        spare[-1] -= 1
        while gap >= present[0]:
            fits = np.flatnonzero((present <= gap) & (spare > 0))
            if not len(fits):
                break
            options = present[fits]
            need = gap - options
            at = np.minimum(np.searchsorted(options, need, side="right") - 1, np.arange(len(options)))
            second = np.where(at >= 0, options[np.maximum(at, 0)], 0)
            best = int(np.argmax(options + second + options / (4.0 * size)))
            pattern.append(int(options[best]))
            gap -= int(options[best])
            spare[fits[best]] -= 1
        take(pattern, max(1, most(pattern)))


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from a rank on, first sequence and offset."""
    rows, used, sequence = [], {}, 0
    for pattern, repeats in chosen:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + repeats
            offset += length
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def _placed(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = (table["length"] << 44) + table["rank"]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(order, (length << 44) + rank, side="right") - 1
        arrays = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
        arrays += [pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])]
        yield pa.RecordBatch.from_arrays(
            arrays, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``size`` ids.

    A document is its ids and ``end_id``; only longer ones are cut, the first
    piece taking what is over.  A null or empty text is one piece of length 1.
    An added token of the vocabulary that a text spells out has its own id.
    Repeated rows and null keys are documents of their own.  An empty table
    gives no rows.  Other columns, whatever their names, are not looked at.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = frozen(rows.mapInArrow(partial(_pieces, tokenizer=tokenizer, size=size, end_id=end_id), _PIECES))
    groups = frozen(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        histogram[length] = n
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = groups.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Small in files but not in memory, so it is not to be broadcast.
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("local") + F.col("base")).select(
        "id", "piece", "start", "length", "ids_crc32", "rank"
    )
    places = slots(plan(histogram, size))
    return ranked.mapInArrow(
        partial(_placed, table=places),
        "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    ).withColumnRenamed("id", key)
