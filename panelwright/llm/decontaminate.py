"""Passages of test items in documents, up to a share of edited words.

An item of n words may have ``e = floor(n * max_error)`` words inserted, deleted
or replaced.  Cut into e + 1 pieces, at least one piece survives unchanged
(pigeonhole), so exact piece hits, looked up by hash over every window of every
text, lead to all matches; each is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import ALPHANUMERIC, Words, chunks

#: Bytes of item text that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 16 << 20
_SLOTS = 20


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words as runs of letters and digits, without regard to case."""
    words = Words(pc.utf8_lower(pc.fill_null(texts, "")), ALPHANUMERIC)
    return words, words.hashes()


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the first place where such a stretch ends."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    where: dict[int, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        where[word] |= 1 << i
    plus, minus, score = full, 0, size
    best, at = size, 0
    for place, word in enumerate(text, 1):
        equal = where.get(word, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(across | plus)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, at = score, place
    return best, at


def piece_index(items: list[tuple[int, str]], max_error: float) -> dict:
    """Word hashes of the items and the hashes of their pieces, by piece length."""
    words, hashes = _words(pa.array([text for _, text in items], pa.string()))
    by_length = defaultdict(list)
    patterns = []
    for i, (item, _) in enumerate(items):
        own = hashes[words.doc_start[i] : words.doc_start[i + 1]]
        errors = math.floor(len(own) * max_error)
        patterns.append((item, own, errors))
        size = len(own) // (errors + 1)
        for start in range(0, size * (errors + 1), size) if size else ():
            by_length[size].append((own[start : start + size], i, start))
    lengths = {}
    for size, pieces in by_length.items():
        codes = Words.window_hashes(
            np.concatenate([p[0] for p in pieces]), np.arange(len(pieces)) * size, size
        )
        order = np.argsort(codes, kind="stable")
        slots = np.zeros(1 << _SLOTS, bool)
        slots[codes >> np.uint64(64 - _SLOTS)] = True
        lengths[size] = (
            codes[order], np.array([p[1] for p in pieces])[order], np.array([p[2] for p in pieces])[order], slots
        )
    return {"patterns": patterns, "lengths": lengths}


def _hits(words: Words, hashes: np.ndarray, index: dict) -> Iterator[tuple[int, int, int]]:
    """Distinct (text, item, place of the item's first word) that a piece points to."""
    found = []
    doc = None
    for size, (codes, item, offset, slots) in index["lengths"].items():
        starts = words.windows(size)
        if not len(starts):
            continue
        own = Words.window_hashes(hashes, starts, size)
        maybe = np.flatnonzero(slots[own >> np.uint64(64 - _SLOTS)])
        low = np.searchsorted(codes, own[maybe], side="left")
        count = np.searchsorted(codes, own[maybe], side="right") - low
        if not count.sum():
            continue
        doc = words.doc_of_word() if doc is None else doc
        place = np.repeat(starts[maybe], count)
        entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append(np.column_stack([doc[place], item[entry], place - offset[entry]]))
    if found:
        yield from map(tuple, np.unique(np.vstack(found), axis=0).tolist())


def matches(texts: pa.Array, index: dict) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(distance, first word, word after the last) of the best match of each (text, item) that matches."""
    words, hashes = _words(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, number, first in _hits(words, hashes, index):
        if best.get((doc, number), (1,))[0] == 0:
            continue  # nothing can be nearer
        _, pattern, errors = index["patterns"][number]
        low, high = int(words.doc_start[doc]), int(words.doc_start[doc + 1])
        begin, end = max(low, first - errors), min(high, first + len(pattern) + errors)
        text = hashes[begin:end].tolist()
        distance, at = myers(pattern.tolist(), text)
        if distance <= errors:
            _, back = myers(pattern[::-1].tolist(), text[:at][::-1])
            found = (distance, begin + at - back - low, begin + at - low)
            best[doc, number] = min(found, best.get((doc, number), found))
    return best


def _found(batches: Iterator[pa.RecordBatch], index: dict) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        best = matches(batch.column("text"), index)
        if best:
            rows = [(doc, index["patterns"][n][0], *found) for (doc, n), found in sorted(best.items())]
            doc, item, distance, start, end = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["id", "item_id", "distance", "start_word", "end_word"],
            )


def _clean(batches: Iterator[pa.RecordBatch], text: str, index: dict) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, text):
        stay = np.ones(batch.num_rows, bool)
        stay[[doc for doc, _ in matches(batch.column(text), index)]] = False
        yield batch.filter(pa.array(stay))


def _indexes(items: DataFrame, key: str, text: str, max_error: float) -> Iterator[dict]:
    """Piece indexes of the items, in blocks of BLOCK_BYTES of text."""
    asked = items.select(
        F.col(f"`{key}`").cast("bigint").alias("item"), F.col(f"`{text}`").cast("string").alias("words")
    ).where(F.col("words").isNotNull())
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / BLOCK_BYTES))
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()
        yield piece_index([(r["item"], r["words"]) for r in own], max_error)


def drop_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    max_error: float = 0.2,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item in the sense of ``find_leaks``."""
    for index in _indexes(items, item_key, item_text, max_error):
        docs = docs.mapInArrow(partial(_clean, text=text, index=index), docs.schema)
    return docs


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", max_error: float = 0.2,
) -> DataFrame:
    """One row per input row and item that it holds: key, item_id, least distance and the words it spans.

    Words are runs of letters, digits and non-ASCII characters, compared
    without case; distances count words.  Null texts and texts or items without
    words match nothing; items of few words must occur unchanged.  Repeated
    rows, keys and items each give their own rows, null keys stay null.  Items
    are looked for in blocks of BLOCK_BYTES, one pass each.  Other columns are
    not looked at.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = [
        rows.mapInArrow(
            partial(_found, index=index), "id bigint, item_id bigint, distance int, start_word bigint, end_word bigint"
        )
        for index in _indexes(items, item_key, item_text, max_error)
    ]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", key)
