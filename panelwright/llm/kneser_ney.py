"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays that workers map.

Words are 64-bit hashes; the sorted hashes of the training words are the
vocabulary, and the place of a word in it is its id.  A bigram is the number
``previous id * 2**32 + id``.  Counts are merged by range of hash, or by part of
the bigrams, from compressed sorted arrays, and written as arrays to the shared
folder.  Words with a very large share of the corpus have their bigrams spread
over all parts, others keep theirs together.  Scoring maps the arrays into
memory and looks up a batch of distinct words or bigrams at a time, in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .shared_arrays import expand, expand_sorted, load, per_group, save, squeeze, squeeze_sorted
from .words import Words, chunks, mix

#: The end of a text, as the hash of a word that no text has.
END = np.uint64(0x243F6A8885A308D3)
#: Tokens a task gathers before it sends counts on, and tokens of one part at the average.
FLUSH = 1 << 22
PART_TOKENS = 1 << 22


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by END, and the text of each token."""
    words = Words(texts)
    doc = words.doc_of_word()
    hashes = np.full(len(words.start) + len(texts), END)
    hashes[np.arange(len(words.start)) + doc] = words.hashes(lower=True)
    return hashes, np.repeat(np.arange(len(texts)), words.count + 1)


def _by_part(keys: np.ndarray, counts: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")  # keys stay ascending inside a part
    keys, counts, part = keys[order], counts[order], part[order]
    cut = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype))
    rows = [
        (p, squeeze_sorted(keys[a:b]), squeeze(counts[a:b].astype(np.uint32)))
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "counts"]
    )


_PARTS = "part int, keys binary, counts binary"


def _merged(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [
        (expand_sorted(k.as_py()), expand(c.as_py()))
        for batch in batches for k, c in zip(batch.column("keys"), batch.column("counts"))
    ]
    keys, counts = (np.concatenate(c) for c in zip(*pairs))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _range_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _count_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    gathered: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(gathered), return_counts=True)
        gathered.clear()
        return _by_part(keys, counts, _range_part(keys, parts), parts)

    for batch in chunks(batches, "text"):
        gathered.append(_tokens(batch.column("text"))[0])
        if sum(map(len, gathered)) >= FLUSH:
            yield flush()
    if gathered:
        yield flush()


def _save_words(key: tuple, batches: list[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    part = key[0].as_py()
    words, counts = _merged(batches)
    save(folder, f"word-{part}", words)
    save(folder, f"count-{part}", counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], pa.int64()) for x in (part, len(words), int(counts.sum()))], ["part", "types", "tokens"]
    )


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    word_parts: dict[int, tuple[int, int]]  # part: first id, number of words
    parts: int  # ranges of the vocabulary
    tokens: int
    types: int
    bigram_parts: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    discounts: np.ndarray = field(default_factory=lambda: np.full((2, 3), 0.5))
    bigram_names: tuple[int, ...] = ()
    continuations: float = 0.0
    back_off: float = 1.0

    @property
    def unknown(self) -> int:
        return self.types + 1  # one more is the beginning of a text


class Vocabulary:
    """Ids of words, looked up in the mapped arrays."""

    def __init__(self, model: Model, extra: tuple[str, ...] = ()):
        self.model = model
        self.words = {p: load(model.folder, f"word-{p}") for p in model.word_parts}
        self.extra = {n: {p: load(model.folder, f"{n}-{p}") for p in model.word_parts} for n in extra}

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ids of ascending hashes, ``unknown`` for others, with what the arrays ``extra`` say of them (0)."""
        ids = np.full(len(hashes), self.model.unknown, np.uint64)
        more = {n: np.zeros(len(hashes), np.int64) for n in self.extra}
        cut = np.searchsorted(_range_part(hashes, self.model.parts), np.arange(self.model.parts + 1, dtype=np.uint64))
        for part, table in self.words.items():
            own = slice(cut[part], cut[part + 1])
            if own.stop == own.start:
                continue
            at = np.minimum(np.searchsorted(table, hashes[own]), len(table) - 1)
            ok = table[at] == hashes[own]
            ids[own] = np.where(ok, at + self.model.word_parts[part][0], self.model.unknown)
            for name, arrays in self.extra.items():
                more[name][own] = np.where(ok, arrays[part][at], 0)
        return ids, more


def _hot_ids(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.column("id").to_pylist():
            at = np.flatnonzero(load(model.folder, f"count-{part}") > least)
            yield pa.RecordBatch.from_arrays([pa.array(at + model.word_parts[part][0], pa.int64())], ["id"])


def _bigrams(ids: np.ndarray, doc: np.ndarray, model: Model) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.append(True, doc[1:] != doc[:-1])] = model.types  # the beginning of a text
    return (before << np.uint64(32)) | ids


def _bigram_part(keys: np.ndarray, model: Model) -> np.ndarray:
    before = keys >> np.uint64(32)
    at = np.searchsorted(model.hot, before)
    hot = np.zeros(len(keys), bool)
    if len(model.hot):
        hot = model.hot[np.minimum(at, len(model.hot) - 1)] == before
    return mix(np.where(hot, keys, before)) % np.uint64(model.bigram_parts)


def _count_bigrams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    vocabulary, gathered = None, []

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(gathered), return_counts=True)
        gathered.clear()
        return _by_part(keys, counts, _bigram_part(keys, model), model.bigram_parts)

    for batch in chunks(batches, "text"):
        vocabulary = vocabulary or Vocabulary(model)
        hashes, doc = _tokens(batch.column("text"))
        words, inverse = np.unique(hashes, return_inverse=True)
        gathered.append(_bigrams(vocabulary.look_up(words)[0][inverse], doc, model))
        if sum(map(len, gathered)) >= FLUSH:
            yield flush()
    if gathered:
        yield flush()


def _context_stats(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of ascending bigrams; their total and how many bigrams have count 1, 2, and 3 or more."""
    before = keys >> np.uint64(32)
    first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
    columns = [counts, counts == 1, counts == 2, counts >= 3]
    return before[first], np.column_stack([np.add.reduceat(c.astype(np.int64), first) for c in columns])


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def _save_bigrams(key: tuple, batches: list[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    part = key[0].as_py()
    keys, counts = _merged(batches)
    save(model.folder, f"bigram-{part}", keys)
    save(model.folder, f"times-{part}", counts.astype(np.uint32))
    contexts, stats = _context_stats(keys, counts)
    save(model.folder, f"context-{part}", contexts.astype(np.uint32))
    save(model.folder, f"stats-{part}", stats.astype(np.uint32))
    row = (part, len(keys), *_count_of_counts(counts))
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["part", "types", "n1", "n2", "n3", "n4"])


def _hot_stats(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.column("id").to_pylist():
            contexts, stats = load(model.folder, f"context-{part}"), load(model.folder, f"stats-{part}")
            own = np.flatnonzero(np.isin(contexts, model.hot))
            columns = [pa.array(contexts[own].astype(np.int64))]
            columns += [pa.array(stats[own, i].astype(np.int64)) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "total", "one", "two", "more"])


def _continue(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many different words of a part come before each word."""
    begins = np.array([model.word_parts[p][0] for p in sorted(model.word_parts)], np.uint64)
    names = np.array(sorted(model.word_parts))
    for batch in batches:
        for part in batch.column("id").to_pylist():
            words, counts = np.unique(load(model.folder, f"bigram-{part}") & np.uint64(0xFFFFFFFF), return_counts=True)
            where = names[np.searchsorted(begins, words, side="right") - 1]
            yield _by_part(words, counts, where, model.parts)


def _save_continuations(key: tuple, batches: list[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    part = key[0].as_py()
    first, size = model.word_parts[part]
    words, counts = _merged(batches)
    table = np.zeros(size, np.int64)
    table[words - np.uint64(first)] = counts
    save(model.folder, f"before-{part}", table)
    row = (part, int(counts.sum()), *_count_of_counts(counts), int((counts >= 3).sum()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], pa.int64()) for x in row], ["part", "total", "n1", "n2", "n3", "n4", "more"]
    )


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 1, 2, and 3 or more from how many counts are 1, 2, 3 and 4; one half where undefined."""
    if min(n1, n2, n3, n4) <= 0:
        return np.full(3, 0.5)
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])


def _discounted(counts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.maximum(counts - np.append(0.0, cut)[np.minimum(counts, 3)], 0.0)


def _list(spark: SparkSession, names: list[int]) -> DataFrame:
    """Names of parts, a task for each."""
    rows = spark.createDataFrame([(n,) for n in names], "id bigint")
    return rows.repartition(max(1, min(len(names), 1000)), "id")


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all texts of ``docs``; null and empty ones have only their end.  No text gives a model without words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch_path(spark, "ngrams")
    parts = max(1, size // 6 // PART_TOKENS)
    words = per_group(
        rows.mapInArrow(partial(_count_words, parts=parts), _PARTS), ["part"], partial(_save_words, folder=folder),
        "part bigint, types bigint, tokens bigint",
    ).orderBy("part").collect()  # one row per part
    first, word_parts = 0, {}
    for row in words:
        word_parts[row["part"]] = (first, row["types"])
        first += row["types"]
    if first >= 2**32 - 2:
        raise ValueError("ids of words have 32 bits; this corpus has more different words")
    model = Model(folder, word_parts, parts, sum(r["tokens"] for r in words), first)
    if not words:
        return model
    model.bigram_parts = parts
    # Fewer than 4 * parts words can have so large a share.
    hot = _list(spark, list(word_parts)).mapInArrow(
        partial(_hot_ids, model=model, least=model.tokens / (4 * parts)), "id bigint"
    ).collect() if parts > 1 else []
    model.hot = np.sort(np.array([r["id"] for r in hot], np.uint64))
    bigrams = per_group(
        rows.mapInArrow(partial(_count_bigrams, model=model), _PARTS), ["part"], partial(_save_bigrams, model=model),
        "part bigint, types bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint",
    ).collect()
    model.bigram_names = tuple(sorted(r["part"] for r in bigrams))
    names = _list(spark, list(model.bigram_names))
    if len(model.hot):
        sums = names.mapInArrow(
            partial(_hot_stats, model=model), "id bigint, total bigint, one bigint, two bigint, more bigint"
        ).groupBy("id").agg(*[F.sum(c) for c in ("total", "one", "two", "more")]).orderBy("id").collect()
        model.hot_stats = np.array([tuple(r)[1:] for r in sums], float).reshape(-1, 4)
        model.hot = np.array([r["id"] for r in sums], np.uint64)
    before = per_group(
        names.mapInArrow(partial(_continue, model=model), _PARTS), ["part"], partial(_save_continuations, model=model),
        "part bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint",
    ).collect()

    def added(table, *columns):
        return [sum(r[c] for r in table) for c in columns]

    model.discounts = np.array([
        discounts(*added(before, "n1", "n2", "n3", "n4")), discounts(*added(bigrams, "n1", "n2", "n3", "n4")),
    ])
    model.continuations = float(added(before, "total")[0])
    model.back_off = float(model.discounts[0] @ added(before, "n1", "n2", "more")) / model.continuations
    return model


class Scorer:
    """Probabilities from the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model, ("count", "before"))
        self.bigrams = {
            p: [load(model.folder, f"{n}-{p}") for n in ("bigram", "times", "context", "stats")]
            for p in model.bigram_names
        }

    def _seen(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ascending bigrams and the statistics of their contexts."""
        model = self.model
        times, stats = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4))
        part = _bigram_part(keys, model)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(model.bigram_parts + 1, dtype=np.uint64))
        for p, (table, count, context, stat) in self.bigrams.items():
            own = order[cut[p] : cut[p + 1]]
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
            times[own] = np.where(table[at] == keys[own], count[at], 0)
            before = (keys[own] >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(context, before), len(context) - 1)
            stats[own] = np.where((context[at] == before)[:, None], stat[at], 0)
        if len(model.hot):
            before = keys >> np.uint64(32)
            at = np.minimum(np.searchsorted(model.hot, before), len(model.hot) - 1)
            hot = model.hot[at] == before
            stats[hot] = model.hot_stats[at[hot]]
        return times, stats

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        model = self.model
        hashes, doc = _tokens(texts)
        words, inverse = np.unique(hashes, return_inverse=True)
        ids, more = self.vocabulary.look_up(words)
        keys, place = np.unique(_bigrams(ids[inverse], doc, model), return_inverse=True)
        times, stats = self._seen(keys)
        single = np.full(len(words), 1 / (model.types + 1))
        if model.continuations:
            single = _discounted(more["before"], model.discounts[0]) / model.continuations + model.back_off * single
        chance = single[inverse]
        total = np.maximum(stats[:, 0], 1)
        direct, left = _discounted(times, model.discounts[1]) / total, stats[:, 1:] @ model.discounts[1] / total
        left[stats[:, 0] == 0] = 1
        chance = direct[place] + left[place] * chance
        base = np.log10((more["count"] + 1) / (model.tokens + model.types + 1))[inverse]
        rows = len(texts)
        return {
            "n_tokens": np.bincount(doc, minlength=rows), "n_known": np.bincount(doc, (more["count"] > 0)[inverse], rows).astype(np.int64),
            "base_score": np.bincount(doc, base, rows), "score": np.bincount(doc, np.log10(chance), rows),
        }


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = None
    for batch in chunks(batches, "text"):
        scorer = scorer or Scorer(model)
        found = scorer.score(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(found[c]) for c in ("n_tokens", "n_known", "base_score", "score")]],
            ["id", "n_tokens", "n_known", "base_score", "score"],
        )


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    ``score`` is the log10 probability of the text with its end under the
    model, ``base_score`` that under add-one smoothed word counts.  Null and
    empty texts have only their end.  Repeated rows and null keys stay rows of
    their own; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    scored = rows.mapInArrow(
        partial(_score, model=model), "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(key), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
