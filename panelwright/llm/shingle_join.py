"""Near-duplicate texts by Jaccard similarity of word n-grams: MinHash LSH forest, then exact check.

Every text gets a MinHash signature; exact copies (same words) are one text
from then on.  Each tree of the forest is the sorted table of its part of the
signatures, a trie whose nodes are runs of rows with a common prefix; a row
knows how many values it shares with its neighbours, so rows that are alone in
their node leave without a shuffle.

Texts that share a prefix are candidates.  The first prefixes are whole keys of
the trees.  The least similar pair seen, as signatures show it, but at least the
threshold, tells how far prefixes must be shortened for such a pair to be found
with the target's chance; that may show still less similar pairs, and ends when
the prefixes are short enough for all.  A round compares only pairs that come
together by its shorter prefix.  Candidates that their signatures put near the
threshold are linked to clusters, and inside clusters every pair is compared
exactly, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import discard, frozen, scratch_path
from .components import components
from .shared_arrays import load, per_group, save
from .tiles import forest, per_tile, tiled
from .words import Words, _random_words, chunks, ids, sequence_hashes

TREES, DEPTH = 16, 6
LEVELS = [f"k{level}" for level in range(DEPTH)]
#: Signatures agree on this much less than the threshold before a pair is left out: five standard errors.
MARGIN = 0.2
_FACTORS = _random_words(71, TREES * DEPTH) | np.uint64(1)
#: Members of a block when signatures, or shingle sets, are compared.
SIGNATURE_BLOCK, SET_BLOCK = 512, 256
#: Distinct shingles that are multiplied at once.
COLUMNS = 1 << 14


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and the text of each.

    A text of fewer than ``size`` words, but at least one, is one shingle.
    """
    hashes = words.hashes()
    starts = words.windows(size)
    values = Words.window_hashes(hashes, starts, size) if len(starts) else np.zeros(0, np.uint64)
    doc = words.doc_of_word()[starts] if len(starts) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        own = sequence_hashes(hashes, words.doc_start[short], words.doc_start[short + 1])
        doc, values = np.concatenate([doc, short]), np.concatenate([values, own])
        order = np.argsort(doc, kind="stable")
        doc, values = doc[order], values[order]
    return values, doc


def _fingerprints(words: Words) -> list[np.ndarray]:
    return [
        sequence_hashes(words.hashes(seed=s), words.doc_start[:-1], words.doc_start[1:], s).view(np.int64)
        for s in (0, 1)
    ]


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in chunks(batches, "text"):
        words = Words(batch.column("text"))
        values, doc = shingle_sets(words, size)
        full = np.unique(doc)
        marks = np.full((batch.num_rows, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
        if len(full):
            begin = np.searchsorted(doc, full)
            for i, factor in enumerate(_FACTORS):
                marks[full, i] = np.minimum.reduceat((values * factor) >> np.uint64(32), begin)
        first, second = _fingerprints(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + batch.num_rows)), batch.column("id"), pa.array(first), pa.array(second),
             pa.array(words.count > 0), pa.array([m.tobytes() for m in marks], pa.binary())],
            ["row", "id", "f1", "f2", "full", "signature"],
        )
        row += batch.num_rows


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each text in each tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _marks(batch.column("signature")).reshape(-1, DEPTH).view(np.int32)
        trees = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
        rows = np.repeat(batch.column("row").to_numpy(), TREES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(trees), *[pa.array(keys[:, level]) for level in range(DEPTH)]],
            ["row", "tree", *LEVELS],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries with the number of values they share with a neighbour; entries that share none are left out.

    The first and the last entry of a task may go on in another one, and count as sharing all.
    """
    def common(keys: np.ndarray) -> np.ndarray:
        """Values that each row but the last shares with the next; the first column is the tree."""
        same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1)
        return np.maximum(same.sum(axis=1) - 1, 0)

    held, up = None, DEPTH  # the last entry, whose next one is not known yet, and what it shares with the one before
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        shared = common(np.column_stack([batch.column(c).to_numpy() for c in ("tree", *LEVELS)]))
        before = np.concatenate([[up], shared])
        most = np.maximum(before[:-1], shared)
        held, up = batch.slice(batch.num_rows - 1), int(before[-1])
        yield _with_shared(batch.slice(0, batch.num_rows - 1), most)
    if held is not None:
        yield _with_shared(held, np.array([DEPTH]))


def _with_shared(batch: pa.RecordBatch, shared: np.ndarray) -> pa.RecordBatch:
    whole = pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(shared.astype(np.int32))], [*batch.schema.names, "shared"]
    )
    return whole.filter(pa.array(shared > 0))


def sorted_tries(marks: DataFrame) -> DataFrame:
    """All trees as one sorted table: row, tree, the values of the key, and how many a neighbour shares."""
    columns = ", ".join(f"{c} int" for c in ("tree", *LEVELS))
    entries = marks.mapInArrow(_entries, f"row bigint, {columns}")
    order = ["tree", *LEVELS, "row"]
    return frozen(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _neighbours, f"row bigint, {columns}, shared int"
    ))


def _nodes(tries: DataFrame, depth: int, before: int | None) -> DataFrame:
    """Rows in the nodes of a depth, with the branch they were compared in ``before``, if any."""
    branch = F.xxhash64(*LEVELS[depth:before]) if before else F.col("row")
    return tries.where(F.col("shared") >= depth).select(
        "row", F.xxhash64("tree", *LEVELS[:depth]).alias("prefix"), branch.alias("branch")
    )


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _found(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Chance that a pair shares a prefix in at least one tree."""
    return 1 - (1 - similarity**depth) ** TREES


def _shortened(similarity: float, depth: int, target: float) -> int:
    """Longest prefix, of ``depth`` values or fewer, by which a pair is found with the target's chance; at least 1."""
    return next((d for d in range(depth, 1, -1) if _found(np.float64(similarity), d) >= target), 1)


def _screen(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between candidates whose signatures agree enough, and the least agreement of these."""
    table = table.combine_chunks()
    rows, first = np.unique(table.column("row").to_numpy(), return_index=True)
    marks = _marks(table.column("signature").chunk(0))[first]
    side, branch = (table.column(c).to_numpy()[first] for c in ("side", "branch"))
    across = table.column("i")[0] != table.column("j")[0]
    cluster = np.arange(len(rows))
    links, least = [], None
    for lead in range(len(rows)):
        # A row is compared with all later ones that are not linked with it yet and came by another branch; a tile of
        # two blocks leaves pairs inside one block to that block's own tile.
        other = np.flatnonzero((cluster != cluster[lead]) & (branch != branch[lead]))
        other = other[other > lead]
        if across:
            other = other[side[other] != side[lead]]
        if not len(other):
            continue
        share = (marks[other] == marks[lead]).mean(axis=1)
        near = share >= threshold - MARGIN
        if near.any():
            least = min(share[near].min(), 1.0 if least is None else least)
        for o in other[near]:
            if cluster[o] != cluster[lead]:
                links.append((rows[lead], rows[o]))
                cluster[cluster == cluster[o]] = cluster[lead]
    if least is None:
        return
    a, b = zip(*links)
    yield pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([float(least)] * len(a))], ["a", "b", "least"]
    )


def _shelve(key: tuple, batches: list[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).sort_by("f1")
    name = key[0].as_py()
    for column in ("f1", "f2", "id", "row", "root"):
        save(folder, f"{column}-{name}", table.column(column).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32())], ["shelf"])


def _sets(batches: Iterator[pa.RecordBatch], size: int, folder: str, shelves: int, names: list[int]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the texts that stand for the copies in a cluster."""
    shelf = None
    for batch in chunks(batches, "text"):
        if shelf is None:
            shelf = {n: [load(folder, f"{c}-{n}") for c in ("f1", "f2", "id", "row", "root")] for n in names}
        words = Words(batch.column("text"))
        f1, f2 = _fingerprints(words)
        own = ids(batch, "id")
        picked = []
        number = np.mod(f1, shelves)
        for n in np.unique(number):
            if n not in shelf:
                continue
            s1, s2, key, row, root = shelf[n]
            here = np.flatnonzero(number == n)
            at = np.minimum(np.searchsorted(s1, f1[here]), len(s1) - 1)
            ok = (s1[at] == f1[here]) & (s2[at] == f2[here]) & (key[at] == own[here])
            picked += zip(here[ok].tolist(), row[at[ok]].tolist(), root[at[ok]].tolist())
        if not picked:
            continue
        values, doc = shingle_sets(words, size)
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        blobs = [np.unique(values[cut[d] : cut[d + 1]]).tobytes() for d, _, _ in picked]
        _, row, root = zip(*picked)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(root, pa.int64()), pa.array(blobs, pa.binary())], ["row", "root", "shingles"]
        )


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(values, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)))
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        matrix = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        matrix[owner[a:b], column[a:b] - start] = 1
        common += matrix @ matrix.T
    return np.rint(common).astype(np.int64)


def _verify(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Number of links of each member within the tile, by copies, and links that join the same classes."""
    table = table.combine_chunks()
    rows, first = np.unique(table.column("row").to_numpy(), return_index=True)
    if len(rows) < 2:
        return
    table = table.take(pa.array(first))
    sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    common = intersections(sets)
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    side = table.column("side").to_numpy()
    if table.column("i")[0] != table.column("j")[0]:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    count = linked @ table.column("copies").to_numpy()
    joined = forest(np.argwhere(np.triu(linked)), len(rows))
    none = [None] * len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*rows, *rows[joined[:, 0]]], pa.int64()), pa.array([*none, *rows[joined[:, 1]]], pa.int64()),
         pa.array([*count, *[0] * len(joined)], pa.int64())],
        ["a", "b", "links"],
    )


def _candidates(marks: DataFrame, threshold: float, target: float) -> DataFrame:
    """Links ``a``, ``b`` between texts whose signatures are alike, from prefixes shortened until they suffice."""
    tries = sorted_tries(marks)
    links, worst, depth, before = None, 1.0, DEPTH, None
    while True:
        members = tiled(_nodes(tries, depth, before), ["prefix"], "row", SIGNATURE_BLOCK, differs="branch")
        screened = frozen(per_tile(
            members.join(marks, "row"), ["prefix"], partial(_screen, threshold=threshold),
            "a bigint, b bigint, least double",
        ))
        found = screened.select("a", "b")
        links = found if links is None else links.unionByName(found)
        least = screened.agg(F.min("least")).first()[0]
        worst = min(worst, max(threshold, 1.0 if least is None else least))
        shorter = _shortened(worst, depth, target)
        if shorter == depth:
            discard(tries)
            return links
        depth, before = shorter, depth


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
    target: float = 0.9995,
) -> DataFrame:
    """One row per input row: key, class_id, n_links (other rows linked directly) and kept.

    Two rows are linked if the Jaccard similarity of their sets of ``size``
    words is ``threshold`` or more; a class is what links reach, named by its
    smallest key, and ``kept`` marks one row of each class, one with that key.
    A pair is found with a chance of ``target`` or more; of the pairs met, those
    whose signatures agree on less than the threshold by ``MARGIN`` are left out
    (at the threshold itself less than one pair in a million).
    Texts of fewer words are one shingle; null texts and texts without words
    link with nothing and are classes of their own.  Repeated rows are copies
    like others; a null key comes after all others.  Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    every = frozen(given.mapInArrow(
        partial(_signatures, size=size),
        "row bigint, id bigint, f1 bigint, f2 bigint, full boolean, signature binary",
    ))
    narrow = every.select("row", "id", "f1", "f2", "full")
    last = F.lit(2**63 - 1)
    texts = frozen(
        narrow.where("full").groupBy("f1", "f2").agg(
            F.min(F.struct(F.coalesce("id", last).alias("id"), "row")).alias("first"), F.count(F.lit(1)).alias("copies")
        ).select("f1", "f2", "first.id", "first.row", "copies")
    )
    marks = frozen(every.select("row", "signature").join(texts.select("row"), "row"))
    links = _candidates(marks, threshold, target)
    clusters = frozen(components(links))
    folder = scratch_path(spark, "clusters")
    shelves = max(1, clusters.count() // 100_000)
    members = frozen(clusters.withColumnRenamed("node", "row").join(texts, "row"))
    shelf = F.pmod("f1", F.lit(shelves)).cast("int")
    names = [r["shelf"] for r in per_group(
        members.select("f1", "f2", "id", "row", "root", shelf.alias("shelf")), ["shelf"], partial(_shelve, folder=folder),
        "shelf int",
    ).collect()]  # one row per 100,000 texts
    sets = given.mapInArrow(
        partial(_sets, size=size, folder=folder, shelves=shelves, names=names), "row bigint, root bigint, shingles binary"
    )
    checked = tiled(members.select("row", "root", "copies"), ["root"], "row", SET_BLOCK)
    pairs = frozen(per_tile(
        checked.join(frozen(sets).drop("root"), "row"), ["root"], partial(_verify, threshold=threshold),
        "a bigint, b bigint, links bigint",
    ))
    counted = pairs.groupBy("a").agg(F.sum("links").alias("links"))
    classes = components(pairs.where("b IS NOT NULL")).withColumnRenamed("node", "row")
    named = frozen(
        texts.join(counted.withColumnRenamed("a", "row"), "row", "left").join(classes, "row", "left")
        .withColumn("root", F.coalesce("root", "row"))
    )
    smallest = frozen(named.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first")))
    known = frozen(named.join(smallest, "root").select(
        "f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("first.id").alias("class_id"), F.col("first.row").alias("first_row"),
    ))
    done = narrow.where("full").join(known, ["f1", "f2"]).select(
        "id", F.nullif("class_id", last).alias("class_id"), "n_links", (F.col("row") == F.col("first_row")).alias("kept")
    )
    alone = narrow.where("NOT full").select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept")
    )
    return done.unionByName(alone).withColumnRenamed("id", key)


def _shelve_rows(key: tuple, batches: list[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    rows = np.sort(np.concatenate([b.column("row").to_numpy() for b in batches]))
    save(folder, f"gone-{key[0].as_py()}", rows)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64())], ["shelf"])


def _staying(batches: Iterator[pa.RecordBatch], number: str, folder: str, names: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Rows that are not on the shelf of their part."""
    gone: dict[int, np.ndarray] = {}
    for batch in batches:
        rows = batch.column(number).to_numpy()
        stay = np.ones(len(rows), bool)
        for part in np.unique(rows >> _PART).tolist():
            if part in names:
                if part not in gone:
                    gone[part] = load(folder, f"gone-{part}")
                stay &= ~np.isin(rows, gone[part])
        yield batch.filter(pa.array(stay)).drop_columns([number])


#: Bits below the number of the task in a row number that Spark gives.
_PART = 33


def drop_near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, without all but one row of each class of ``near_duplicates``.

    Rows are numbered in a written copy, so repeated rows and null keys are told
    apart.  The numbers of the rows to drop are mapped into memory where the
    texts are read, so texts are not shuffled.
    """
    number = "_row" + "_" * max(map(len, docs.columns))  # longer than any given name
    rows = frozen(docs.withColumn(number, F.monotonically_increasing_id()))
    found = near_duplicates(rows, number, text, size, threshold)
    gone = found.where("NOT kept").select(F.col(number).alias("row")).withColumn("shelf", F.shiftright("row", _PART))
    folder = scratch_path(docs.sparkSession, "gone")
    shelved = per_group(gone, ["shelf"], partial(_shelve_rows, folder=folder), "shelf bigint").collect()
    names = frozenset(r["shelf"] for r in shelved)  # one row per task of the copy
    return rows.mapInArrow(partial(_staying, number=number, folder=folder, names=names), docs.schema)
