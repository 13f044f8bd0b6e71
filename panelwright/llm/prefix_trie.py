"""The trie of all conversation prefixes, built as a z-fast trie in batches.

Every prefix of a conversation has a 128-bit name, chained over its turns.  A
compacted node is an edge of the path of its owner, the smallest conversation
that runs through it; its handle is the prefix at the two-fattest depth of the
edge, and handles are looked up by name.  A batch locates all conversations
that are still waiting by fat binary search over their own depth, each probe
one join of (conversation, depth) and one of names.  Of those that leave the
trie at one place by one turn the smallest is inserted, the others wait.  A
conversation that is inserted owns its nodes from the depth where it left.

Counts are then added up along the tree of owners, and edges are expanded to a
row for each depth.  No list of turns or members is ever held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import discard, frozen

#: Characters of a piece of a list of ids that is hashed.
PIECE_CHARS = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth, name and characters of every prefix; rows come in the order of conversation and place."""
    own, name, depth, chars = None, b"", 0, 0
    for batch in batches:
        out = []
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text"))):
            if key != own:
                own, name, depth, chars = key, b"", 0, 0
            said = role.encode()
            step = hashlib.blake2b(name + len(said).to_bytes(8, "little") + said, digest_size=16)
            step.update(text.encode())
            name, depth, chars = step.digest(), depth + 1, chars + len(text)
            out.append((key, depth, name, chars, len(text)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                ["id", "depth", "name", "chars", "last"],
            )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _edges(placed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Compacted nodes: owner, depths (low, high], name at the handle and at the first depth."""
    owners = placed.where("own <= n")
    cuts = owners.select(F.col("id").alias("owner"), F.greatest(F.col("own") - 1, F.lit(0)).alias("cut")).unionByName(
        owners.select(F.col("id").alias("owner"), F.col("n").alias("cut"))
    ).unionByName(owners.where("up IS NOT NULL").select(F.col("up").alias("owner"), F.col("at").alias("cut"))).distinct()
    spans = cuts.withColumn("low", F.lag("cut").over(W.partitionBy("owner").orderBy("cut"))).where("low IS NOT NULL")
    spans = spans.select("owner", "low", F.col("cut").alias("high"), two_fattest(F.col("low"), F.col("cut")).alias("fat"))
    handle = prefixes.select(F.col("id").alias("owner"), F.col("depth").alias("fat"), F.col("name").alias("handle"))
    first = prefixes.select(F.col("id").alias("owner"), (F.col("depth") - 1).alias("low"), F.col("name").alias("first"))
    return spans.join(handle, ["owner", "fat"]).join(first, ["owner", "low"])


def _agree(waiting: DataFrame, prefixes: DataFrame, low: str, high: str, owner: str, out: str) -> DataFrame:
    """``out``: the deepest depth in (low, high] where a conversation's prefix is the owner's, else ``low``."""
    mine = prefixes.select("id", F.col("depth").alias("_depth"), F.col("name").alias("_name"))
    theirs = prefixes.select(F.col("id").alias("_owner"), F.col("depth").alias("_depth"), F.col("name").alias("_name"))
    asked = waiting.where(F.col(low) < F.least(high, "n")).select("id", F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(owner).alias("_owner"))
    shared = (
        asked.join(mine, "id").where("_depth > _low AND _depth <= _high")
        .join(theirs, ["_owner", "_depth", "_name"]).groupBy("id").agg(F.max("_depth").alias("_shared"))
    )
    return waiting.join(shared, "id", "left").withColumn(out, F.coalesce("_shared", low)).drop("_shared")


def _located(waiting: DataFrame, edges: DataFrame, prefixes: DataFrame, probes: int) -> DataFrame:
    """Where each conversation leaves the trie: depth ``at`` on the path of ``up``, and the name after it."""
    # low: end of the last node found; sure: depth that is known to agree.
    found = waiting.select("id", "n", "up", F.col("at").alias("low"), F.col("n").alias("high"), F.col("at").alias("sure"))
    probe = prefixes.select("id", F.col("depth").alias("fat"), F.col("name").alias("handle"))
    nodes = edges.select("handle", F.col("owner").alias("_owner"), F.col("high").alias("_end"))
    for _ in range(probes):
        fat = F.when(F.col("low") < F.col("high"), two_fattest(F.col("low"), F.col("high")))
        met = found.withColumn("fat", fat).join(probe, ["id", "fat"], "left").join(nodes, "handle", "left")
        hit = F.col("_end").isNotNull()
        found = met.select(
            "id", "n", F.when(hit, F.col("_owner")).otherwise(F.col("up")).alias("up"),
            F.when(hit, F.col("_end")).otherwise(F.col("low")).alias("low"),
            F.when(~hit & F.col("fat").isNotNull(), F.col("fat") - 1).otherwise(F.col("high")).alias("high"),
            F.when(hit, F.col("fat")).otherwise(F.col("sure")).alias("sure"),
        )
    exits = frozen(_agree(frozen(found), prefixes, "sure", "low", "up", "at"))
    # Those that agree to the end of their node may go on inside a child, before its handle.
    child = edges.select(F.col("first").alias("_first"), F.col("owner").alias("_child"), F.col("high").alias("_end"))
    after = prefixes.select("id", (F.col("depth") - 1).alias("at"), F.col("name").alias("_first"))
    inside = frozen(exits.join(after, ["id", "at"], "left").join(child, "_first", "left").withColumns({
        "up": F.coalesce("_child", "up"), "_from": F.when(F.col("_child").isNotNull(), F.col("at") + 1).otherwise(F.col("at")),
        "_to": F.coalesce("_end", "at"),
    }))
    done = _agree(inside.select("id", "n", "up", "_from", "_to"), prefixes, "_from", "_to", "up", "at")
    return done.join(after.withColumnRenamed("_first", "next"), ["id", "at"], "left").select("id", "n", "up", "at", "next")


def _insert_all(conversations: DataFrame, prefixes: DataFrame, depth: int) -> list[DataFrame]:
    """Conversations of each batch: ``own``, first depth they own; ``up``, the owner of the node above, at depth ``at``."""
    root = conversations.agg(F.min("id")).first()[0]
    none = F.lit(None).cast("bigint")
    batches = [frozen(conversations.where(F.col("id") == root).select(
        "id", "n", F.lit(0).cast("bigint").alias("own"), none.alias("up"), none.alias("at"))
    )]
    waiting = frozen(conversations.where(F.col("id") != root).select(
        "id", "n", F.lit(root).alias("up"), F.lit(0).cast("bigint").alias("at")
    ))
    while not waiting.isEmpty():
        edges = frozen(_edges(reduce(DataFrame.unionByName, batches), prefixes))
        exits = frozen(_located(waiting, edges, prefixes, depth.bit_length()))
        first = exits.where("at < n").groupBy("next").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("_first"))
        turn = frozen(exits.join(first, "id", "left").withColumn("_now", F.col("_first").isNotNull() | (F.col("at") == F.col("n"))))
        batches.append(frozen(turn.where("_now").select("id", "n", (F.col("at") + 1).alias("own"), "up", "at")))
        discard(waiting, edges, exits)
        waiting = frozen(turn.where("NOT _now").select("id", "n", "up", "at"))
    return batches


def _summed(batches: list[DataFrame], prefixes: DataFrame) -> DataFrame:
    """All conversations with what hangs below them: size, leaves and saved characters, and chars at ``at``."""
    chars = prefixes.select("id", F.col("depth").alias("at"), F.col("chars").alias("above"))
    done: list[DataFrame] = []
    for batch in reversed(batches):
        rows = batch.join(chars, ["id", "at"], "left").withColumn("above", F.coalesce("above", F.lit(0)))
        if done:
            below = reduce(DataFrame.unionByName, done).groupBy(F.col("up").alias("id")).agg(
                F.sum("size").alias("size_"), F.sum("leaves").alias("leaves_"),
                F.sum(F.col("saved") + F.col("size") * F.col("above")).alias("saved_"),
                F.max(F.when(F.col("own") <= F.col("n"), F.col("at"))).alias("last_"),
            )
            rows = rows.join(below, "id", "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in ("size_", "leaves_", "saved_", "last_")})
        size = F.coalesce("size_", F.lit(0))
        leaf = (F.col("own") <= F.col("n")) & ~F.coalesce(F.col("last_") == F.col("n"), F.lit(False))
        done.append(frozen(rows.select(
            "id", "n", "own", "up", "at", "above", (size + 1).alias("size"),
            (leaf.cast("bigint") + F.coalesce("leaves_", F.lit(0))).alias("leaves"),
            (F.coalesce("saved_", F.lit(0)) - size * F.col("above")).alias("saved"), leaf.cast("bigint").alias("leaf"),
        )))
    return reduce(DataFrame.unionByName, done)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, joined by commas."""
    own, held, first, size = None, [], 0, 0
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((*own, first, ",".join(held)))

    for batch in batches:
        for owner, depth, key in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "id"))):
            if (owner, depth) != own or size > PIECE_CHARS:
                close()
                own, held, first, size = (owner, depth), [], key, 0
            held.append(str(key))
            size += len(held[-1]) + 1
        if out:
            yield _piece_batch(out)
            out.clear()
    close()
    if out:
        yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["owner", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, state = None, None
    for batch in batches:
        out = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) == own:
                state.update(b"," + ids.encode())
                continue
            if own:
                out.append((*own, state.hexdigest()))
            own, state = (owner, depth), hashlib.sha256(ids.encode())
        if out:
            yield _digest_batch(out)
    if own:
        yield _digest_batch([(*own, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["owner", "depth", "ends_sha256"])


def _ends(everyone: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node; pieces are joined in parallel, then hashed in order."""
    ends = everyone.select(F.when(F.col("own") <= F.col("n"), F.col("id")).otherwise(F.col("up")).alias("owner"), F.col("n").alias("depth"), "id")
    pieces = ends.repartitionByRange("owner", "depth", "id").sortWithinPartitions("owner", "depth", "id").mapInArrow(
        _pieces, "owner bigint, depth bigint, first bigint, ids string"
    )
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(
        _digests, "owner bigint, depth bigint, ends_sha256 string"
    )


def prefix_trie(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
    everyone: DataFrame | None = None,
) -> DataFrame:
    """One row per node, a distinct sequence of the first d turns of some conversation, the root (d = 0) included.

    A node is named by its smallest member and its depth.  ``n_convs`` counts
    members, ``n_children`` nodes one turn longer, ``n_leaves`` childless nodes
    at or below it; ``saved_tokens`` adds, at and below it, the code points of a
    node's last text times its members but one; ``ends_sha256`` is of the ids of
    members that end there, in order, joined by commas.

    ``everyone`` adds conversations without turns by their column ``key``.
    Turns are taken in the order of ``order``, nulls first, ties by role and
    text; a null role or text is empty; repeated rows are turns of their own.
    Rows with a null ``key`` belong to no conversation and are left out.  An
    empty table has no nodes.  Other columns, whatever their names, are not
    looked at.  Keys must be integers.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{order}`").alias("place"),
        F.coalesce(F.col(f"`{role}`").cast("string"), empty).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), empty).alias("text"),
    ).where("id IS NOT NULL")
    named = rows.repartition("id").sortWithinPartitions("id", "place", "role", "text").mapInArrow(
        _names, "id bigint, depth bigint, name binary, chars bigint, last bigint"
    )
    prefixes = frozen(named)
    ids = prefixes.groupBy("id").agg(F.max("depth").alias("n"))
    if everyone is not None:
        others = everyone.select(F.col(f"`{key}`").cast("bigint").alias("id")).where("id IS NOT NULL")
        ids = ids.unionByName(others.select("id", F.lit(0).cast("bigint").alias("n"))).groupBy("id").agg(F.max("n").alias("n"))
    conversations = frozen(ids)
    if conversations.isEmpty():
        longs = (key, "depth", f"parent_{key}", "n_convs", "n_children", "n_leaves", "saved_tokens")
        return turns.sparkSession.createDataFrame([], ", ".join(f"`{c}` bigint" for c in longs) + ", ends_sha256 string")
    depth = conversations.agg(F.max("n")).first()[0]
    whole = frozen(_summed(_insert_all(conversations, prefixes, depth), prefixes))

    hung = whole.where("up IS NOT NULL").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(
        F.sum("size").alias("size_"), F.sum("leaves").alias("leaves_"), F.sum("saved").alias("saved_"),
        F.max("above").alias("above_"), F.sum((F.col("own") <= F.col("n")).cast("bigint")).alias("kids_"),
    )
    owners = whole.select(F.col("id").alias("owner"), "n", "own", "up", "leaf")
    root = owners.where("own = 0").select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "chars", "last")])
    nodes = owners.join(
        prefixes.select(F.col("id").alias("owner"), "depth", "chars", "last"), "owner"
    ).where("depth >= own").unionByName(root)
    nodes = nodes.join(hung, ["owner", "depth"], "left").join(_ends(whole), ["owner", "depth"], "left")
    below = W.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    nothing = F.lit(0)
    more = F.sum(F.coalesce("size_", nothing)).over(below)
    saved = F.sum(F.coalesce(F.col("saved_") + F.col("size_") * F.col("above_"), nothing)).over(below)
    return nodes.select(
        F.col("owner").alias(key), "depth",
        F.when(F.col("depth") > F.col("own"), F.col("owner")).otherwise(F.col("up")).alias(f"parent_{key}"),
        (more + 1).alias("n_convs"),
        ((F.col("depth") < F.col("n")).cast("bigint") + F.coalesce("kids_", nothing)).alias("n_children"),
        (F.col("leaf") + F.sum(F.coalesce("leaves_", nothing)).over(below)).alias("n_leaves"),
        (saved - more * (F.col("chars") - F.col("last"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )

