"""Joins, lookups and match reports.

Right sides that are small are broadcast by Spark itself from their measured
size; everything else stays a shuffle join, in which adaptive execution splits
the partitions of a hot key.  Explicit hints appear only for literal tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import AtomicType

from ..functions.recode import is_blank, lookup

#: Parts that rows without a key are dealt to in a null-safe join.
NULL_SALTS = 32


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str] | Sequence[str],
    columns: Sequence[str] | None = None,
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Join on one or several keys, possibly named differently.

    ``columns`` prunes the right side. With ``null_safe`` a missing key matches
    a missing key, as data-frame joins do (left and inner joins); both sides
    are read once, and no task gets all rows without a key.
    """
    pairs = dict(keys) if isinstance(keys, Mapping) else {key: key for key in keys}
    wanted = columns if columns is not None else [
        name for name in right.columns if name not in pairs.values()
    ]
    side = right.select(
        *[F.col(theirs).alias(f"_key_{ours}") for ours, theirs in pairs.items()], *wanted
    )
    their_keys = [f"_key_{ours}" for ours in pairs]

    if not null_safe:
        condition = reduce(and_, [F.col(ours) == F.col(key) for ours, key in zip(pairs, their_keys)])
        return left.join(side, condition, how).drop(*their_keys)
    if how not in ("left", "inner"):
        raise ValueError("missing keys are matched in left and inner joins only")
    # Rows without a key may be a large part of the left side.  They are dealt over
    # salts by their contents, and a right row without a key is there for each salt.
    missing = reduce(or_, [F.col(ours).isNull() for ours in pairs])
    their_missing = reduce(or_, [F.col(key).isNull() for key in their_keys])
    own = [F.col(f"`{f.name}`") for f in left.schema if isinstance(f.dataType, AtomicType)]
    mine = left.withColumn("_salt", F.when(missing, F.pmod(F.xxhash64(*own), F.lit(NULL_SALTS)).cast("int")).otherwise(0))
    every = F.when(their_missing, F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    theirs = side.withColumn("_their_salt", F.explode(every))
    condition = reduce(and_, [
        F.col(ours).eqNullSafe(F.col(key)) for ours, key in zip(pairs, their_keys)
    ], F.col("_salt") == F.col("_their_salt"))
    return mine.join(theirs, condition, how).drop(*their_keys, "_salt", "_their_salt")


def literal_table(spark: SparkSession, rows: Mapping[str, str], key: str, value: str) -> DataFrame:
    """Lookup rows written in code; their number is fixed, so a broadcast is safe."""
    return F.broadcast(spark.createDataFrame(list(rows.items()), f"{key} string, {value} string"))


def dict_lookup(df: DataFrame, mapping: Mapping, key: str, result: str) -> DataFrame:
    """Recode through a literal dictionary; unknown keys give null. No join."""
    return df.withColumn(result, lookup(mapping, F.col(key)))


def join_inner_lookup(
    df: DataFrame, mapping: Mapping[str, str], key: str, result: str
) -> DataFrame:
    """Keep only rows whose key is in the literal table."""
    return df.join(literal_table(df.sparkSession, mapping, key, result), key)


def join_rekey_by_name(
    df: DataFrame, names: DataFrame, name: str, key: str, drop: Sequence[str] = ()
) -> DataFrame:
    """Replace a wrong key by the one found under the row's name.

    A name listed under several keys repeats the row; ``fanout_keys`` shows them.
    """
    lookup_rows = names.where(F.col(key).isNotNull()).select(name, key)
    return df.drop(key, *drop).join(lookup_rows, name, "left")


def fanout_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value: they would multiply rows in a join."""
    per_key = df.groupBy(key).agg(F.count_distinct(value).alias("n_values"))
    return per_key.where(F.col("n_values") > 1)


def fanout_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of both sides of a join, on one row."""
    def counts(df: DataFrame, label: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")
        ).select(F.lit(label).alias("side"), "n_rows", "n_keys")

    return counts(before, "before").unionByName(counts(after, "after"))


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def anti_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with a non-blank key that is not among ``ids``."""
    keyed = df.where(~is_blank(F.col(key).cast("string")))
    return keyed.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def match_rate_report(
    df: DataFrame, matches: DataFrame, key: str, distance: str, radii: Sequence[float]
) -> DataFrame:
    """Share of rows with a match at all and within each radius.

    ``matches`` must be unique on ``key``.
    """
    joined = df.select(key).join(matches.select(key, distance), key, "left")
    matched = F.col(distance).isNotNull()
    rates = [
        F.avg(F.coalesce(F.col(distance) < r, F.lit(False)).cast("int")).alias(f"share_within_{r:g}")
        for r in radii
    ]
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(matched).alias("n_matched"),
        F.avg(matched.cast("int")).alias("share_matched"),
        *rates,
    )
