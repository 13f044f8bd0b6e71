"""Column selection, renaming and per-column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def project_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the columns of ``{new: old}`` under their new names."""
    return df.select(*[quoted(old).alias(new) for new, old in names.items()])


def transmute(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Keep only the computed columns."""
    return df.select(*[column.alias(name) for name, column in columns.items()])


def names_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [name for name in df.columns if name.startswith(tuple(prefixes))]


def names_matching(df: DataFrame, pattern: str) -> list[str]:
    return [name for name in df.columns if re.search(pattern, name)]


def select_by_prefix(df: DataFrame, *prefixes: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*map(quoted, [*keep, *names_with_prefix(df, *prefixes)]))


def select_by_regex(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*map(quoted, [*keep, *names_matching(df, pattern)]))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; naming an absent column is an error."""
    absent = set(names) - set(df.columns)
    if absent:
        raise ValueError(f"no such columns: {sorted(absent)}")
    return df.drop(*names)


def drop_if_exists(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def across_apply(
    df: DataFrame, names: Sequence[str], function: Callable[[Column], Column]
) -> DataFrame:
    """Replace every named column by ``function(column)`` in one projection."""
    return df.withColumns({name: function(quoted(name)) for name in names})


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def pull_column(df: DataFrame, name: str) -> DataFrame:
    """The distinct values of one column, still distributed.

    Meant as the right side of a semi or anti join, or for an aggregate.
    """
    return df.select(quoted(name)).distinct()
