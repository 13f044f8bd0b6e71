"""Stacking, unpivoting, pivoting and splitting multi-valued cells."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import to_number
from ..functions.text import year_in_text
from .projection import names_with_prefix, quoted


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column absent from one frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot_years(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str, year: str = "year"
) -> DataFrame:
    """Wide columns whose names contain a year, to (ids, year, value)."""
    narrow = df.select(*map(quoted, [*ids, *columns]))
    long = narrow.unpivot([quoted(i) for i in ids], [quoted(c) for c in columns], "_name", value)
    return long.select(*map(quoted, ids), year_in_text(F.col("_name")).alias(year), value)


def unpivot_all(df: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """Every column to (variable, value) rows."""
    return df.unpivot([], [quoted(c) for c in df.columns], variable, value)


def pivot_flag(
    df: DataFrame, by: Sequence[str], flag: str, measure: Column, prefix: str
) -> DataFrame:
    """A boolean as two columns with its share in percent.

    A side without rows stays null, and then so does the share.
    """
    wide = df.groupBy(*by).pivot(flag, [False, True]).agg(measure)
    no, yes = f"{prefix}FALSE", f"{prefix}TRUE"
    wide = wide.withColumnsRenamed({"false": no, "true": yes})
    share = F.try_divide(F.col(yes) * 100.0, F.col(yes) + F.col(no))
    return wide.select(*by, no, yes, F.bround(share, 1).alias("pct_matched"))


def split_rows(
    df: DataFrame, columns: Sequence[str], separator: str = "\n", checked: bool = True
) -> DataFrame:
    """Parallel multi-valued cells to rows; other columns are repeated.

    A missing cell stays one row.  Cells of one row must hold equally many
    parts; with ``checked`` a mismatch raises, otherwise short cells are padded.
    """
    # In one row a missing cell counts as one missing part.
    parts = {
        c: F.coalesce(F.split(quoted(c), re.escape(separator)), F.array(F.lit(None).cast("string")))
        for c in columns
    }
    sizes = [F.size(p) for p in parts.values()]
    zipped = F.arrays_zip(*[p.alias(f"_p{i}") for i, p in enumerate(parts.values())])
    if checked and len(sizes) > 1:
        widest = F.greatest(*sizes)
        # A single missing or one-part cell is recycled by padding only if all agree.
        equal = reduce(lambda a, b: a & b, [s == widest for s in sizes])
        zipped = F.when(equal, zipped).otherwise(
            F.raise_error(F.lit("parallel cells hold different numbers of parts"))
        )
    others = [quoted(c) for c in df.columns if c not in columns]
    exploded = df.select(*others, F.explode(zipped).alias("_z"))
    names = [c for c in df.columns if c not in columns]
    return exploded.select(*map(quoted, names), *[
        F.col("_z").getField(f"_p{i}").alias(c) for i, c in enumerate(parts)
    ]).select(*map(quoted, df.columns))


def uneven_cells(df: DataFrame, columns: Sequence[str], separator: str = "\n") -> DataFrame:
    """Rows whose parallel cells hold different numbers of parts."""
    sizes = [F.coalesce(F.size(F.split(quoted(c), re.escape(separator))), F.lit(1)) for c in columns]
    return df.where(F.least(*sizes) != F.greatest(*sizes))


def build_financials(
    df: DataFrame, key: str, families: Mapping[str, str], first: int, last: int,
    missing: Sequence[str] = ("n.a.",),
) -> DataFrame:
    """Several wide families (``{result: column prefix}``) to one row per input row and year.

    The years come from the column names, so every row makes its own years: no
    shuffle, and a key that is listed twice keeps both its rows.
    """
    cells: dict[int, dict[str, list[str]]] = {}
    for result, prefix in families.items():
        for name in names_with_prefix(df, prefix):
            year = re.search(r"\d{4}", name)
            if year and first <= int(year[0]) <= last:
                cells.setdefault(int(year[0]), {}).setdefault(result, []).append(name)

    def number(names: Sequence[str]) -> Column:
        values = [to_number(quoted(n).cast("string"), *missing) for n in names]
        return F.coalesce(*values, F.lit(None).cast("double"))

    years = [
        F.struct(
            F.lit(year).cast("int").alias("year"),
            *[number(found.get(result, [])).alias(result) for result in families],
        )
        for year, found in sorted(cells.items())
    ]
    if not years:
        raise ValueError("no column of these families names a year of the range")
    return df.select(quoted(key), F.inline(F.array(*years)))
