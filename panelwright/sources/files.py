"""Readers and writers for delimited files and Parquet stages.

Files whose cells hold line breaks are read by many tasks all the same.  A
first pass gives, for each split of a file, the parity of its quotes and the
records that begin in it, were it entered inside or outside a cell.  Combined
in the order of the splits these say how each split is really entered, and the
number of its first record.  In the second pass every split puts its own lines
together; what a split leaves open is joined to the pieces that follow.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import year_month_day
from ..operators.ordered import with_row_position
from ..session import frozen


def read_delimited(
    spark: SparkSession, path: str, schema: str, separator: str = ",", **options: str
) -> DataFrame:
    """Delimited file with a header line, under a declared schema."""
    return (
        spark.read.schema(schema)
        .options(header=True, sep=separator, mode="FAILFAST", escape='"', **options)
        .csv(path)
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """A written copy of records as they are read, with their file and their number in it from 1.

    ``_id`` ascends in the order of the files' records; the copy fixes it.
    """
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    rows = frozen(rows.withColumn("_id", F.monotonically_increasing_id()))
    # Splits of a file are read by tasks of any number; places count from the start of each split.
    splits = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    # One row per split, as many as tasks.
    placed = rows.join(F.broadcast(splits), ["_file", "_block"])
    return placed.withColumn("_place", F.col("_before") + F.col("_id") - F.col("_first") + 1)


_SPLIT = ["_file", "_block"]
_WHOLE, _OPENS, _GOES_ON = range(3)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and split, in the order they have there."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where a new split begins."""
    for batch in batches:
        if batch.num_rows:
            files = batch.column("_file").dictionary_encode().indices.to_numpy()
            blocks = batch.column("_block").to_numpy()
            cut = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                yield batch.slice(int(a), int(b - a))


def _odd(lines: pa.Array) -> np.ndarray:
    """Which lines have an odd number of quotes."""
    return pc.fill_null(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False) % 2 == 1


def _split_of(batch: pa.RecordBatch) -> tuple:
    return batch.column("_file")[0].as_py(), batch.column("_block")[0].as_py()


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: whether its quotes are odd in number, and the lines that begin a record if entered outside, or inside, a cell."""
    rows: dict[tuple, list] = {}
    for batch in _by_split(batches):
        row = rows.setdefault(_split_of(batch), [0, 0, 0])
        odd = _odd(batch.column("value"))
        before = (np.cumsum(odd) - odd + row[0]) % 2
        row[1] += int((before == 0).sum())
        row[2] += int((before == 1).sum())
        row[0] = int(row[0] + odd.sum()) % 2
    if rows:
        columns = zip(*[(*split, *row) for split, row in rows.items()])
        kinds = (pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*_SPLIT, "odd", "outside", "inside"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, numbered; the piece that ends an earlier record, and the one that is left open."""
    split, inside, place, held = None, False, 0, []

    def piece(values: list, places: list, kinds: list) -> pa.RecordBatch:
        count = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array([split[0]] * count, pa.string()), pa.array([split[1]] * count, pa.int64()),
             pa.array(places, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.string())],
            [*_SPLIT, "_place", "_kind", "value"],
        )

    def left_open() -> Iterator[pa.RecordBatch]:
        if held:
            yield piece(["\n".join(held)], [place], [_OPENS if begun else _GOES_ON])

    begun = True
    for batch in _by_split(batches):
        if _split_of(batch) != split:
            yield from left_open()
            split, held = _split_of(batch), []
            inside, place = batch.column("_inside")[0].as_py() == 1, batch.column("_before")[0].as_py()
            begun = not inside
        odd = _odd(batch.column("value"))
        if not inside and not odd.any():  # the common case: a record a line
            count = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("_file"), batch.column("_block"), pa.array(np.arange(place + 1, place + count + 1)),
                 pa.array(np.full(count, _WHOLE, np.int32)), batch.column("value")],
                [*_SPLIT, "_place", "_kind", "value"],
            )
            place += count
            continue
        values, places, kinds = [], [], []
        for line, turns in zip(batch.column("value").to_pylist(), odd.tolist()):
            if not inside:
                place, begun = place + 1, True
            held.append(line)
            inside = inside != turns
            if not inside:
                values.append("\n".join(held))
                places.append(place)
                kinds.append(_WHOLE if begun else _GOES_ON)
                held = []
        if values:
            yield piece(values, places, kinds)
    yield from left_open()


def read_records(
    spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True, number: bool = False, **options: str
) -> DataFrame:
    """Delimited files whose quoted cells may hold line breaks, each read by as many tasks as it has splits.

    Quotes inside cells are doubled.  A cell's line breaks are kept; a record
    may end in CR LF; blank lines are left out.  ``number`` adds ``_file`` and
    ``_place``, the record's number in its file from 1, counting blank lines but
    not the header.  The two passes must see the same splits: if files or
    settings change in between, reading fails.
    """
    splits = _lines(spark, path).mapInArrow(_summed_up, "_file string, _block bigint, odd bigint, outside bigint, inside bigint")
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    entered = splits.withColumn("_inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    entered = entered.withColumn("_here", F.when(F.col("_inside") == 1, F.col("inside")).otherwise(F.col("outside")))
    # One row per split of the files, as many as tasks.
    entered = frozen(entered.select(*_SPLIT, "_inside", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before")))
    known = _lines(spark, path).join(F.broadcast(entered), _SPLIT, "left").withColumn("_inside", F.coalesce(
        "_inside", F.raise_error(F.lit("the splits of the files changed between two readings")).cast("bigint")
    ))
    pieces = known.mapInArrow(_put_together, "_file string, _block bigint, _place bigint, _kind int, value string")
    whole = pieces.where(F.col("_kind") == _WHOLE)
    # At most two pieces per split; a piece goes on with the record that was opened last.
    parts = frozen(pieces.where(F.col("_kind") != _WHOLE))
    order = W.partitionBy("_file").orderBy("_block", F.desc("_kind"))
    opened = parts.withColumn("_record", F.sum((F.col("_kind") == _OPENS).cast("int")).over(order))
    joined = opened.groupBy("_file", "_record").agg(
        F.min("_place").alias("_place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", (-F.col("_kind")).alias("_k"), "value"))), lambda p: p["value"]), "\n").alias("value"),
    )
    records = whole.select("_file", "_place", "value").unionByName(joined.select("_file", "_place", "value"))
    if header:
        records = records.where("_place > 1").withColumn("_place", F.col("_place") - 1)
    records = records.withColumn("value", F.regexp_replace("value", "\r$", "")).where("value != ''")
    settings = {"sep": separator, "escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1", **options}
    cells = records.select("_file", "_place", F.from_csv("value", schema, settings).alias("_cells"))
    return cells.select(*(["_file", "_place"] if number else []), "_cells.*")


def read_headerless_skip(
    spark: SparkSession, path: str, positions: Mapping[str, int], date_position: int,
    width: int, date_name: str = "date", skip: int = 2,
) -> DataFrame:
    """Files without a header, whose first ``skip`` lines are notes, addressed by position (from 1).

    The notes are counted off at the start of every file, also when it is split
    over tasks.  A line whose date cannot be read stays, with a null date;
    ``undated`` counts such lines.
    """
    schema = ", ".join(f"_c{i} string" for i in range(1, width + 1))
    lines = _numbered(spark.read.text(path)).where(F.col("_place") > skip)
    cells = F.from_csv("value", schema, {"mode": "PERMISSIVE"})
    raw = lines.where(F.trim("value") != "").select(cells.alias("_cells"))
    return raw.select(
        year_month_day(F.col(f"_cells._c{date_position}")).alias(date_name),
        *[F.col(f"_cells._c{position}").alias(name) for name, position in positions.items()],
    )


def undated(rows: DataFrame, date_name: str = "date") -> DataFrame:
    """Number of rows and of those without a readable date."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(date_name).isNull()).alias("n_undated"))


def read_sheet_export(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, kind: str = "csv",
    skip: int = 0, position: str | None = None,
) -> DataFrame:
    """An exported sheet; every cell is text, conversion comes later.

    CSV exports need their column names declared, Parquet exports carry them.
    ``skip`` data rows at the start of each file are left out; ``position``
    names a column with the row's number over all files, in order of their
    names.  Cells may hold line breaks; a large file is read by many tasks.
    """
    if kind == "parquet":
        sheet = spark.read.parquet(path)
        names = sheet.columns
        rows = sheet.select(
            *[F.col(f"`{c}`").cast("string").alias(c) for c in names],
            F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_place"),
        )
    else:
        if columns is None:
            raise ValueError("declare the columns of a CSV export")
        names = list(columns)
        schema = ", ".join(f"`{name}` string" for name in names)
        rows = read_records(spark, path, schema, number=True)
    if skip:
        rows = rows.where(F.col("_place") > skip)
    if position is not None:
        rows = with_row_position(rows, ["_file", "_place"], position)
    return rows.select(*[F.col(f"`{c}`") for c in names], *([position] if position is not None else []))


def stage_write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Persist a stage to a path that must not exist yet.

    A stage never overwrites a path it may have read from; a rewrite gets a new
    path.  Before a partitioned write the rows are rebalanced by the partition
    columns: few files per partition, and a crowded partition is split.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("errorifexists").partitionBy(
            *partition_by
        ).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)
    return path


def stage_read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def csv_export(df: DataFrame, path: str) -> str:
    """Write as CSV with a header, one file per task, quotes doubled."""
    df.write.mode("errorifexists").options(header=True, escape='"').csv(path)
    return path


def batch_split(
    df: DataFrame, key: str, batches: int = 2, exact: bool = True
) -> DataFrame:
    """Distinct ids with their batch number.

    ``exact`` cuts the sorted ids into batches of ``floor(n / batches)``, the
    last one taking the rest.  Otherwise ids are spread by hash, which needs no
    sort and gives batches of about equal size.
    """
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    if not exact:
        return ids.withColumn("batch", (F.pmod(F.xxhash64(key), F.lit(batches)) + 1).cast("int"))
    numbered = with_row_position(ids, [key], "_row")
    size = numbered.agg(F.floor(F.count(F.lit(1)) / batches)).scalar()
    batch: Column = F.least(F.ceil(F.try_divide(F.col("_row"), size)), F.lit(batches))
    return numbered.select(key, F.coalesce(batch, F.lit(batches)).cast("int").alias("batch"))


def inline_table(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A literal lookup table."""
    return spark.createDataFrame(list(rows), schema)
