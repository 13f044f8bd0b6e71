import uuid

import pytest
from pyspark.sql import functions as F

from panelwright.session import scratch_path, shared_dir
from panelwright.sources import files, schemas


def test_declared_schemas_parse(spark):
    for schema in (schemas.INSTALLATION, schemas.COMPLIANCE, schemas.ACCOUNT, schemas.POLICY_INDEX,
                   schemas.DEMOCRACY_INDEX, schemas.PLANT_UNITS):
        assert spark.createDataFrame([], schema).columns


def test_stage_refuses_an_existing_path(spark):
    path = scratch_path(spark, "twice")
    files.stage_write(spark.range(3), path)
    with pytest.raises(Exception):
        files.stage_write(spark.range(3), path)
    assert files.stage_read(spark, path).count() == 3


def test_partitioned_stage_prunes(spark):
    path = scratch_path(spark, "years")
    files.stage_write(spark.range(10).withColumn("year", F.col("id") % 2), path, ["year"])
    plan = files.stage_read(spark, path).where("year = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_headerless_file_with_notes(spark, tmp_path):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    (folder / "p.csv").write_text("Source, note\nDate,EU ETS\n2021-01-04,a,1.5\n2021-01-05,b,\n")
    rows = files.read_headerless_skip(spark, str(folder), {"price": 3}, 1, 3).orderBy("date").collect()
    assert [(str(r["date"]), r["price"]) for r in rows] == [("2021-01-04", "1.5"), ("2021-01-05", None)]


def test_no_data_line_is_lost(spark, tmp_path):
    dates = ["2008-01-31", "2008/01/31", "20080131", "2008.1.31", "2008 Jan 31", "08-01-31", "soon", ""]
    lines = "2008-01-01,a note that looks like data\nDate,price\n" + "".join(f"{d},{i}\n" for i, d in enumerate(dates))
    file = tmp_path / "prices.csv"
    file.write_text(lines)
    rows = files.read_headerless_skip(spark, str(file), {"price": 2}, 1, 2)
    got = {r["price"]: str(r["date"]) for r in rows.collect()}
    assert got == {str(i): "2008-01-31" if i < 6 else "None" for i in range(8)}
    assert tuple(files.undated(rows).first()) == (8, 2)


def test_notes_are_counted_off_in_split_files(spark, tmp_path):
    file = tmp_path / "long.csv"
    file.write_text("note\nnote\n" + "".join(f"2021-01-04,{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.read_headerless_skip(spark, str(file), {"n": 2}, 1, 2)
        assert sorted(int(r["n"]) for r in rows.collect()) == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_sheet_rows_are_skipped_and_numbered(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    sheet = spark.range(20).select(F.col("id").cast("string").alias("a"), F.lit("x\ny").alias("b")).coalesce(1)
    sheet.write.parquet(path) if kind == "parquet" else files.csv_export(sheet, path)
    rows = files.read_sheet_export(spark, path, ["a", "b"], kind, skip=2, position="row_no").orderBy("row_no").collect()
    assert [(r["a"], r["row_no"]) for r in rows] == [(str(i), i - 1) for i in range(2, 20)]


def test_sheet_export_reads_multi_line_cells_as_text(spark, tmp_path):
    file = tmp_path / "sheet.csv"
    file.write_text('id,Holder list\n007,"first\nsecond"\n')
    row = files.read_sheet_export(spark, str(file), ["id", "Holder list"]).first()
    assert tuple(row) == ("007", "first\nsecond")


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_batches_recombine(spark, n):
    ids = spark.range(n).select(F.format_string("id%05d", "id").alias("k"))
    got = files.batch_split(ids.union(ids), "k").collect()
    first = sorted(r["k"] for r in got if r["batch"] == 1)
    assert len(got) == n and first == [f"id{i:05d}" for i in range(n // 2)]
    spread = files.batch_split(ids, "k", batches=3, exact=False)
    assert spread.count() == n and spread.agg(F.max("batch")).first()[0] <= 3


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("split", ["1k", "4k", "64m"])
def test_cells_with_line_breaks_are_read_by_many_tasks(spark, tmp_path, split):
    import csv
    import random

    rng = random.Random(7)
    def cell(k):
        size = 9_000 if k % 61 == 0 else rng.randrange(0, 60)  # some cells span several splits
        return "".join(rng.choice(['a', 'b ', '"', ',', '\n', '\\', 'é', '""\n"']) for _ in range(size)) or "-"

    rows = {"one": [(str(k), cell(k), cell(k + 1)) for k in range(250)], "two": [("x", "\n", '"')], "three": []}
    folder = tmp_path / split
    folder.mkdir()
    for name, own in rows.items():
        with open(folder / f"{name}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\n" if name == "one" else "\r\n")
            writer.writerows([("id", "a\nb", "c"), *own])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        out = files.read_records(
            spark, str(folder), "id string, a string, b string", number=True,
            ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
        )
        got = {(r["_file"].rsplit("/", 1)[-1], r["_place"]): (r["id"], r["a"], r["b"]) for r in out.collect()}
        assert got == {(f"{name}.csv", k): row for name, own in rows.items() for k, row in enumerate(own, 1)}
        if split == "4k":
            assert files._lines(spark, str(folder)).rdd.getNumPartitions() > 10
        sheet = files.read_sheet_export(spark, str(folder / "one.csv"), ["id", "a", "b"], skip=3, position="n")
        assert sorted((r["n"], r["id"]) for r in sheet.select("n", "id").collect())[:2] == [(1, "3"), (2, "4")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
