"""Sources and sinks: written from the tables, then read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import join_on
from ..session import scratch_path
from ..sources import files
from .registry import query
from .tables import cents, with_panel

_CUSTOMER_TEXT = """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS "Company name", c_mktsegment AS "Segment, main",
       CASE WHEN c_custkey % 7 = 0 THEN 'n.a.' ELSE CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) END
         AS "Balance 2019"
FROM customer"""


@query("read_delimited", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_delimited(t):
    path = files.csv_export(t.customer, scratch_path(t.spark, "customer-csv"))
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return files.read_delimited(t.spark, path, schema)


@query("read_headerless_skip", """
SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN CAST(ts AS DATE) END AS date,
       CASE WHEN event_type = 'click' THEN value END AS primary_old,
       CASE WHEN event_type = 'view' THEN value END AS primary_new,
       CASE WHEN event_type = 'purchase' THEN value END AS secondary_new
FROM events""")
def read_headerless_skip(t):
    def quote(kind):
        return F.when(F.col("event_type") == kind, F.col("value").cast("string")).otherwise("")

    cells = [
        # The forms of dates that occur in such files, and a cell that is no date.
        F.when(F.col("event_id") % 50 == 7, "n.a.").when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy/MM/dd"))
        .when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyyMMdd"))
        .when(F.col("event_id") % 5 == 3, F.date_format("ts", "yyyy.M.d"))
        .when(F.col("event_id") % 5 == 4, F.date_format("ts", "yyyy MMM d")).otherwise(F.date_format("ts", "yyyy-MM-dd")),
        F.col("event_id").cast("string"), F.lit(""), F.lit(""),
        quote("click"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), quote("view"), quote("purchase"),
    ]
    # Every file begins with two lines of notes.
    first = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0
    line = F.concat_ws(",", *cells)
    path = scratch_path(t.spark, "daily-csv")
    t.events.select(
        F.when(first, F.concat(F.lit("Source, daily prices\n2008-01-01,in force\n"), line)).otherwise(line).alias("value")
    ).write.text(path)
    raw = files.read_headerless_skip(
        t.spark, path, {"event_id": 2, "primary_old": 5, "primary_new": 10, "secondary_new": 11}, 1, 11
    )
    number = {c: F.col(c).try_cast("double") for c in ("primary_old", "primary_new", "secondary_new")}
    return raw.withColumns(number).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("read_sheet_export", _CUSTOMER_TEXT)
def read_sheet_export(t):
    balance = F.when(F.col("c_custkey") % 7 == 0, "n.a.").otherwise(cents("c_acctbal").cast("string"))
    sheet = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("Company name"),
        F.col("c_mktsegment").alias("Segment, main"), balance.alias("Balance 2019"),
    )
    path = files.csv_export(sheet, scratch_path(t.spark, "sheet-csv"))
    return files.read_sheet_export(t.spark, path, sheet.columns)


@query("stage_write", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def stage_write(t):
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = files.stage_write(part, scratch_path(t.spark, "part-stage"))
    return files.stage_read(t.spark, path)


@query("stage_read", with_panel("SELECT unit, yr, allocated, verified FROM panel"))
def stage_read(t):
    path = files.stage_write(t.panel, scratch_path(t.spark, "panel-stage"), partition_by=["yr"])
    stage = files.stage_read(t.spark, path)
    return stage.select("unit", "yr", "allocated", "verified")


@query("csv_export", "SELECT doc_id, text, lang, n_chars FROM documents")
def csv_export(t):
    # Whole texts with line breaks and quotes survive the round trip.
    documents = t.documents.select("doc_id", "text", "lang", "n_chars")
    path = files.csv_export(documents, scratch_path(t.spark, "documents-csv"))
    return files.read_records(
        t.spark, path, "doc_id bigint, text string, lang string, n_chars bigint",
        emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    )


@query("batch_split", """
WITH ids AS (SELECT DISTINCT o_custkey FROM orders),
     placed AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS k, count(*) OVER () AS n FROM ids)
SELECT o_custkey, CASE WHEN k <= n // 2 THEN 1 ELSE 2 END AS batch FROM placed""")
def batch_split(t):
    return files.batch_split(t.orders, "o_custkey")


@query("inline_table", """
SELECT n_nationkey, n_name, area, weight
FROM nation JOIN (VALUES (0, 'south', 0.5e0), (1, 'west', 1.5e0), (2, 'east', 2.5e0), (3, 'north', 3.5e0), (4, 'centre', 4.5e0))
  v(k, area, weight) ON n_regionkey = k""")
def inline_table(t):
    areas = files.inline_table(
        t.spark, "k int, area string, weight double",
        (0, "south", 0.5), (1, "west", 1.5), (2, "east", 2.5), (3, "north", 3.5), (4, "centre", 4.5),
    )
    return join_on(t.nation, areas, {"n_regionkey": "k"}, how="inner").select(
        "n_nationkey", "n_name", "area", "weight"
    )
