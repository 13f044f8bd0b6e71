"""Test tables in the roles of the study's tables, in Spark and as SQL text.

Money is summed in whole cents, so that totals do not depend on the order of
addition and both engines see the very same numbers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.recode import first_match
from ..operators.ordered import complete_years


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def round_all(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def r(expression: str, digits: int = 6) -> str:
    """SQL: rounded double without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0e0)"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def order_lines(self) -> DataFrame:
        """Net line revenue per order, in hundredths of cents."""
        net = cents("l_extendedprice") * F.round((1 - F.col("l_discount")) * 100).cast("bigint")
        return self.lineitem.groupBy("l_orderkey").agg(F.sum(net).alias("net"))

    @cached_property
    def unit_years(self) -> DataFrame:
        """(customer, year): status code, allocated and verified amounts, orders."""
        orders = self.orders.withColumn("yr", F.year("o_orderdate"))
        joined = orders.join(self.order_lines, orders.o_orderkey == F.col("l_orderkey"), "left")
        return joined.groupBy(F.col("o_custkey").alias("unit"), "yr").agg(
            F.min("o_orderstatus").alias("code"),
            (F.sum(cents("o_totalprice")).cast("double") / 100).alias("allocated"),
            (F.sum("net").cast("double") / 10000).alias("verified"),
            F.count(F.lit(1)).alias("n_orders"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Unit-years with unit attributes and stand-ins for ownership variables."""
        units = self.customer.select(
            F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
        )
        own = (F.col("unit") * 7 + F.col("yr")) % 5 * 25.0
        yr = F.col("yr")
        phase = first_match([
            (yr.between(1995, 1996), 1), (yr.between(1997, 1998), 2),
            (yr.between(1999, 2000), 3), (yr == 2001, 4),
        ])
        return self.unit_years.join(units, "unit").withColumns({
            "firm": F.col("unit") % 97,
            "own": own,
            "state": (own > 0).cast("int"),
            "abroad": (F.col("unit") % 3 == 0).cast("int"),
            "phase": phase,
            "ratio": F.try_divide(F.col("allocated") - F.col("verified"), F.col("verified")),
        })

    @cached_property
    def balanced(self) -> DataFrame:
        """All seven years for every unit; absent unit-years count as zero."""
        full = complete_years(
            self.unit_years.select("unit", "yr", "allocated", "verified"), ["unit"], "yr", 1995, 2001
        )
        nations = self.customer.select(
            F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("nation")
        )
        yr = F.col("yr")
        return full.join(nations, "unit").select(
            "unit", "yr", "nation", (F.col("unit") % 97).alias("firm"),
            F.floor((yr - 1993) / 2).cast("int").alias("phase"),
            (F.coalesce("allocated", F.lit(0.0)) / 100000).alias("y"),
            (F.coalesce("verified", F.lit(0.0)) / 100000).alias("x1"),
            ((F.col("unit") * 7 + yr * yr) % 11).cast("double").alias("x2"),
        )

    @cached_property
    def nation_years(self) -> DataFrame:
        """Country-year index with gaps."""
        index = self.panel.groupBy("nation", "yr").agg(
            (F.sum(F.round(F.col("allocated") * 100).cast("bigint")).cast("double") / 1e8).alias("full_index")
        )
        gap = (F.col("nation") + F.col("yr")) % 4 == 0
        return index.select("nation", "yr", F.when(~gap, F.col("full_index")).alias("idx"))


UNIT_YEARS_SQL = """
order_lines AS (
  SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)
                         * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS net
  FROM lineitem GROUP BY l_orderkey),
unit_years AS (
  SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS yr, min(o_orderstatus) AS code,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS allocated,
         CAST(sum(net) AS DOUBLE) / 10000 AS verified,
         count(*) AS n_orders
  FROM orders LEFT JOIN order_lines ON o_orderkey = l_orderkey
  GROUP BY o_custkey, year(o_orderdate))"""

PANEL_SQL = UNIT_YEARS_SQL + """,
panel AS (
  SELECT u.*, c_nationkey AS nation, c_mktsegment AS segment, unit % 97 AS firm,
         CAST((unit * 7 + yr) % 5 * 25 AS DOUBLE) AS own,
         CAST(((unit * 7 + yr) % 5 > 0) AS INTEGER) AS state,
         CAST((unit % 3 = 0) AS INTEGER) AS abroad,
         CASE WHEN yr BETWEEN 1995 AND 1996 THEN 1 WHEN yr BETWEEN 1997 AND 1998 THEN 2
              WHEN yr BETWEEN 1999 AND 2000 THEN 3 WHEN yr = 2001 THEN 4 END AS phase,
         CASE WHEN verified <> 0 THEN (allocated - verified) / verified END AS ratio
  FROM unit_years u JOIN customer ON unit = c_custkey)"""

BALANCED_SQL = UNIT_YEARS_SQL + """,
spine AS (
  SELECT unit, CAST(s.yr AS INTEGER) AS yr
  FROM (SELECT DISTINCT unit FROM unit_years), generate_series(1995, 2001) s(yr)),
balanced AS (
  SELECT unit, yr, c_nationkey AS nation, unit % 97 AS firm,
         CAST((yr - 1993) // 2 AS INTEGER) AS phase,
         coalesce(allocated, 0) / 100000 AS y, coalesce(verified, 0) / 100000 AS x1,
         CAST((unit * 7 + yr * yr) % 11 AS DOUBLE) AS x2
  FROM (SELECT * FROM spine FULL JOIN (SELECT unit, yr, allocated, verified FROM unit_years) USING (unit, yr))
  JOIN customer ON unit = c_custkey)"""

NATION_YEARS_SQL = PANEL_SQL + """,
nation_years AS (
  SELECT nation, yr,
         CASE WHEN (nation + yr) % 4 <> 0
              THEN CAST(sum(CAST(round(allocated * 100) AS BIGINT)) AS DOUBLE) / 1e8 END AS idx
  FROM panel GROUP BY nation, yr)"""


def with_panel(select: str) -> str:
    return f"WITH {PANEL_SQL.strip()}\n{select}"


def with_balanced(select: str) -> str:
    return f"WITH {BALANCED_SQL.strip()}\n{select}"


def with_nation_years(select: str) -> str:
    return f"WITH {NATION_YEARS_SQL.strip()}\n{select}"
