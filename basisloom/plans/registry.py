"""The registry of queries: a name, a function of tables, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import Axis

#: Decimal places to which measured values are compared.
PLACES = 6


@dataclass
class Tables:
    """The driver's tables of one size."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def panel(self) -> DataFrame:
        """Lineitem as a panel: part k, time t, order (t, o, n), price x, size v, discount d, flag f."""
        price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
        return self.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("t"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), price.alias("x"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("f"))

    def daily(self) -> DataFrame:
        """One row per part and day: mean price x, size v."""
        return self.panel().groupBy("k", "t").agg(F.avg("x").alias("x"), F.sum("v").alias("v"))

    def returns(self) -> DataFrame:
        """Month-long dates d, strategy s and a return r made of order values."""
        rows = self.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("d"), F.col("o_orderpriority").alias("s"))
        return rows.agg(((F.avg("o_totalprice") - 250000.0) / 1000000.0).alias("r"))


AXIS = Axis(("t", "o", "n"), ("k",))
DAYS = Axis(("t",), ("k",))

PANEL = """p AS (SELECT l_partkey AS k, l_shipdate AS t, l_orderkey AS o, l_linenumber AS n, l_extendedprice / l_quantity AS x,
  l_quantity AS v, l_discount AS d, l_returnflag AS f FROM lineitem)"""
DAILY = """q AS (SELECT l_partkey AS k, l_shipdate AS t, avg(l_extendedprice / l_quantity) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"""
RETURNS = """r AS (SELECT date_trunc('month', o_orderdate) AS d, o_orderpriority AS s, (avg(o_totalprice) - 250000.0) / 1000000.0 AS r FROM orders GROUP BY ALL)"""



def _rounded(c):
    """Rounded with ties off the grid, so that both engines take the same side of an exact half."""
    return F.round(c * 10.0**PLACES + 1e-4, 0) / 10.0**PLACES + F.lit(0.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, rounded: str = "", name: str | None = None):
    """Register a function of :class:`Tables`; the ``rounded`` columns are rounded on both sides."""
    cols = rounded.split()

    def add(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: _rounded(F.col(c).cast("double")) for c in cols}) if cols else df

        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql:
            swap = ", ".join(f"round({c}::DOUBLE * 1e{PLACES} + 1e-4) / 1e{PLACES} + 0.0 AS {c}" for c in cols)
            SQL[key] = f"SELECT * REPLACE ({swap}) FROM ({sql}) AS _all" if cols else sql
        return fn

    return add
