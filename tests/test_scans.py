"""Lines are scanned once, however often their prices are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantmill.plans import panels

DATA = "/root/testdata/sf0.01"


def reads_lines(df) -> bool:
    return "l_shipdate" in df._jdf.queryExecution().optimizedPlan().toString()


def test_cleaning_reads_written_prices(spark):
    assert not reads_lines(panels.marked_prices(spark, DATA))


def test_market_prices_are_those_of_both_kinds_of_symbols(spark):
    """Prices out of cells of brand, place and day are those of the lines themselves."""
    lines = panels.table(spark, DATA, "lineitem").join(panels.table(spark, DATA, "part"), F.col("l_partkey") == F.col("p_partkey"))
    of = lambda symbol: lines.groupBy(symbol.alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / (F.sum(F.col("l_quantity").cast("long")) * 100)).alias("price"))
    plain = of(F.col("p_brand")).union(of(F.concat(F.lit("Line#"), F.col("l_linenumber"))))
    got = panels.market_prices(spark, DATA)
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty() and not got.isEmpty()


def test_pairs_and_legs_read_the_same_written_prices(spark):
    assert panels.brand_prices(spark, DATA) is panels.brand_prices(spark, DATA)
    assert not reads_lines(panels.brand_panel(spark, DATA))
