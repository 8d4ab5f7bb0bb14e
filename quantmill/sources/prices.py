"""Price tables: wide to long, upserts, reads, cleaning with an observed flag, and the quality report.

A price table is long: (symbol, date, price, ...).  Missing values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def valid_price(value: Column) -> Column:
    """``value`` as a double if it is a finite positive number, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (number > 0) & (number < float("inf")), number)


def normalize_symbols(names: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct non-empty symbols in upper case without blanks around them."""
    return names.select(F.upper(F.trim(F.col(column))).alias("symbol")).filter("symbol <> ''").distinct()


def extract_close(wide: DataFrame, date: str = "date") -> DataFrame:
    """A wide frame (one column per symbol) as long rows (symbol, date, price); absent cells give no row."""
    values = [c for c in wide.columns if c != date]
    long = wide.unpivot([F.col(date)], [F.col(f"`{c}`") for c in values], "symbol", "price")
    return long.filter("price is not null").select(F.upper(F.trim("symbol")).alias("symbol"), date, "price")


def extract_close_fields(wide: DataFrame, date: str = "date", field: str = "close", separator: str = "|") -> DataFrame:
    """As extract_close, for columns named field|symbol or symbol|field in any mix: only the field asked for."""
    picked = {}
    for c in wide.columns:
        a, _, b = c.partition(separator)
        if field in (a.strip().lower(), b.strip().lower()):
            picked[c] = b if a.strip().lower() == field else a
    return extract_close(wide.select(date, *[F.col(f"`{c}`").alias(s) for c, s in picked.items()]), date)


def rejected_symbols(wide: DataFrame, wanted: DataFrame, date: str = "date") -> DataFrame:
    """(symbol, rule) of a wide frame: names that are equal once normalised, symbols asked for but absent, columns without a price.

    One pass over the frame, which gives one count a column.
    """
    names = {f"_{i}": c.strip().upper() for i, c in enumerate(wide.columns) if c != date}
    by_place = wide.toDF(*[f"_{i}" for i in range(len(wide.columns))])  # names may differ by blanks alone
    counts = by_place.agg(F.array(*[F.struct(F.lit(s).alias("symbol"), F.count(c).alias("n")) for c, s in names.items()]).alias("x"))
    counts = counts.select(F.explode("x").alias("x")).groupBy("x.symbol").agg(F.count("*").alias("columns"), F.sum("x.n").alias("n"))
    rule = F.when(F.col("columns") > 1, "repeated").when(F.col("n") == 0, "all_null")
    absent = wanted.select(F.upper(F.trim("symbol")).alias("symbol")).distinct().join(counts, "symbol", "left_anti")
    return counts.select("symbol", rule.alias("rule")).filter("rule is not null").union(absent.select("symbol", F.lit("missing").alias("rule")))


def price_rows(long: DataFrame, source: str, loaded_at: Column, zone: str = "UTC", observed: Column | None = None) -> DataFrame:
    """Rows to store from (symbol, time, price): UTC date of a local time, symbol, adjusted_close, observed, source, loaded_at.

    Without a mask every price counts as observed.
    """
    date = F.to_date(F.to_utc_timestamp("time", zone))
    seen = F.lit(True) if observed is None else observed
    return long.select(date.alias("date"), F.upper(F.trim("symbol")).alias("symbol"), F.col("price").cast("double").alias("adjusted_close"), seen.alias("observed"), F.lit(source.strip()).alias("source"), loaded_at.alias("loaded_at"))


def price_row_violations(rows: DataFrame) -> DataFrame:
    """Keys of rows that may not be stored: times that fall on one date, prices or masks that are unknown, prices not above zero."""
    out = rows.groupBy("date", "symbol", "source").agg(F.count("*").alias("n"), F.count_if(valid_price(F.col("adjusted_close")).isNull()).alias("bad"), F.count_if(F.col("observed").isNull()).alias("unmasked"))
    empty = F.col("date").isNull() | (F.coalesce("symbol", F.lit("")) == "") | (F.col("source") == "")
    rule = F.when(empty, "no_key").when(F.col("n") > 1, "repeated").when(F.col("bad") > 0, "price").when(F.col("unmasked") > 0, "mask")
    return out.select("date", "symbol", rule.alias("rule")).filter("rule is not null")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which, for each key, the row with the highest ``order`` wins; at a tie the batch, then the one with the lowest hash."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_batch").desc(), F.xxhash64(*[c for c, kind in both.dtypes if not kind.startswith("map")]))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_batch")


def load_prices(prices: DataFrame, source: str, symbols: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Rows of one source, symbols and inclusive dates; the filters reach the scan."""
    prices = prices.filter(F.col("source") == source)
    if symbols is not None:
        prices = prices.filter(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    if start is not None:
        prices = prices.filter(F.col("date") >= F.lit(start).cast("date"))
    return prices.filter(F.col("date") <= F.lit(end).cast("date")) if end is not None else prices


def absent_symbols(prices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Symbols asked for that have no row: what strict reading reports."""
    return wanted.select("symbol").join(prices.select("symbol").distinct(), "symbol", "left_anti")


def last_by_date(prices: DataFrame, sequence: str) -> DataFrame:
    """One row per symbol and date, that with the highest input sequence."""
    return upsert(prices.limit(0), prices, ["symbol", "date"], sequence)


def on_spine(prices: DataFrame) -> DataFrame:
    """Every symbol on every date of the panel, with ``pos``: the date's position.

    Dates are numbered on the table of distinct dates alone, which is small (a century of days is 36,500).
    """
    dates = prices.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    symbols = prices.select("symbol").distinct()
    every = symbols.crossJoin(F.broadcast(dates))
    return every.join(prices, ["symbol", "date"], "left")


def fill_forward(panel: DataFrame, limit: int) -> DataFrame:
    """``panel`` with filled: the price, or the last one not more than ``limit`` rows back; observed: not filled."""
    upto = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last, at = F.last("price", ignorenulls=True).over(upto), F.last(F.when(F.col("price").isNotNull(), F.col("pos")), ignorenulls=True).over(upto)
    return panel.withColumn("filled", F.when(F.col("pos") - at <= limit, last)).withColumn("observed", F.col("price").isNotNull())


def quality_report(panel: DataFrame, limit: int = 3, min_coverage: float = 0.95) -> DataFrame:
    """One row per symbol of a panel on its spine: counts, coverage, stale share, range of valid dates, retained."""
    w = Window.partitionBy("symbol").orderBy("pos")
    panel = fill_forward(panel, limit).withColumn("_stale", F.coalesce(F.col("price") == F.lag("price").over(w), F.lit(False)))
    valid = F.col("price").isNotNull()
    out = panel.groupBy("symbol").agg(
        F.count("*").alias("total_observations"), F.count("price").alias("valid_observations"), F.count_if(~valid).alias("missing_or_invalid"),
        F.count_if(F.coalesce(F.col("raw") <= 0, F.lit(False))).alias("non_positive") if "raw" in panel.columns else F.lit(0).cast("long").alias("non_positive"),
        (F.count("price") / F.count("*")).alias("coverage"), (F.count_if("_stale") / F.count("*")).alias("stale_fraction"),
        F.min(F.when(valid, F.col("date"))).alias("first_valid"), F.max(F.when(valid, F.col("date"))).alias("last_valid"),
        F.count_if(~valid & F.col("filled").isNotNull()).alias("forward_filled"),
    )
    return out.withColumn("retained", F.col("coverage") >= min_coverage)


def clean(prices: DataFrame, min_coverage: float = 0.95, limit: int = 3) -> DataFrame:
    """Dates on which every retained symbol has a price, observed or filled: (symbol, date, price, observed).

    Symbols with a lower coverage than ``min_coverage`` go first; fills never look ahead.
    """
    panel = fill_forward(on_spine(prices), limit)
    kept = panel.groupBy("symbol").agg((F.count("price") / F.count("*")).alias("c")).filter(F.col("c") >= min_coverage).select("symbol")
    panel = panel.join(kept, "symbol", "left_semi")
    full = panel.groupBy("date").agg(F.count("filled").alias("n"), F.count("*").alias("m")).filter("n = m").select("date")
    return panel.join(full, "date", "left_semi").select("symbol", "date", F.col("filled").alias("price"), "observed")


def combined_mask(*masks: Column) -> Column:
    """Observed only if every supplied mask says so; an absent mask says nothing."""
    out = F.lit(True)
    for m in masks:
        out = out & F.coalesce(m, F.lit(True))
    return out


def eligible_symbols(prices: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """Per key and symbol: enough usable prices and no malformed one (``malformed`` is a Boolean column)."""
    out = prices.groupBy(*keys, "symbol").agg(F.count("price").alias("usable"), F.max("malformed").alias("bad"))
    return out.filter((F.col("usable") >= minimum) & ~F.col("bad")).select(*keys, "symbol", "usable")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A typed table without rows, which every reader returns when there is nothing."""
    return spark.createDataFrame([], schema)
