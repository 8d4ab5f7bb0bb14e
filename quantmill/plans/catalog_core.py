"""Registered queries: sources, cleaning, joins, hedge ratios, signals, positions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantmill.functions.durable import shared_folder
from quantmill.functions.windows import by
from quantmill.operators import hedge, panel, positions, signals, tiles
from quantmill.plans import panels
from quantmill.plans.panels import PAIR, W, brand_panel, brand_prices
from quantmill.registry import register
from quantmill.sources import prices as sources
from quantmill.sources import store
from quantmill.sources.tables import Table

RULES = signals.Rules(1.5, 0.5, 2.5, 10, 2)
SPINE = "SELECT s.symbol, d.date, d.pos, px.price FROM (SELECT DISTINCT symbol FROM px) s CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px)) d LEFT JOIN px ON px.symbol = s.symbol AND px.date = d.date"
FILLED = f"""SELECT *, CASE WHEN pos - max(CASE WHEN price IS NOT NULL THEN pos END) OVER u <= 3 THEN last_value(price IGNORE NULLS) OVER u END AS filled, lag(price) OVER (PARTITION BY symbol ORDER BY pos) AS before
  FROM ({SPINE}) WINDOW u AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
KEYS = "symbol_y symbol_x"
#: Rows that a pair must have in a run's half of the dates.
SCREEN_MINIMUM = 50


# --- sources ---------------------------------------------------------------------------------------------------------
@register("S01_extract_close", "symbol date price:9", "SELECT upper(symbol) AS symbol, date, price FROM px")
def s01(spark, sf):
    names = [f"Brand#{i}" for i in range(1, 26)]
    return sources.extract_close(brand_prices(spark, sf).groupBy("date").pivot("symbol", names).agg(F.first("price")))


def _wide(spark, sf):
    return brand_prices(spark, sf).groupBy("date").pivot("symbol", [f"Brand#{i}" for i in range(1, 26)]).agg(F.first("price"))


@register("S01_close_fields", "symbol date price:9", "SELECT upper(symbol) AS symbol, date, price FROM px")
def s01b(spark, sf):
    """Field and symbol in either order, next to a field that is not asked for."""
    wide = _wide(spark, sf)
    own = [F.col(f"`{c}`").alias(f"{c} | Close" if i % 2 else f"close|{c}") for i, c in enumerate(wide.columns[1:])]
    return sources.extract_close_fields(wide.select("date", *own, *[F.lit(1.0).alias(f"open|{c}") for c in wide.columns[1:]]))


@register("S01_rejected_symbols", "symbol rule", """SELECT upper(symbol) AS symbol, 'all_null' AS rule FROM (SELECT DISTINCT symbol FROM px) WHERE CAST(substr(symbol, 7) AS INT) % 7 = 0
  UNION ALL SELECT upper(symbol), 'missing' FROM (SELECT DISTINCT symbol FROM px) WHERE symbol = 'Brand#3' UNION ALL SELECT upper(symbol), 'repeated' FROM (SELECT DISTINCT symbol FROM px) WHERE symbol = 'Brand#4'""")
def s01c(spark, sf):
    """One column takes another's name but for blanks and case; every seventh has no price."""
    wide = _wide(spark, sf).withColumnRenamed("Brand#3", " BRAND#4 ")
    for i in (7, 14, 21):
        wide = wide.withColumn(f"Brand#{i}", F.lit(None).cast("double"))
    return sources.rejected_symbols(wide, brand_prices(spark, sf).select("symbol"))


@register("S02_normalize_symbols", "symbol", "SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part WHERE trim(p_brand) <> ''")
def s02(spark, sf):
    return sources.normalize_symbols(panels.table(spark, sf, "part").select(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")).alias("symbol")))


def _two_loads(spark, sf):
    old = brand_prices(spark, sf).withColumn("source", F.lit("main")).withColumn("loaded_at", F.lit(1).cast("long"))
    new = old.filter(F.dayofmonth("date") <= 10).withColumn("price", F.col("price") * 2).withColumn("loaded_at", F.lit(2).cast("long"))
    return old, new


LOADED = "SELECT symbol, date, CASE WHEN day(date) <= 10 THEN price * 2 ELSE price END AS price, 'main' AS source, CASE WHEN day(date) <= 10 THEN 2 ELSE 1 END AS loaded_at FROM px"


@register("S03_upsert_prices", "symbol date price:9 source loaded_at:i", LOADED)
def s03(spark, sf):
    old, new = _two_loads(spark, sf)
    return sources.upsert(old, new, ["symbol", "date", "source"], "loaded_at")


def stored(spark, schema, keys, order, part, *loads):
    """What a new table in the shared folder holds once ``loads`` have been merged into it, one after another."""
    table = Table(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", schema, keys, order, part)
    for load in loads:
        table.merge(load)
    return table.read(spark)


@register("S03_stored_prices", "symbol date price:9 source loaded_at:i", LOADED)
def s03d(spark, sf):
    """The same loads merged into a table on disk, by the month of their dates."""
    return stored(spark, "symbol string, date date, price double, source string, loaded_at long", ("symbol", "date", "source"), "loaded_at", "date_format(date, 'yyyy-MM')", *_two_loads(spark, sf))


def _rows_to_store(spark, sf):
    """Closing times of New York, which are the next day in UTC."""
    long = brand_prices(spark, sf).withColumn("time", F.col("date").cast("timestamp_ntz") + F.expr("interval 22 hours"))
    return sources.price_rows(long, " main ", F.lit(1).cast("long"), "America/New_York", F.dayofmonth("date") != 1)


@register("S03_price_rows", "date symbol adjusted_close:9 observed source", "SELECT CAST(date + INTERVAL 1 DAY AS DATE) AS date, upper(symbol) AS symbol, price AS adjusted_close, day(date) <> 1 AS observed, 'main' AS source FROM px")
def s03b(spark, sf):
    return _rows_to_store(spark, sf)


@register("S03_price_row_rules", "date symbol rule", "SELECT date, symbol, CASE day(date) WHEN 9 THEN 'repeated' WHEN 3 THEN 'price' ELSE 'mask' END AS rule FROM (SELECT CAST(date + INTERVAL 1 DAY AS DATE) AS date, upper(symbol) AS symbol FROM px) WHERE day(date) IN (3, 5, 9)")
def s03c(spark, sf):
    """Negative prices on the third of a month, no mask on the fifth, two times on the ninth."""
    rows = _rows_to_store(spark, sf)
    day = F.dayofmonth("date")
    rows = rows.withColumn("adjusted_close", F.when(day == 3, -F.col("adjusted_close")).otherwise(F.col("adjusted_close"))).withColumn("observed", F.when(day != 5, F.col("observed")))
    return sources.price_row_violations(rows.union(rows.filter(day == 9)))


@register("S04_load_prices", "symbol date price:9", "SELECT * FROM px WHERE symbol IN ('Brand#1', 'Brand#7', 'Brand#19') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def s04(spark, sf):
    rows = brand_prices(spark, sf).withColumn("source", F.lit("main"))
    rows = rows.withColumn("shown", F.col("symbol")).withColumn("symbol", F.upper("symbol"))
    return sources.load_prices(rows, "main", ["Brand#1", "Brand#7", "Brand#19"], "1996-01-01", "1997-12-31").withColumn("symbol", F.col("shown"))


@register("S04_absent_symbols", "symbol", "SELECT * FROM (VALUES ('Brand#99')) v(symbol)")
def s04b(spark, sf):
    prices = brand_prices(spark, sf)
    return sources.absent_symbols(prices, prices.select("symbol").distinct().union(spark.createDataFrame([("Brand#99",)], "symbol string")))


REPORT = "symbol total_observations:i valid_observations:i missing_or_invalid:i non_positive:i coverage:9 stale_fraction:9 first_valid last_valid forward_filled:i retained"
REPORT_SQL = f"""SELECT symbol, count(*) AS total_observations, count(price) AS valid_observations, count(*) - count(price) AS missing_or_invalid, 0 AS non_positive, count(price) / count(*) AS coverage,
  count(*) FILTER (price = before) / count(*) AS stale_fraction, min(date) FILTER (price IS NOT NULL) AS first_valid, max(date) FILTER (price IS NOT NULL) AS last_valid, count(*) FILTER (price IS NULL AND filled IS NOT NULL) AS forward_filled, count(price) / count(*) >= 0.6 AS retained FROM ({FILLED}) GROUP BY symbol"""


@register("C05_quality_report", REPORT, REPORT_SQL)
def c05(spark, sf):
    return sources.quality_report(sources.on_spine(brand_prices(spark, sf)), 3, 0.6)


@register("S05_store_quality", "run_id:i symbol coverage:9 loaded_at:i", f"SELECT CASE WHEN symbol < 'Brand#2' THEN 1 ELSE 0 END AS run_id, symbol, coverage, 1 AS loaded_at FROM ({REPORT_SQL})")
def s05(spark, sf):
    report = c05(spark, sf).withColumn("run_id", F.when(F.col("symbol") < "Brand#2", 1).otherwise(0)).select("run_id", "symbol", "coverage")
    return sources.upsert(report.withColumn("loaded_at", F.lit(0)), report.withColumn("loaded_at", F.lit(1)), ["run_id", "symbol"], "loaded_at")


@register("S05_stored_quality", "run_id:i symbol coverage:9 loaded_at:i", f"SELECT CASE WHEN symbol < 'Brand#2' THEN 1 ELSE 0 END AS run_id, symbol, coverage, CASE WHEN symbol < 'Brand#15' THEN 1 ELSE 0 END AS loaded_at FROM ({REPORT_SQL})")
def s05b(spark, sf):
    """Quality reports in a table on disk by run; a second load has some symbols again."""
    report = c05(spark, sf).select(F.when(F.col("symbol") < "Brand#2", 1).otherwise(0).alias("run_id"), "symbol", "coverage")
    again = report.filter("symbol < 'Brand#15'").withColumn("loaded_at", F.lit(1))
    return stored(spark, "run_id int, symbol string, coverage double, loaded_at int", ("run_id", "symbol"), "loaded_at", "run_id", report.withColumn("loaded_at", F.lit(0)), again)


@register("S06_load_quality", "symbol coverage:9", f"SELECT symbol, coverage FROM ({REPORT_SQL}) WHERE symbol < 'Brand#2' ORDER BY symbol")
def s06(spark, sf):
    return s05(spark, sf).filter("run_id = 1").orderBy("symbol")


def screening_batch(spark, sf):
    """Screening results of two runs (formation in two halves), for the stored tables."""
    rows = brand_panel(spark, sf)
    runs = rows.withColumn("run_id", F.when(F.col("date") < "1998-06-01", "run-a").otherwise("run-b"))
    keys = ("run_id", *PAIR)
    runs = runs.withColumn("pos", F.row_number().over(by(keys, "date")) - 1)
    spans = runs.groupBy("run_id").agg(F.min("date").alias("formation_start"), F.max("date").alias("formation_end"))
    out = hedge.screen_windows(runs, ("run_id",), SCREEN_MINIMUM, 0.05, 60.0, 0.5).join(panels.brand_pairs(spark, sf), list(PAIR)).join(spans, "run_id")
    return out.withColumn("loaded_at", F.lit(1))


@register("S07_store_screening", "run_id symbol_y symbol_x corrected_p:6 half_life:4 half_life_was_infinite selected rank:i")
def s07(spark, sf):
    batch = screening_batch(spark, sf)
    return store.store_screening(batch.limit(0).withColumn("half_life_was_infinite", F.lit(False)), batch)


@register("S07_stored_screening", "run_id symbol_y symbol_x corrected_p:6 half_life:4 half_life_was_infinite selected rank:i")
def s07b(spark, sf):
    """Screening results in a table on disk by run, one run after the other."""
    rows = s07(spark, sf).select("run_id", *PAIR, "corrected_p", "half_life", "half_life_was_infinite", "selected", "rank", "loaded_at")
    schema = "run_id string, symbol_y string, symbol_x string, corrected_p double, half_life double, half_life_was_infinite boolean, selected boolean, rank int, loaded_at int"
    return stored(spark, schema, ("run_id", *PAIR), "loaded_at", "run_id", *[rows.filter(F.col("run_id") == r) for r in ("run-a", "run-b")])


@register("S08_load_screening", "run_id symbol_y symbol_x corrected_p:6 half_life:4 rank:i")
def s08(spark, sf):
    return store.load_screening(s07(spark, sf), "run-a", True, 10, 5)


def _runs(spark, sf):
    months = panels.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(F.max(F.col("o_orderdate").cast("date")).alias("created_at"), F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return months.select("run_id", "created_at"), months.select("run_id", "orders", "cents")


RUNS = "SELECT strftime(o_orderdate, '%Y-%m') AS run_id, max(CAST(o_orderdate AS DATE)) AS created_at, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1"


@register("S09_new_runs", "run_id created_at", f"SELECT run_id, created_at FROM ({RUNS}) WHERE run_id >= '1998-01'")
def s09(spark, sf):
    identities, _ = _runs(spark, sf)
    return store.new_runs(identities.filter("run_id < '1998-01'"), identities)


@register("S09_stored_runs", "run_id created_at", f"SELECT run_id, created_at FROM ({RUNS})")
def s09b(spark, sf):
    """Runs in a table on disk by year: those that are not stored yet are appended."""
    identities, _ = _runs(spark, sf)
    table = Table(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", "run_id string, created_at date", ("run_id",), "created_at", "substring(run_id, 1, 4)")
    table.merge(identities.filter("run_id < '1998-01'"))
    table.merge(store.new_runs(table.read(spark), identities))
    return table.read(spark)


@register("S10_list_runs", "run_id created_at orders:i", f"SELECT * FROM ({RUNS}) ORDER BY created_at DESC, run_id LIMIT 10 OFFSET 5")
def s10(spark, sf):
    return store.list_runs(*_runs(spark, sf), 10, 5)


@register("S11_load_run", "run_id created_at orders:i cents:i", f"SELECT * FROM ({RUNS}) WHERE run_id = '1996-03'")
def s11(spark, sf):
    return store.list_runs(*_runs(spark, sf)).filter("run_id = '1996-03'")


@register("S12_unknown_run", "run_id symbol_y symbol_x", "SELECT 'x' AS run_id, symbol_y, symbol_x FROM pairs WHERE false")
def s12(spark, sf):
    return store.load_screening(s07(spark, sf), "no such run")


# --- cleaning --------------------------------------------------------------------------------------------------------
@register("C01_last_per_date", "user_id:i date event_id:i value:6", "SELECT user_id, CAST(ts AS DATE) AS date, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def c01(spark, sf):
    rows = panels.table(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "event_id", "value")
    return sources.last_by_date(rows, "event_id").withColumnRenamed("symbol", "user_id")


@register("C02_valid_prices", "event_type n:i valid:i non_positive:i", "SELECT event_type, count(*) AS n, count(*) FILTER (value - 20 > 0) AS valid, count(*) FILTER (value - 20 <= 0) AS non_positive FROM events GROUP BY 1")
def c02(spark, sf):
    rows = panels.table(spark, sf, "events").select("event_type", (F.col("value") - 20).cast("string").alias("raw"))
    rows = rows.withColumn("price", sources.valid_price(F.col("raw")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("price").alias("valid"), F.count_if(F.col("raw").cast("double") <= 0).alias("non_positive"))


@register("C03_covered_symbols", "symbol coverage:9", f"SELECT symbol, count(price) / count(*) AS coverage FROM ({SPINE}) GROUP BY 1 HAVING count(price) / count(*) >= 0.61")
def c03(spark, sf):
    return sources.on_spine(brand_prices(spark, sf)).groupBy("symbol").agg((F.count("price") / F.count("*")).alias("coverage")).filter("coverage >= 0.61")


@register("C04_fill_forward", "symbol date filled:9 observed", f"SELECT symbol, date, filled, price IS NOT NULL AS observed FROM ({FILLED})")
def c04(spark, sf):
    return sources.fill_forward(sources.on_spine(brand_prices(spark, sf)), 3)


@register("C06_clean_panel", "symbol date price:9 observed", f"""WITH f AS ({FILLED}), k AS (SELECT symbol FROM f GROUP BY 1 HAVING count(price) / count(*) >= 0.3), g AS (SELECT f.* FROM f JOIN k USING (symbol))
  SELECT symbol, date, filled AS price, price IS NOT NULL AS observed FROM g WHERE date IN (SELECT date FROM g GROUP BY 1 HAVING count(filled) = count(*))""")
def c06(spark, sf):
    return sources.clean(brand_prices(spark, sf), 0.3, 3)


@register("C07_observed_counts", "symbol observed:i marked:i", f"SELECT symbol, count(price) AS observed, count(filled) - count(price) AS marked FROM ({FILLED}) GROUP BY 1")
def c07(spark, sf):
    return c04(spark, sf).groupBy("symbol").agg(F.count_if("observed").alias("observed"), F.count_if(~F.col("observed") & F.col("filled").isNotNull()).alias("marked"))


@register("C08_combined_mask", "symbol date seen", f"SELECT symbol, date, price IS NOT NULL AND (day(date) > 5) AS seen FROM ({FILLED})")
def c08(spark, sf):
    rows = c04(spark, sf)
    return rows.withColumn("seen", sources.combined_mask(F.col("observed"), F.dayofmonth("date") > 5, F.lit(None).cast("boolean")))


@register("C09_formation_slice", "symbol date price:9", "SELECT * FROM px WHERE date BETWEEN DATE '1995-06-01' AND DATE '1996-06-01'")
def c09(spark, sf):
    return brand_prices(spark, sf).filter(F.col("date").between("1995-06-01", "1996-06-01"))


@register("C10_eligible_symbols", "year:i symbol usable:i", "SELECT year(date) AS year, symbol, count(*) AS usable FROM px GROUP BY 1, 2 HAVING count(*) >= 225")
def c10(spark, sf):
    rows = brand_prices(spark, sf).withColumn("year", F.year("date")).withColumn("malformed", F.col("price") <= 0)
    return sources.eligible_symbols(rows, ["year"], 225)


@register("C11_possible_groups", "year:i group_name symbols:i", "SELECT year, group_name, count(*) AS symbols FROM (SELECT year(date) AS year, symbol FROM px GROUP BY 1, 2 HAVING count(*) >= 225) JOIN uni USING (symbol) GROUP BY 1, 2 HAVING count(*) >= 2")
def c11(spark, sf):
    eligible = c10(spark, sf).join(panels.universe(brand_prices(spark, sf)), "symbol")
    return eligible.groupBy("year", "group_name").agg(F.count("*").alias("symbols")).filter("symbols >= 2")


# --- joins -----------------------------------------------------------------------------------------------------------
@register("J01_candidate_pairs", "symbol_y symbol_x group_name", "SELECT * FROM pairs")
def j01(spark, sf):
    return panels.brand_pairs(spark, sf)


@register("J02_pair_panel", "symbol_y symbol_x date pos:i price_y:9 price_x:9", "SELECT * FROM pp")
def j02(spark, sf):
    return brand_panel(spark, sf)


FOLDS = "SELECT k AS fold_id, k * 63 AS formation_start_pos, k * 63 + 503 AS formation_end_pos, k * 63 + 504 AS trading_start_pos, k * 63 + 566 AS trading_end_pos FROM range(0, (SELECT (count(DISTINCT date) - 567) // 63 + 1 FROM px)) t(k)"
NUMBERED = "SELECT symbol, date, price, dense_rank() OVER (ORDER BY date) - 1 AS pos FROM px"


def brand_folds(spark, sf):
    return panel.folds(brand_prices(spark, sf).agg(F.count_distinct("date").alias("n")), 504, 63)


def numbered(spark, sf):
    """Brand prices with the date's position among all dates."""
    prices = brand_prices(spark, sf)
    dates = prices.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    return prices.join(F.broadcast(dates), "date")


@register("J03_rows_in_folds", "fold_id:i symbol rows:i first:i last:i", f"SELECT fold_id, symbol, count(*) AS rows, min(pos) AS first, max(pos) AS last FROM ({NUMBERED}) JOIN ({FOLDS}) ON pos BETWEEN formation_start_pos AND trading_end_pos GROUP BY 1, 2")
def j03(spark, sf):
    return panel.in_fold(numbered(spark, sf), brand_folds(spark, sf)).groupBy("fold_id", "symbol").agg(F.count("*").alias("rows"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@register("J04_scenario_fan_out", "scenario:i symbol n:i cost:9", "SELECT s AS scenario, symbol, count(*) AS n, max(price) * s AS cost FROM px, (VALUES (1), (5), (10)) v(s) GROUP BY 1, 2")
def j04(spark, sf):
    scenarios = spark.createDataFrame([(1,), (5,), (10,)], "scenario int")
    rows = brand_prices(spark, sf).crossJoin(F.broadcast(scenarios))  # a handful of scenarios
    return rows.groupBy("scenario", "symbol").agg(F.count("*").alias("n"), F.max(F.col("price") * F.col("scenario")).alias("cost"))


@register("J05_strategy_benchmark", "symbol_y symbol_x n:i product:9", "SELECT a.symbol_y, a.symbol_x, count(*) AS n, sum(a.r * b.r) AS product FROM rt a JOIN (SELECT date, avg(r) AS r FROM rt GROUP BY 1) b USING (date) GROUP BY 1, 2")
def j05(spark, sf):
    rows = panels.returns(spark, sf)
    bench = rows.groupBy("date").agg(F.avg("r").alias("b"))
    return rows.join(bench, "date").groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("b")).alias("product"))


@register("J06_regime_labels", "symbol_y symbol_x label n:i", "SELECT symbol_y, symbol_x, CAST(year(date) AS VARCHAR) AS label, count(*) AS n FROM pp GROUP BY 1, 2, 3")
def j06(spark, sf):
    rows = brand_panel(spark, sf)
    labels = rows.select("date").distinct().withColumn("label", F.year("date").cast("string"))
    return rows.join(labels, "date").groupBy(*PAIR, "label").agg(F.count("*").alias("n"))


@register("J07_runs_with_summary", "run_id created_at orders:i cents:i", f"SELECT * FROM ({RUNS})")
def j07(spark, sf):
    return store.list_runs(*_runs(spark, sf))


@register("J08_common_horizon", "date", "SELECT date FROM pp GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT symbol_y, symbol_x FROM pp))")
def j08(spark, sf):
    rows = brand_panel(spark, sf).withColumn("pair", F.concat("symbol_y", "symbol_x"))
    return panel.common_labels(rows, "pair", "date")


@register("J08_common_months", "month", "SELECT month FROM (SELECT DISTINCT symbol_y, symbol_x, strftime(date, '%Y-%m') AS month FROM pp) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT symbol_y, symbol_x FROM pp))")
def j08b(spark, sf):
    rows = brand_panel(spark, sf).select(F.concat("symbol_y", "symbol_x").alias("pair"), F.date_format("date", "yyyy-MM").alias("month"))
    return panel.common_labels(rows, "pair", "month")


@register("J09_union_of_folds", "pos:i folds:i", f"SELECT pos, count(*) AS folds FROM (SELECT DISTINCT pos FROM ({NUMBERED})) JOIN ({FOLDS}) ON pos BETWEEN formation_start_pos AND formation_end_pos GROUP BY 1")
def j09(spark, sf):
    dates = numbered(spark, sf).select("pos").distinct()
    return panel.in_fold(dates, brand_folds(spark, sf), "formation").groupBy("pos").agg(F.count("*").alias("folds"))


@register("J10_duplicate_rejection", "o_custkey:i n:i", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1")
def j10(spark, sf):
    orders = panels.table(spark, sf, "orders")
    return orders.join(orders.filter("o_orderdate < timestamp_ntz '1998-01-01'").select("o_custkey"), "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("J11_next_fillable", "symbol_y symbol_x pos:i next_pos:i", "SELECT *, min(CASE WHEN day(date) <= 20 THEN pos END) OVER (PARTITION BY symbol_y, symbol_x ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_pos FROM pp")
def j11(spark, sf):
    return panel.next_fillable(brand_panel(spark, sf), list(PAIR), F.dayofmonth("date") <= 20)


@register("J12_distinct_union", "symbol groups", "SELECT s AS symbol, array_to_string(list_sort(list_distinct(list(group_name))), ',') AS groups FROM (SELECT symbol_y AS s, group_name FROM pairs UNION ALL SELECT symbol_x, group_name FROM pairs) GROUP BY 1")
def j12(spark, sf):
    pairs = panels.brand_pairs(spark, sf)
    both = pairs.select(F.col("symbol_y").alias("symbol"), "group_name").union(pairs.select("symbol_x", "group_name"))
    return both.groupBy("symbol").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("group_name"))), ",").alias("groups"))


@register("J13_misaligned_dates", "symbol_y symbol_x date side", """SELECT symbol_y, symbol_x, date, CASE WHEN b.side IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT symbol_y, symbol_x, date, 1 AS side FROM pairs JOIN px ON symbol = symbol_y) a
  FULL JOIN (SELECT symbol_y, symbol_x, date, 1 AS side FROM pairs JOIN px ON symbol = symbol_x) b USING (symbol_y, symbol_x, date) WHERE a.side IS NULL OR b.side IS NULL""")
def j13(spark, sf):
    prices = brand_prices(spark, sf)
    pairs = panel.candidate_pairs(panels.universe(prices)).select(*PAIR)
    legs = [pairs.join(prices.select(F.col("symbol").alias(s), "date"), s) for s in PAIR]
    return panel.misaligned(*legs, [*PAIR, "date"])


# --- hedge ratios and diagnostics ------------------------------------------------------------------------------------
@register("H01_static_ols", f"{KEYS} n:i alpha:6 beta:6", "SELECT * FROM fit")
def h01(spark, sf):
    return hedge.ols(brand_panel(spark, sf))


@register("H01_static_spread", f"{KEYS} pos:i spread:6", "SELECT * FROM sp")
def h01b(spark, sf):
    return hedge.ols_spread(brand_panel(spark, sf))


ALL_PAIRS = "SELECT y.symbol AS symbol_y, x.symbol AS symbol_x, count(*) AS n, regr_intercept(ln(y.price), ln(x.price)) AS alpha, regr_slope(ln(y.price), ln(x.price)) AS beta, sqrt(greatest(regr_syy(ln(y.price), ln(x.price)) - regr_sxy(ln(y.price), ln(x.price)) * regr_slope(ln(y.price), ln(x.price)), 0) / (count(*) - 1)) AS spread_standard_deviation FROM sx y JOIN sx x ON y.date = x.date AND y.symbol < x.symbol GROUP BY 1, 2 HAVING count(*) >= 20"


@register("H01_all_pairs", f"{KEYS} n:i alpha:6 beta:6 spread_standard_deviation:6", ALL_PAIRS)
def h01c(spark, sf):
    """All pairs of suppliers (499,500 of 1,000) with 20 common days or more, from tiles of a Gram matrix."""
    return tiles.all_pairs_ols(panels.supplier_prices(spark, sf), panels.supplier_universe(spark, sf), 20)


@register("H02_rolling_ols", f"{KEYS} pos:i beta:5 alpha:4", f"SELECT *, CASE WHEN c = 60 THEN cv / v END AS beta, CASE WHEN c = 60 THEN my - cv / v * mx END AS alpha FROM (SELECT *, count(*) OVER w AS c, covar_samp(ln(price_y), ln(price_x)) OVER w AS cv, var_samp(ln(price_x)) OVER w AS v, avg(ln(price_y)) OVER w AS my, avg(ln(price_x)) OVER w AS mx FROM pp WINDOW w AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))")
def h02(spark, sf):
    return hedge.rolling_ols(brand_panel(spark, sf), 60)


@register("H03_kalman", f"{KEYS} pos:i alpha:6 beta:6 spread:6 innovation:6 innovation_variance:6")
def h03(spark, sf):
    return hedge.kalman(brand_panel(spark, sf))


@register("H04_adf", f"{KEYS} statistic:6 p_value:6 lags:i observations:i critical_5:6")
def h04(spark, sf):
    return hedge.adf(hedge.ols_spread(brand_panel(spark, sf)))


@register("H05_cointegration", f"{KEYS} statistic:6 p_value:6 lags:i critical_5:6")
def h05(spark, sf):
    return hedge.cointegration(brand_panel(spark, sf))


HALF = f"SELECT symbol_y, symbol_x, CASE WHEN abs(1 + s) >= 1 THEN CAST('inf' AS DOUBLE) ELSE -ln(2) / s END AS half_life FROM (SELECT symbol_y, symbol_x, regr_slope(spread - b, b) AS s, count(*) AS n FROM (SELECT *, lag(spread) OVER ({W}) AS b FROM sp) GROUP BY 1, 2) WHERE n >= 30"


@register("H06_half_life", f"{KEYS} half_life:6", HALF)
def h06(spark, sf):
    return hedge.half_life(hedge.ols_spread(brand_panel(spark, sf)))


HURST = "SELECT symbol_y, symbol_x, CASE WHEN count(d) = 19 AND min(d) > 0 THEN regr_slope(ln(CASE WHEN d > 0 THEN d END), ln(k)) END AS hurst FROM (" + " UNION ALL ".join(f"SELECT symbol_y, symbol_x, {k} AS k, stddev_samp(d) AS d FROM (SELECT symbol_y, symbol_x, spread - lag(spread, {k}) OVER ({W}) AS d FROM sp) GROUP BY 1, 2" for k in range(2, 21)) + ") GROUP BY 1, 2"


@register("H07_hurst", f"{KEYS} hurst:6", HURST)
def h07(spark, sf):
    return hedge.hurst(hedge.ols_spread(brand_panel(spark, sf)))


@register("H08_diagnostics", f"{KEYS} statistic:6 p_value:6 half_life:6 hurst:6")
def h08(spark, sf):
    spreads = hedge.ols_spread(brand_panel(spark, sf))
    return hedge.adf(spreads).join(hedge.half_life(spreads), list(PAIR)).join(hedge.hurst(spreads), list(PAIR))


@register("H09_spread_validity", f"{KEYS} n:i reason", "SELECT symbol_y, symbol_x, count(spread) AS n, CASE WHEN count(spread) < 400 THEN 'too_few' WHEN max(spread) - min(spread) <= 1e-12 * greatest(max(abs(spread)), 1.0) THEN 'degenerate' END AS reason FROM sp GROUP BY 1, 2")
def h09(spark, sf):
    return hedge.spread_validity(hedge.ols_spread(brand_panel(spark, sf)), minimum=400)


@register("H10_eligibility", f"{KEYS} observations:i reason", "SELECT symbol_y, symbol_x, count(*) AS observations, CASE WHEN count(*) < 900 THEN 'insufficient_observations' WHEN min(price_y) = max(price_y) OR min(price_x) = max(price_x) THEN 'degenerate_prices' END AS reason FROM pp GROUP BY 1, 2")
def h10(spark, sf):
    return hedge.eligibility(brand_panel(spark, sf), minimum=900)


@register("H11_benjamini_hochberg", "p_partkey:i p:9 corrected_p:9", """SELECT *, greatest(0.0, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS corrected_p
  FROM (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, count(*) OVER () AS m FROM (SELECT p_partkey, p_retailprice / 1e4 AS p FROM part))""")
def h11(spark, sf):
    tests = panels.table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 1e4).alias("p"))
    return hedge.benjamini_hochberg(tests, "p", (), ("p_partkey",))


@register("H12_screen", f"{KEYS} observations:i beta:6 cointegration_statistic:6 p_value:6 corrected_p:6 half_life:4 hurst:6 selected rank:i reasons")
def h12(spark, sf):
    return hedge.screen(brand_panel(spark, sf)).withColumn("reasons", F.array_join("rejection_reasons", ","))


@register("H13_failed_results", f"{KEYS} observations:i reasons", "SELECT symbol_y, symbol_x, count(*) AS observations, 'insufficient_observations' AS reasons FROM pp GROUP BY 1, 2 HAVING count(*) < 900")
def h13(spark, sf):
    return hedge.screen(brand_panel(spark, sf), minimum=900).filter(F.col("corrected_p").isNull()).withColumn("reasons", F.array_join("rejection_reasons", ","))


@register("H14_diagnostic_coverage", f"{KEYS} rows:i finite_beta:i usable:i", f"SELECT symbol_y, symbol_x, count(*) AS rows, greatest(count(*) - 60, 0) AS finite_beta, greatest(count(*) - 60, 0) AS usable FROM pp GROUP BY 1, 2")
def h14(spark, sf):
    return hedge.rolling_ols(brand_panel(spark, sf), 60).groupBy(*PAIR).agg(F.count("*").alias("rows"), F.count("beta").alias("finite_beta"), F.count("spread").alias("usable"))


@register("H15_rank_one", "run_id symbol_y symbol_x corrected_p:6 rank:i")
def h15(spark, sf):
    return s07(spark, sf).filter("rank = 1")


# --- signals and positions -------------------------------------------------------------------------------------------
@register("W01_zscore", f"{KEYS} pos:i date rolling_mean:6 rolling_std:6 zscore:5", "SELECT * FROM zs")
def w01(spark, sf):
    rows = brand_panel(spark, sf).withColumn("hedge_ratio", 1 + (panels.number("symbol_x") % 5) / 10)
    return signals.standardise(rows.withColumn("spread", F.ln("price_y") - F.col("hedge_ratio") * F.ln("price_x")), panels.LOOKBACK)


@register("W01_all_pairs", f"{KEYS} rows:i date zscore:5", f"""SELECT symbol_y, symbol_x, count(z) AS rows, arg_max(date, date) FILTER (z IS NOT NULL) AS date, arg_max(z, date) FILTER (z IS NOT NULL) AS zscore FROM (
  SELECT *, CASE WHEN count(s) OVER w = 60 AND stddev_samp(s) OVER w > 1e-12 THEN (s - avg(s) OVER w) / stddev_samp(s) OVER w END AS z FROM (SELECT symbol_y, symbol_x, y.date, ln(y.price) - alpha - beta * ln(x.price) AS s FROM ({ALL_PAIRS}) JOIN sx y ON y.symbol = symbol_y JOIN sx x ON x.symbol = symbol_x AND x.date = y.date)
  WINDOW w AS (PARTITION BY symbol_y, symbol_x ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2 HAVING count(z) > 0""")
def w01c(spark, sf):
    """60-row z-scores of the static spreads of all pairs of suppliers: the last of each, and how many there are."""
    return tiles.all_pairs_last_zscore(panels.supplier_prices(spark, sf), panels.supplier_universe(spark, sf), 60, 20)


@register("W01_population_zscore", f"{KEYS} pos:i rolling_std:6", f"SELECT *, CASE WHEN c = 20 THEN s END AS rolling_std FROM (SELECT *, count(spread) OVER w AS c, stddev_pop(spread) OVER w AS s FROM hs WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))")
def w01b(spark, sf):
    return signals.standardise(w01(spark, sf), 20, ddof=0)


@register("F01_entry_rule", "state n:i", "SELECT CASE WHEN z <= -1.5 THEN 'LONG_SPREAD' WHEN z >= 1.5 THEN 'SHORT_SPREAD' ELSE 'FLAT' END AS state, count(*) AS n FROM zs GROUP BY 1")
def f01(spark, sf):
    return panels.signal_table(spark, sf).select(signals.entry_rule(F.col("z"), 1.5).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@register("F02_exit_rule", "state reason n:i", """SELECT v.st AS state, CASE WHEN v.st = 'LONG_SPREAD' AND z <= -2.5 OR v.st = 'SHORT_SPREAD' AND z >= 2.5 THEN 'STOP' WHEN pos % 12 >= 10 THEN 'TIME' WHEN v.st = 'LONG_SPREAD' AND z >= -0.5 OR v.st = 'SHORT_SPREAD' AND z <= 0.5 THEN 'MEAN_REVERSION' ELSE 'NONE' END AS reason, count(*) AS n
  FROM zs, (VALUES ('LONG_SPREAD'), ('SHORT_SPREAD')) v(st) GROUP BY 1, 2""")
def f02(spark, sf):
    rows = panels.signal_table(spark, sf).withColumn("state", F.explode(F.array(F.lit("LONG_SPREAD"), F.lit("SHORT_SPREAD"))))
    return rows.withColumn("reason", signals.exit_rule(F.col("state"), F.col("z"), F.col("pos") % 12, 0.5, 2.5, 10)).groupBy("state", "reason").agg(F.count("*").alias("n"))


STATES = """WITH RECURSIVE z1 AS (SELECT symbol_y, symbol_x, pos, z FROM zs), m AS (
  SELECT symbol_y, symbol_x, pos, z, CASE WHEN z <= -1.5 THEN 1 WHEN z >= 1.5 THEN -1 ELSE 0 END AS st, 0 AS held, 0 AS cool, CASE WHEN z <= -1.5 THEN 'ENTER_LONG' WHEN z >= 1.5 THEN 'ENTER_SHORT' ELSE 'NONE' END AS event, 0 AS holding_period, 0 AS cooldown_remaining FROM z1 WHERE pos = 0
  UNION ALL
  SELECT symbol_y, symbol_x, pos, z, CASE WHEN st = 0 THEN CASE WHEN cool = 0 AND z <= -1.5 THEN 1 WHEN cool = 0 AND z >= 1.5 THEN -1 ELSE 0 END WHEN ex = 'NONE' THEN st ELSE 0 END, CASE WHEN st = 0 OR ex <> 'NONE' THEN 0 ELSE held + 1 END,
    CASE WHEN st = 0 THEN greatest(cool - 1, 0) WHEN ex = 'NONE' THEN cool ELSE 2 END, CASE WHEN st = 0 THEN CASE WHEN cool = 0 AND z <= -1.5 THEN 'ENTER_LONG' WHEN cool = 0 AND z >= 1.5 THEN 'ENTER_SHORT' ELSE 'NONE' END ELSE ex END,
    CASE WHEN st = 0 THEN 0 ELSE held + 1 END, CASE WHEN st = 0 THEN cool WHEN ex = 'NONE' THEN cool ELSE 2 END
  FROM (SELECT n.symbol_y, n.symbol_x, n.pos, n.z, m.st, m.held, m.cool, CASE WHEN m.st <> 0 AND n.z * m.st <= -2.5 THEN 'EXIT_STOP' WHEN m.st <> 0 AND m.held + 1 >= 10 THEN 'EXIT_TIME' WHEN m.st <> 0 AND n.z * m.st >= -0.5 THEN 'EXIT_MEAN_REVERSION' ELSE 'NONE' END AS ex
    FROM m JOIN z1 n ON n.symbol_y = m.symbol_y AND n.symbol_x = m.symbol_x AND n.pos = m.pos + 1)
) SELECT *, st AS position FROM m"""


@register("F03_trade_states", f"{KEYS} pos:i position:i event holding_period:i cooldown_remaining:i", STATES)
def f03(spark, sf):
    rows = panels.signal_table(spark, sf).withColumn("zscore", F.col("z"))
    return signals.trade_signals(rows.select(*PAIR, "pos", "zscore"), RULES)


#: A scenario per supplier: thresholds out of its keys and balance.
THRESHOLDS = "SELECT s_suppkey AS scenario, CAST(s_suppkey % 7 AS DOUBLE) / 2 AS entry_z, CAST(s_nationkey % 5 AS DOUBLE) / 4 - 0.25 AS exit_z, CAST(floor(abs(s_acctbal) / 1000) AS DOUBLE) / 2 AS stop_z FROM supplier"


def supplier_scenarios(spark, sf):
    half = lambda c: F.floor(c).cast("double") / 2
    rows = panels.table(spark, sf, "supplier")
    return rows.select(F.col("s_suppkey").alias("scenario"), half(F.col("s_suppkey") % 7).alias("entry_z"), ((F.col("s_nationkey") % 5).cast("double") / 4 - 0.25).alias("exit_z"), half(F.abs("s_acctbal") / 1000).alias("stop_z"))


@register("F04_invalid_thresholds", "scenario:i reason", f"SELECT * FROM (SELECT scenario, CASE WHEN exit_z < 0 THEN 'exit_negative' WHEN entry_z <= exit_z THEN 'entry_not_above_exit' WHEN stop_z <= entry_z THEN 'stop_not_above_entry' END AS reason FROM ({THRESHOLDS})) WHERE reason IS NOT NULL")
def f04(spark, sf):
    return signals.invalid_thresholds(supplier_scenarios(spark, sf))


@register("F05_filled_states", f"{KEYS} pos:i position:i event executed_state execution_event execution_decision_row:i execution_due_row:i holding_period:i cooldown_remaining:i")
def f05(spark, sf):
    rows = panels.signal_table(spark, sf).withColumn("zscore", F.col("z")).withColumn("tradable", F.dayofmonth("date") % 4 != 0).withColumn("sized", F.col("pos") % 9 != 0)
    return signals.filled_signals(rows, RULES, 1, True)


@register("E01_lagged_decisions", f"{KEYS} pos:i due_state due_event", f"SELECT *, lag(state, 2) OVER ({W}) AS due_state, coalesce(lag(event, 2) OVER ({W}), 'NONE') AS due_event FROM se")
def e01(spark, sf):
    return positions.lag_decisions(panels.signal_table(spark, sf), 2)


@register("E02_open_loop_fills", f"{KEYS} pos:i executed_state execution_event execution_decision_row:i execution_due_row:i")
def e02(spark, sf):
    rows = panels.signal_table(spark, sf).withColumn("tradable", F.dayofmonth("date") % 4 != 0).withColumn("sized", F.lit(True))
    return signals.open_loop_fills(rows, 1)


@register("E03_available_hedge", f"{KEYS} pos:i hedge_ratio:9", f"SELECT symbol_y, symbol_x, pos, lag(price_y, 1) OVER ({W}) AS hedge_ratio FROM pp")
def e03(spark, sf):
    return positions.available_hedge(brand_panel(spark, sf).withColumn("beta", F.col("price_y")), 1)


@register("E04_pair_units", f"{KEYS} pos:i units_y:6 units_x:6", "SELECT symbol_y, symbol_x, pos, uy AS units_y, ux AS units_x FROM un")
def e04(spark, sf):
    rows = positions.lag_decisions(panels.signal_table(spark, sf), 1)
    y, x = positions.pair_units(F.coalesce("due_state", F.lit("FLAT")), F.col("price_y"), F.col("price_x"), F.col("hedge_ratio"), panels.TARGET)
    return rows.withColumn("units_y", y).withColumn("units_x", x)


@register("E05_marked_schedule", f"{KEYS} pos:i executed_state notional_y:4 notional_x:4 gross_exposure:4 net_exposure:4", "SELECT * FROM mk")
def e05(spark, sf):
    return panels.schedule(spark, sf)


@register("E06_rebalanced", f"{KEYS} pos:i units_y:6 units_x:6 rebalance")
def e06(spark, sf):
    rows = panels.schedule(spark, sf).withColumn("hedge_ratio", F.col("hedge_ratio") * (1 + F.pmod("pos", F.lit(7)) / 20))
    return positions.rebalance(rows, panels.TARGET, 0.1)


@register("E07_forced_closes", f"{KEYS} pos:i execution_event", "SELECT * FROM ps WHERE execution_event = 'FORCED_EXIT'")
def e07(spark, sf):
    return panels.schedule(spark, sf).filter("execution_event = 'FORCED_EXIT'")


@register("E07_closes_inside_positions", f"{KEYS} pos:i executed_state execution_event units_y:6 units_x:6", "SELECT symbol_y, symbol_x, max(pos) AS pos, 'FLAT' AS executed_state, 'FORCED_EXIT' AS execution_event, 0.0 AS units_y, 0.0 AS units_x FROM un WHERE xs <> 'FLAT' AND xe NOT LIKE 'ENTER%' GROUP BY 1, 2")
def e07b(spark, sf):
    """Histories that end inside their last position: every one is closed in its last row."""
    rows = panels.open_schedule(spark, sf)
    inside = (F.col("executed_state") != "FLAT") & ~F.col("execution_event").startswith("ENTER")
    rows = rows.withColumn("end", F.max(F.when(inside, F.col("pos"))).over(Window.partitionBy(*PAIR))).filter("pos <= end")
    return positions.force_close(rows).filter("execution_event = 'FORCED_EXIT'")
