"""Hedge ratios, spreads, their diagnostics, and pair screening.

Everything but the small linear algebra of unit-root tests is window and group expressions: those tests gather Gram
sums of all rows per pair in Spark and finish on one row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.ranks import least_from_here, numbered, with_count
from quantmill.functions.windows import by, prior

PAIR = ("symbol_y", "symbol_x")
HURST_LAGS = range(2, 21)

# MacKinnon (1994) p-value surfaces with a constant, for 1 and 2 series, and (2010) critical values.
SMALL_P = {1: (2.1659, 1.4412, 0.038269), 2: (2.92, 1.5012, 0.039796)}
LARGE_P = {1: (1.7339, 0.93202, -0.12745, -0.010368), 2: (2.1945, 0.64695, -0.29198, -0.042377)}
TAU_STAR, TAU_MIN, TAU_MAX = {1: -1.61, 2: -2.62}, {1: -18.83, 2: -18.86}, {1: 2.74, 2: 0.92}
CRITICAL = {
    1: ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    2: ((-3.89644, -10.9519, -33.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.720, 0.0)),
}


def ols(panel: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """alpha, beta of log y on log x by key; keys with fewer than 3 rows or a constant log x give none."""
    y, x = F.ln("price_y"), F.ln("price_x")
    fit = panel.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"))
    return fit.filter((F.col("n") >= 3) & F.col("beta").isNotNull())


def ols_spread(panel: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """``panel`` with alpha, beta and spread = log y - alpha - beta log x."""
    fitted = panel.join(ols(panel, keys).drop("n"), list(keys))
    return fitted.withColumn("spread", F.ln("price_y") - F.col("alpha") - F.col("beta") * F.ln("price_x"))


def rolling_ols(panel: DataFrame, lookback: int = 120, keys: tuple = PAIR) -> DataFrame:
    """As ols_spread, with parameters of the ``lookback`` rows before each row; null in warm-up or if log x stands still."""
    w = prior(keys, lookback)
    y, x = F.ln("price_y"), F.ln("price_x")
    full = F.count(F.lit(1)).over(w) == lookback
    variance = F.var_samp(x).over(w)
    panel = panel.withColumn("beta", F.when(full & (variance > 0), F.covar_samp(y, x).over(w) / variance))
    panel = panel.withColumn("alpha", F.avg(y).over(w) - F.col("beta") * F.avg(x).over(w))
    return panel.withColumn("spread", y - F.col("alpha") - F.col("beta") * x)


KALMAN = ("alpha", "beta", "spread", "innovation", "innovation_variance")


def kalman(panel: DataFrame, transition: float = 1e-5, observation: float = 1e-3, initial: float = 1.0, keys: tuple = PAIR) -> DataFrame:
    """Dynamic alpha and beta by a Kalman filter with a random-walk state; a row uses rows up to itself.

    Rows are sorted within the partitions that hold their keys and stream through: from one batch to the next a key
    hands on its state (alpha, beta and the three different entries of their covariance), so a history of any length
    takes time in proportion and a batch's memory.
    """
    n, names = len(keys), (*keys, "pos", *KALMAN)
    start = (0.0, 1.0, initial, 0.0, initial)

    def filter_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, noise = None, start, 0.0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if key != row[:n]:
                    key, state, noise = row[:n], start, 0.0
                y, x = row[n + 1 :]
                alpha, beta, p, q, r = state
                p, r, noise = p + noise, r + noise, transition
                a, b = p + q * x, q + r * x  # covariance of the state with what is observed
                error, variance = y - alpha - beta * x, a + b * x + observation
                k, m = a / variance, b / variance
                alpha, beta = alpha + k * error, beta + m * error
                # Joseph's form, (I - K h) P (I - K h)' + K K' observation, written out for h = (1, x): it keeps P symmetric
                u, v = (1 - k) * p - k * x * q, (1 - k) * q - k * x * r
                t, w = (1 - m * x) * q - m * p, (1 - m * x) * r - m * q
                state = alpha, beta, u * (1 - k) - v * k * x + observation * k * k, (v * (1 - m * x) - u * m + t * (1 - k) - w * k * x) / 2 + observation * k * m, w * (1 - m * x) - t * m + observation * m * m
                out.append((*key, row[n], alpha, beta, y - alpha - beta * x, error, variance))
            yield pd.DataFrame(out, columns=names)

    kinds = dict(panel.dtypes)
    rows = panel.select(*keys, F.col("pos").cast("long").alias("pos"), F.ln("price_y").alias("y"), F.ln("price_x").alias("x")).repartition(*keys).sortWithinPartitions(*keys, "pos")
    return rows.mapInPandas(filter_rows, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pos long", *(f"{c} double" for c in KALMAN)]))


def half_life(spreads: DataFrame, keys: tuple = PAIR, minimum: int = 30) -> DataFrame:
    """half_life by key from the slope of the change on the level before: infinite unless it reverts."""
    before = F.lag("spread").over(by(keys))
    rows = spreads.withColumn("_before", before).withColumn("_change", F.col("spread") - before)
    fit = rows.groupBy(*keys).agg(F.count("spread").alias("n"), F.regr_slope("_change", "_before").alias("slope"))
    root = F.abs(1 + F.col("slope"))
    infinite = (root >= 1) | (F.abs(root - 1) <= 2e-12)
    value = F.when(infinite, F.lit(float("inf"))).otherwise(-F.lit(math.log(2)) / F.col("slope"))
    return fit.filter(F.col("n") >= minimum).select(*keys, F.when(F.col("slope").isNotNull(), value).alias("half_life"))


def hurst(spreads: DataFrame, keys: tuple = PAIR, lags: range = HURST_LAGS) -> DataFrame:
    """hurst by key: slope of log std(change over lag) on log lag; null where a dispersion is not positive."""
    w = by(keys)
    rows = spreads.select(*keys, *[(F.col("spread") - F.lag("spread", k).over(w)).alias(f"d{k}") for k in lags])
    wide = rows.groupBy(*keys).agg(*[F.stddev_samp(f"d{k}").alias(f"d{k}") for k in lags])
    long = wide.unpivot(list(keys), [f"d{k}" for k in lags], "lag", "dispersion").withColumn("lag", F.substring("lag", 2, 9).cast("double"))
    fit = long.groupBy(*keys).agg(F.min("dispersion").alias("least"), F.count("dispersion").alias("n"), F.regr_slope(F.ln("dispersion"), F.ln("lag")).alias("hurst"))
    return fit.select(*keys, F.when((F.col("least") > 0) & (F.col("n") == len(lags)), F.col("hurst")).alias("hurst"))


def spread_validity(spreads: DataFrame, keys: tuple = PAIR, minimum: int = 50) -> DataFrame:
    """Why a spread cannot be tested: too_few, non_finite or degenerate; null if it can."""
    infinite = F.isnan("spread") | (F.abs("spread") == float("inf"))
    out = spreads.groupBy(*keys).agg(F.count("spread").alias("n"), F.max(infinite).alias("odd"), (F.max("spread") - F.min("spread")).alias("range"), F.max(F.abs("spread")).alias("scale"))
    reason = F.when(F.col("n") < minimum, "too_few").when(F.col("odd"), "non_finite").when(F.col("range") <= 1e-12 * F.greatest("scale", F.lit(1.0)), "degenerate")
    return out.select(*keys, "n", reason.alias("reason"))


def eligibility(panel: DataFrame, keys: tuple = PAIR, minimum: int = 100, *more: Column) -> DataFrame:
    """The first reason, in a fixed order, why a pair is not tested; null if it is.  ``more``: further aggregates."""
    positive = (F.col("price_y") > 0) & (F.col("price_x") > 0)
    finite = ~F.isnan("price_y") & ~F.isnan("price_x") & (F.abs("price_y") < float("inf")) & (F.abs("price_x") < float("inf"))
    out = panel.groupBy(*keys).agg(F.count("*").alias("observations"), F.min(finite).alias("f"), F.min(positive).alias("p"), F.min("price_y").alias("a"), F.max("price_y").alias("b"), F.min("price_x").alias("c"), F.max("price_x").alias("d"), *more)
    reason = F.when(F.col("observations") < minimum, "insufficient_observations").when(~F.col("f"), "non_finite_prices").when(~F.col("p"), "non_positive_prices").when((F.col("a") == F.col("b")) | (F.col("c") == F.col("d")), "degenerate_prices")
    return out.withColumn("reason", reason).drop("f", "p", "a", "b", "c", "d")


def benjamini_hochberg(tests: DataFrame, p: str = "p", keys: tuple = (), order: tuple = (), out: str = "corrected_p", family: str | None = None) -> DataFrame:
    """Adjusted p within ``keys``, clipped to [0, 1]; ``family`` names a column with a family size above the count.

    Without keys the table is ranked by ranges of p, so no task gets all of it.
    """
    rows, size = (tests, F.col(family)) if family else (with_count(tests, keys, "_family", F.col(p)), F.col("_family"))
    ascending = [F.col(p).asc_nulls_last(), *[F.col(c) for c in order]]
    scaled = F.col(p) * size / F.col("_rank")
    if keys:
        whole = Window.partitionBy(*keys)
        rows = rows.withColumn("_rank", F.row_number().over(whole.orderBy(*ascending)))
        rows = rows.withColumn("_lowest", F.min(scaled).over(whole.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = least_from_here(numbered(rows, ascending), scaled, "_rank", "_lowest")
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_lowest"))))).drop("_rank", "_lowest", "_part", "_family")


def mackinnon_p(tau: float, series: int) -> float:
    """The approximate p-value of a unit-root statistic."""
    if tau > TAU_MAX[series]:
        return 1.0
    if tau < TAU_MIN[series]:
        return 0.0
    surface = SMALL_P[series] if tau <= TAU_STAR[series] else LARGE_P[series]
    return 0.5 * math.erfc(-sum(c * tau**k for k, c in enumerate(surface)) / math.sqrt(2))


def critical_values(series: int, n: int) -> list[float]:
    return [sum(c / n**k for k, c in enumerate(row)) for row in CRITICAL[series]]


def max_lag(n: int, constant: bool) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - int(constant) - 1))


def _fit(gram: np.ndarray, moments: np.ndarray, yy: float, n: int) -> tuple[float, float]:
    """(t ratio of the first regressor, residual sum of squares) from sums of products."""
    coefficients = np.linalg.solve(gram, moments)
    rss = max(float(yy - coefficients @ moments), 0.0)
    variance = rss / (n - len(moments))
    return float(coefficients[0] / math.sqrt(variance * np.linalg.inv(gram)[0, 0])), rss


#: Rows of a series that are summed up together.
BLOCK = 2048


def series_sums(spreads: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """(keys, n, lags, changes, sum, squares, s, first, early): sums of products along each key's spreads, a row a block.

    A row's values are its change, the level before, 1 and the changes before it, as many as the lag rule gives for the
    key's length (or the Hurst lags need); s adds up their products.  The values of the key's first rows ride along
    (``first``, numbered by ``early``), so that sums over rows k.. are those over all less those of the first few.
    A block takes the rows just before it along, which is all that it needs of its neighbour.
    """
    w, kinds = by(keys), {f.name: f.dataType.simpleString() for f in spreads.schema}
    rows = spreads.filter("spread is not null").select(*keys, "spread", (F.row_number().over(w) - 1).cast("long").alias("at"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    lags = F.greatest(F.lit(max(HURST_LAGS) - 1), F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 1)).cast("int")
    block = F.floor(F.col("at") / BLOCK)
    rows = rows.withColumn("lags", lags).withColumn("block", F.explode(F.sequence(block, F.floor((F.col("at") + F.col("lags") + 1) / BLOCK))))
    rows = rows.filter(F.col("block") * BLOCK < F.col("n")).groupBy(*keys, "n", "lags", "block").agg(F.sort_array(F.collect_list(F.struct("at", "spread"))).alias("x"))
    rows = rows.select(*keys, "n", "lags", "block", F.transform("x", lambda e: e["at"]).alias("at"), F.transform("x", lambda e: e["spread"]).alias("spread"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, lags, block, at, s = row[len(keys) :]
                change, own = np.diff(s), np.nonzero(at[1:] >= block * BLOCK)[0]
                v = np.zeros((len(own), lags + 3))
                v[:, 0], v[:, 1], v[:, 2] = change[own], s[own], 1.0
                for k in range(1, lags + 1):
                    there = own >= k
                    v[there, 2 + k] = change[own[there] - k]
                number, level = at[own + 1], s[at >= block * BLOCK]
                early = number <= lags + 1
                out.append((*row[: len(keys)], n, lags, len(own), level.sum(), level @ level, (v.T @ v).ravel(), v[early].ravel(), number[early]))
            yield pd.DataFrame(out, columns=[*keys, "n", "lags", "changes", "sum", "squares", "s", "first", "early"])

    head = "".join(f"{k} {kinds[k]}, " for k in keys)
    return rows.mapInPandas(sums, f"{head}n long, lags int, changes long, sum double, squares double, s array<double>, first array<double>, early array<long>")


def _finished(sums: DataFrame, keys: tuple, figures, schema: str) -> DataFrame:
    """``figures(total, first, early, part)`` of each key's sums, as columns of ``schema``; what is gathered is a few sums a block."""
    kinds = dict(sums.dtypes)

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        size = int(parts["lags"].iloc[0]) + 3
        total = np.sum(np.stack(parts["s"].to_numpy()), axis=0).reshape(size, size)
        first, early = np.concatenate(parts["first"].to_list()).reshape(-1, size), np.concatenate(parts["early"].to_list())
        return pd.DataFrame([{**{k: parts[k].iloc[0] for k in keys}, **figures(total, first, early, parts)}])

    return sums.groupBy(*keys).applyInPandas(finish, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def unit_root(spreads: DataFrame, keys: tuple = PAIR, constant: bool = True, series: int = 1, minimum: int = 50) -> DataFrame:
    """Augmented Dickey-Fuller test by key, the lag chosen by AIC on the rows that all lags share.

    Regressors of a row: level before, a constant if asked, lagged changes; all from series_sums().
    """
    figures = lambda total, first, early, part: decide(total, first, early, int(part["changes"].sum()), constant, series, minimum, int(part["lags"].iloc[0]))
    return _finished(series_sums(spreads, keys), keys, figures, ROOT)


def reversion(total: np.ndarray, first: np.ndarray, early: np.ndarray, changes: int) -> tuple[float | None, float | None]:
    """(half-life, Hurst exponent) from sums of products."""
    n, (xy, y, x, xx) = changes, (total[0, 1], total[0, 2], total[1, 2], total[1, 1])
    variance, half, exponent = xx - x * x / n, None, None
    if n + 1 >= 30 and variance > 0:
        slope = (xy - x * y / n) / variance
        root = abs(1 + slope)
        half = math.inf if root >= 1 or abs(root - 1) <= 2e-12 else -math.log(2) / slope
    spread = []
    for k in HURST_LAGS:
        lost, m = first[early < k], n - k + 1
        of = [0, *range(3, 2 + k)]  # the last k changes, whose sum is the change over k rows
        added = lost[:, of].sum(axis=1)
        squares, mean = total[np.ix_(of, of)].sum() - (added**2).sum(), (total[of, 2].sum() - added.sum()) / max(m, 1)
        spread.append(math.sqrt(max(squares - m * mean * mean, 0) / (m - 1)) if m > 1 else 0.0)
    if min(spread) > 0:
        exponent = float(np.polyfit(np.log(list(HURST_LAGS)), np.log(spread), 1)[0])
    return half, exponent


ROOT = "statistic double, p_value double, lags long, observations long, critical_1 double, critical_5 double, critical_10 double"


def decide(total: np.ndarray, first: np.ndarray, at: np.ndarray, changes: int, constant: bool, series: int, minimum: int, longest: int) -> dict:
    """Result of a unit-root test from sums of products over all rows and the early rows, which are numbered by ``at``."""
    n = changes + 1
    if n < minimum:
        return dict.fromkeys(x.split()[0] for x in ROOT.split(", "))
    most = min(max_lag(n, constant), longest)

    def fit(k: int, skip: int) -> tuple[float, float, int]:
        lost = first[at <= skip]
        products = total - lost.T @ lost
        use = [1, *([2] if constant else []), *range(3, 3 + k)]
        rows_left = changes - skip
        return *_fit(products[np.ix_(use, use)], products[use, 0], products[0, 0], rows_left), rows_left

    def aic(k: int) -> float:
        _, rss, m = fit(k, most)
        return m * (math.log(2 * math.pi) + math.log(rss / m) + 1) + 2 * (1 + int(constant) + k)

    best = min(range(most + 1), key=aic)
    statistic, _, used = fit(best, best)
    levels = critical_values(series, used if series == 1 else n - 1)
    return {"statistic": statistic, "p_value": mackinnon_p(statistic, series), "lags": best, "observations": used, "critical_1": levels[0], "critical_5": levels[1], "critical_10": levels[2]}


def _lagged(s: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of products, early rows and their numbers for a whole series."""
    change = np.diff(s)
    v = np.zeros((len(change), longest + 3))
    v[:, 0], v[:, 1], v[:, 2] = change, s[:-1], 1.0
    for k in range(1, min(longest, len(change) - 1) + 1):
        v[k:, 2 + k] = change[:-k]
    at = np.arange(1, len(change) + 1)
    early = at <= longest + 1
    return v.T @ v, v[early], at[early]


def window_figures(y: np.ndarray, x: np.ndarray, minimum: int = 50, lags: range = HURST_LAGS) -> tuple:
    """alpha, beta, spread's deviation, cointegration and unit-root statistics with p, half-life and Hurst exponent of one window."""
    with np.errstate(all="ignore"):
        variance = ((x - x.mean()) ** 2).sum()
        beta = ((x - x.mean()) * (y - y.mean())).sum() / variance
        alpha = y.mean() - beta * x.mean()
        s = y - alpha - beta * x
        n, longest = len(s), max_lag(len(s), False)
        out: list = [alpha, beta, s.std(ddof=1)]
        for constant, series in ((False, 2), (True, 1)):
            try:
                found = decide(*_lagged(s, longest), n - 1, constant, series, minimum, longest)
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                found = {"statistic": None, "p_value": None}
            out += [found["statistic"], found["p_value"]]
        before, change = s[:-1] - s[:-1].mean(), np.diff(s)
        slope = (before * (change - change.mean())).sum() / (before**2).sum()
        root = abs(1 + slope)
        half = math.inf if root >= 1 or abs(root - 1) <= 2e-12 else -math.log(2) / slope
        dispersion = np.array([(s[k:] - s[:-k]).std(ddof=1) if n - k > 1 else np.nan for k in lags])
        hurst_value = np.polyfit(np.log(list(lags)), np.log(dispersion), 1)[0] if (dispersion > 0).all() else None
    return *out, half if n >= 30 and np.isfinite(slope) else None, hurst_value


FIGURES = "alpha double, beta double, spread_standard_deviation double, cointegration_statistic double, p_value double, adf_statistic double, adf_p_value double, half_life double, hurst double"


def _window_figures(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for ys, xs in batches:
        yield pd.DataFrame([window_figures(np.asarray(y, float), np.asarray(x, float)) for y, x in zip(ys, xs, strict=True)], columns=[x.split()[0] for x in FIGURES.split(", ")], dtype=float)


def screen_windows(panel: DataFrame, extra: tuple = (), minimum: int = 100, fdr: float = 0.05, longest: float = 60.0, hurst_limit: float = 0.5) -> DataFrame:
    """As screen(), for windows of bounded length (as folds): a pair's window is one array, shuffled once and tested as a whole."""
    keys = (*extra, *PAIR)
    able = eligibility(panel, keys, minimum, F.sort_array(F.collect_list(F.struct("pos", F.ln("price_y").alias("y"), F.ln("price_x").alias("x")))).alias("w"))
    rows = able.filter("reason is null").withColumn("f", F.pandas_udf(_window_figures, FIGURES)(F.transform("w", lambda p: p["y"]), F.transform("w", lambda p: p["x"])))
    rows = rows.select(*keys, "observations", "f.*")
    for c in (x.split()[0] for x in FIGURES.split(", ")):
        rows = rows.withColumn(c, F.when(~F.isnan(c), F.col(c)))  # what pandas has for unknown
    ranked = select_and_rank(rows.withColumn("p_value", F.coalesce("p_value", F.lit(1.0))), extra, fdr, longest, hurst_limit)
    failed = able.filter("reason is not null").select(*keys, "observations", F.array("reason").alias("rejection_reasons"), F.lit(False).alias("selected"))
    return ranked.unionByName(failed, allowMissingColumns=True)


def adf(spreads: DataFrame, keys: tuple = PAIR, minimum: int = 50) -> DataFrame:
    return unit_root(spreads, keys, constant=True, series=1, minimum=minimum)


def cointegration(panel: DataFrame, keys: tuple = PAIR, minimum: int = 50) -> DataFrame:
    """Engle-Granger: the unit-root test without a constant on the residuals of log y on log x."""
    return unit_root(ols_spread(panel, keys), keys, constant=False, series=2, minimum=minimum)


def screening_reasons(beta: Column, corrected: Column, half: Column, hurst_value: Column, fdr: float, longest: float, hurst_limit: float) -> Column:
    """Array of the reasons, in a fixed order, that speak against a pair."""
    odd = lambda c: c.isNull() | F.isnan(c) | (c == float("inf")) | (c <= 0)
    return F.array_compact(F.array(
        F.when(corrected > fdr, "corrected_cointegration_pvalue_above_threshold"),
        F.when(odd(beta), "beta_not_finite_positive"),
        F.when(odd(half), "half_life_not_finite_positive").when(half > longest, "half_life_above_maximum"),
        F.when(hurst_value.isNull() | F.isnan(hurst_value) | (hurst_value >= hurst_limit), "hurst_not_below_threshold"),
    ))


def select_and_rank(tested: DataFrame, keys: tuple = (), fdr: float = 0.05, longest: float = 60.0, hurst_limit: float = 0.5, family: str | None = None) -> DataFrame:
    """Adjusts p, lists reasons, and ranks the pairs without any by (corrected p, half-life, y, x) within ``keys``."""
    out = benjamini_hochberg(tested, "p_value", keys, PAIR, "corrected_p", family)
    out = out.withColumn("rejection_reasons", screening_reasons(F.col("beta"), F.col("corrected_p"), F.col("half_life"), F.col("hurst"), fdr, longest, hurst_limit))
    out = out.withColumn("selected", F.size("rejection_reasons") == 0)
    order = ["corrected_p", "half_life", *PAIR]
    if keys:
        return out.withColumn("rank", F.when(F.col("selected"), F.row_number().over(Window.partitionBy(*keys, "selected").orderBy(*order))))
    first = numbered(out, [F.desc("selected"), *map(F.col, order)], "rank").drop("_part")  # those without reasons come first
    return first.withColumn("rank", F.when(F.col("selected"), F.col("rank").cast("int")))


SCREENED = ("spread_standard_deviation", "cointegration_statistic", "p_value", "adf_statistic", "adf_p_value", "half_life", "hurst")


def screen(panel: DataFrame, extra: tuple = (), minimum: int = 100, fdr: float = 0.05, longest: float = 60.0, hurst_limit: float = 0.5) -> DataFrame:
    """All pairs (per ``extra`` keys, as folds): eligibility first, then tests of the eligible, correction and ranks.

    The family is fixed by eligibility alone; a test that fails counts as p = 1.  Pairs that are not eligible come with
    their reason and no statistics.  One pass over the spreads gives the sums that both tests, half-life and Hurst
    exponent are made of.
    """
    keys = (*extra, *PAIR)
    y, x = F.ln("price_y"), F.ln("price_x")
    able = eligibility(panel, keys, minimum, F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"))
    fit = able.filter("reason is null").drop("reason")
    spreads = panel.join(fit.select(*keys, "alpha", "beta"), list(keys)).withColumn("spread", y - F.col("alpha") - F.col("beta") * x)

    def figures(total: np.ndarray, first: np.ndarray, early: np.ndarray, part: pd.DataFrame) -> dict:
        n, changes, lags = int(part["n"].iloc[0]), int(part["changes"].sum()), int(part["lags"].iloc[0])
        added = part["sum"].sum()
        deviation = math.sqrt(max(part["squares"].sum() - added * added / n, 0) / (n - 1)) if n > 1 else None
        tests = []
        for constant, series in ((False, 2), (True, 1)):
            try:
                found = decide(total, first, early, changes, constant, series, 50, lags)
                tests += [found["statistic"], found["p_value"]]
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                tests += [None, None]
        return dict(zip(SCREENED, (deviation, *tests, *reversion(total, first, early, changes)), strict=True))

    tested = _finished(series_sums(spreads, keys), keys, figures, ", ".join(f"{c} double" for c in SCREENED))
    for c in SCREENED:
        tested = tested.withColumn(c, F.when(~F.isnan(c), F.col(c)))  # what pandas has for unknown
    rows = fit.join(tested, list(keys), "left")
    ranked = select_and_rank(rows.withColumn("p_value", F.coalesce("p_value", F.lit(1.0))), extra, fdr, longest, hurst_limit)
    failed = able.filter("reason is not null").select(*keys, "observations", F.array("reason").alias("rejection_reasons"), F.lit(False).alias("selected"))
    return ranked.unionByName(failed, allowMissingColumns=True)
