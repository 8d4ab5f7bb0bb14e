"""Bootstrap, Sharpe inference, fold and regime consistency, and multiplicity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.folds import let
from quantmill.functions.ranks import with_count
from quantmill.operators import metrics
from quantmill.operators.hedge import benjamini_hochberg

#: Replicates that one row of a key makes.
PART = 200


def block_starts(sizes: DataFrame, block: int, replicates: int, seed: int = 0, keys: tuple = ()) -> DataFrame:
    """(keys, replicate, place, pos): the row that stands at each place of each replicate.

    sizes: keys, n.  Starts are hashes of (seed, keys, replicate, block), so they do not depend on partitioning.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), blocks.alias("blocks"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), *keys, "replicate", "block"), (F.col("n") - block + 1).cast("long"))
    rows = rows.withColumn("start", start).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    place = F.col("block") * block + F.col("offset")
    return rows.withColumn("place", place).filter("place < n").select(*keys, "replicate", "place", (F.col("start") + F.col("offset")).alias("pos"))


def moving_block_bootstrap(returns: DataFrame, block: int, replicates: int, seed: int = 0, keys: tuple = ()) -> DataFrame:
    """Replicated return paths (keys, replicate, pos = place, r) of known returns, renumbered from 0."""
    rows = returns.filter("r is not null").withColumn("_at", (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).cast("long"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= block)
    picked = block_starts(sizes, block, replicates, seed, keys).withColumnRenamed("pos", "_at")
    return picked.join(rows.select(*keys, "_at", "r"), [*keys, "_at"]).select(*keys, "replicate", F.col("place").cast("long").alias("pos"), "r")


def bootstrap_metrics(returns: DataFrame, block: int, replicates: int, seed: int = 0, keys: tuple = (), level: float = 0.95, periods: int = 252, least_valid: float = 0.8) -> DataFrame:
    """Interval and median of five figures over replicates: (keys, metric, replicates, defined, low, median, high, kind).

    A key's known returns are one array.  What the figures need of a block of them is a summary that two blocks' give
    that of both: sums, growth, and the highest, the lowest and the deepest fall of its equity.  So each possible block
    is gone through once, and a replicate merges one summary a block, with the starts of moving_block_bootstrap.  Only
    rows of figures are shuffled.  kind: DESIGN for fewer than two returns, replicates, starts or different paths;
    PRIMARY if a figure is defined in all replicates; CONDITIONAL if in ``least_valid`` of them or more; else
    INSUFFICIENT.  An interval comes with PRIMARY and CONDITIONAL only.  A return of -1 leaves total and annualized
    return undefined, one below it the drawdown, too.
    """
    known = returns.filter("r is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("x"))
    known = known.select(*keys, F.transform("x", lambda e: e["r"]).alias("r")).withColumn("n", F.size("r"))
    spread = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: tasks are not merged
    rows = known.filter(F.col("n") >= block).repartition(spread, *keys or ["n"]).withColumn("m", F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    zero, one = F.lit(0.0), F.lit(1.0)
    nothing = F.struct(*[zero.alias(c) for c in ("logs", "sum", "squares", "scale")], one.alias("growth"), one.alias("peak"), one.alias("trough"), zero.alias("low"))

    def joined(a: Column, b: Column) -> Column:
        """The summary of a path and what comes after it; equities begin at 1."""
        added = [(a[c] + b[c]).alias(c) for c in ("logs", "sum", "squares")]
        fall = a["growth"] * b["trough"] / a["peak"] - 1
        return F.struct(
            *added, F.greatest(a["scale"], b["scale"]).alias("scale"), (a["growth"] * b["growth"]).alias("growth"), F.greatest(a["peak"], a["growth"] * b["peak"]).alias("peak"),
            F.least(a["trough"], a["growth"] * b["trough"]).alias("trough"), F.least(a["low"], b["low"], fall).alias("low"),
        )

    def single(x: Column) -> Column:
        d = x - F.col("m")
        return F.struct(F.log1p(x).alias("logs"), d.alias("sum"), (d * d).alias("squares"), F.abs(x).alias("scale"), (1 + x).alias("growth"), F.greatest(one, 1 + x).alias("peak"), F.least(one, 1 + x).alias("trough"), F.least(zero, x).alias("low"))

    def first_of(length: Column) -> Column:
        """Summaries of the ``length`` returns from each start on, put together from runs of 1, 2, 4, ... returns."""
        before = lambda size: length.bitwiseAND(F.lit(~(2 * size - 1)))  # noqa: E731 - returns in the longer runs
        pieces = lambda i: [F.when(length.bitwiseAND(F.lit(size)) != 0, F.get(F.col(f"run{size}"), i + before(size))) for size in reversed(sizes)]
        return F.transform(F.sequence(F.lit(0), F.col("n") - block), lambda i: F.aggregate(F.array_compact(F.array(*pieces(i))), nothing, joined))

    def doubled(size: int):
        return lambda a, i: let(F.get(F.col(f"run{size}"), i + size), lambda b: F.when(b.isNotNull(), joined(a, b)))

    blocks, rest = F.ceil(F.col("n") / block).cast("int"), ((F.col("n") - 1) % block + 1).cast("int")
    sizes = [1 << k for k in range(block.bit_length())]
    rows = rows.withColumn("run1", F.transform("r", single))
    for size in sizes[:-1]:
        rows = rows.withColumn(f"run{2 * size}", F.transform(f"run{size}", doubled(size)))
    rows = rows.withColumn("whole", first_of(F.lit(block))).withColumn("ends", F.when(rest == block, F.col("whole")).otherwise(first_of(rest)))
    rows = rows.withColumn("marks", F.transform(F.sequence(F.lit(1), F.col("n") - block + 1), lambda k: F.xxhash64(F.slice("r", k, block))))
    rows = rows.withColumn("last_marks", F.transform(F.sequence(F.lit(1), F.col("n") - block + 1), lambda k: F.xxhash64(F.slice("r", k, rest)))).drop("r", *[f"run{size}" for size in sizes])
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // PART)))).repartition(spread, *keys, "part")
    start = lambda t, k: F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in keys], t, k), (F.col("n") - block + 1).cast("long")).cast("int")

    def replicate(t: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: start(t, k))
        picked = lambda s: F.aggregate(F.slice(s, 1, blocks - 1), nothing, lambda a, k: joined(a, F.get(F.col("whole"), k)), lambda a: joined(a, F.get(F.col("ends"), F.get(s, blocks - 1))))
        content = lambda s: F.xxhash64(F.transform(F.slice(s, 1, blocks - 1), lambda k: F.get(F.col("marks"), k)), F.get(F.col("last_marks"), F.get(s, blocks - 1)))
        return let(starts, lambda s: F.struct(t.alias("replicate"), content(s).alias("hash"), picked(s).alias("s")))

    own = F.sequence(F.col("part") * PART, F.least((F.col("part") + 1) * PART, F.lit(replicates)) - 1)
    rows = rows.select(*keys, "n", "m", F.inline(F.transform(own, replicate)))
    n, root = F.col("n"), math.sqrt(periods)
    mean, std = F.col("m") + F.col("s.sum") / n, F.when(n > 1, F.sqrt(F.greatest(zero, (F.col("s.squares") - F.col("s.sum") * F.col("s.sum") / n) / (n - 1))))
    each = rows.select(
        *keys, "replicate", "n", "hash", F.expm1("s.logs").alias("total_return"), F.expm1(F.col("s.logs") * periods / n).alias("annualized_return"), (std * root).alias("annualized_volatility"),
        F.when(std > 1e-12 * F.greatest(F.lit(1.0), F.col("s.scale")), mean / std * root).alias("sharpe_ratio"), F.when(F.col("s.trough") >= 0, F.col("s.low")).alias("maximum_drawdown"),
    )
    names = ["total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "maximum_drawdown"]
    long = each.unpivot([F.col(k) for k in (*keys, "replicate", "n", "hash")], names, "metric", "value")
    tail = (1 - level) / 2
    q = F.percentile("value", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    out = long.groupBy(*keys, "metric").agg(F.count("*").alias("replicates"), F.count("value").alias("defined"), q.alias("q"), F.min("hash").alias("a"), F.max("hash").alias("b"), F.first("n").alias("n"))
    bad = (F.col("n") < 2) | (F.col("replicates") < 2) | (F.col("n") - block + 1 < 2) | (F.col("a") == F.col("b"))
    kind = F.when(bad, "DESIGN").when(F.col("defined") == F.col("replicates"), "PRIMARY").when(F.col("defined") >= least_valid * F.col("replicates"), "CONDITIONAL").otherwise("INSUFFICIENT")
    out = out.withColumn("kind", kind)
    shown = lambda i: F.when(F.col("kind").isin("PRIMARY", "CONDITIONAL"), F.col("q")[i])
    return out.select(*keys, "metric", "replicates", "defined", shown(0).alias("low"), shown(1).alias("median"), shown(2).alias("high"), "kind")


def _phi(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for z in batches:
        yield z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function; for tables with a row per pair or scenario."""
    return F.pandas_udf(_phi, "double")(z)


def sharpe_moments(returns: DataFrame, keys: tuple = (), rate: float = 0.0, periods: int = 252) -> DataFrame:
    """n, per-period Sharpe ratio over a risk-free rate, bias-corrected skewness and (ordinary) kurtosis by key.

    Null where a return is unknown, where there are fewer than four, or where returns do not vary.
    """
    r = F.col("r") - F.lit(metrics.per_period(rate, periods))
    out = returns.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), (F.avg(r) / F.when(F.stddev_samp(r) > 1e-12 * F.greatest(F.lit(1.0), F.max(F.abs(r))), F.stddev_samp(r))).alias("sharpe"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"), F.count("r").alias("known"))
    n, able = F.col("n"), (F.col("n") >= 4) & (F.col("known") == F.col("n")) & F.col("sharpe").isNotNull()
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3
    return out.withColumn("skew", F.when(able, skew)).withColumn("kurtosis", F.when(able, kurt)).withColumn("sharpe", F.when(able, F.col("sharpe"))).drop("g1", "g2", "known")


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0, keys: tuple = (), periods: int = 252, rate: float = 0.0) -> DataFrame:
    """z and the probability that the Sharpe ratio exceeds a yearly benchmark, with the one-sided p.

    ``availability`` is UNAVAILABLE where a return is unknown or the moments are not defined.
    """
    base = benchmark / math.sqrt(periods)
    out = sharpe_moments(returns, keys, rate, periods)
    s = F.col("sharpe")
    variance = 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s
    out = out.withColumn("variance", variance).withColumn("z", F.when(F.col("variance") > 0, (s - base) * F.sqrt(F.col("n") - 1) / F.sqrt("variance")))
    out = out.withColumn("psr", normal_cdf(F.col("z")))
    out = out.withColumn("p", normal_cdf(-F.col("z")))  # of z itself: 1 - psr has no digits far out
    return out.withColumn("availability", F.when(F.col("z").isNull(), "UNAVAILABLE").otherwise("AVAILABLE"))


def minimum_track_record(returns: DataFrame, benchmark: float = 0.0, level: float = 0.95, keys: tuple = (), periods: int = 252, rate: float = 0.0) -> DataFrame:
    """Observations needed for the Sharpe ratio to exceed the benchmark at a confidence level; null if it does not."""
    base, z = benchmark / math.sqrt(periods), NormalDist().inv_cdf(level)
    out = sharpe_moments(returns, keys, rate, periods)
    s = F.col("sharpe")
    variance = 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s
    need = F.greatest(F.lit(4.0), F.ceil(1 + variance * F.pow(F.lit(z) / (s - base), F.lit(2.0))).cast("double"))
    return out.withColumn("minimum_track_record", F.when((s > base) & (variance > 0), need).cast("long"))


def fold_metrics(returns: DataFrame, keys: tuple = ("fold_id",), periods: int = 252) -> DataFrame:
    """Metrics per fold with flags for a return of exactly -1 and for one below it; such folds have no metrics."""
    flags = returns.groupBy(*keys).agg(F.count("r").alias("known"), F.coalesce(F.max(F.col("r") == -1), F.lit(False)).alias("catastrophic"), F.coalesce(F.max(F.col("r") < -1), F.lit(False)).alias("invalid"))
    fine = returns.join(flags.filter("not catastrophic and not invalid").select(*keys), list(keys), "left_semi")
    out = flags.join(metrics.core_metrics(fine, keys, periods).drop("observations"), list(keys), "left")
    return out.withColumn("total_return", F.when(F.col("invalid"), None).when(F.col("catastrophic"), -1.0).otherwise(F.col("total_return")))


def fold_consistency(folds: DataFrame, keys: tuple = ()) -> DataFrame:
    """Counts, quartiles, extremes and concentration of positive folds.  folds: keys, fold_id, total_return."""
    r = F.col("total_return")
    order = Window.partitionBy(*keys).orderBy(F.when(r > 0, r).desc_nulls_last(), "fold_id")
    rows = folds.withColumn("_k", F.row_number().over(order)).withColumn("_up", F.count_if(r > 0).over(Window.partitionBy(*keys)))
    up = F.sum(F.when(r > 0, r))
    top = lambda m: F.sum(F.when((r > 0) & (F.col("_k") <= m), r)) / up
    q = F.percentile("total_return", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(F.count("*").alias("folds"), F.count(r).alias("defined"), F.count_if(r > 0).alias("positive"), F.count_if(r < 0).alias("negative"), q.alias("q"), F.max(r).alias("best"), F.min(r).alias("worst"), top(F.lit(1)).alias("top_share"), top(F.ceil(F.col("_up") * 0.2)).alias("top_fifth_share"))
    return out.select(*keys, "folds", "defined", "positive", "negative", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "best", "worst", "top_share", "top_fifth_share")


def regime_consistency(rows: DataFrame, keys: tuple = (), periods: int = 252) -> DataFrame:
    """Metrics by label, its share of the summed returns, and whether it is the worst (the first seen at a tie)."""
    own = (*keys, "label")
    sums = rows.filter("r is not null").groupBy(*own).agg(F.sum("r").alias("contribution"), F.min("pos").alias("first_pos"))
    out = metrics.core_metrics(rows, own, periods).join(sums, list(own))
    whole = Window.partitionBy(*keys)
    share = F.try_divide(F.col("contribution"), F.sum(F.abs("contribution")).over(whole))
    return out.withColumn("share", share).withColumn("worst", F.row_number().over(whole.orderBy("total_return", "first_pos")) == 1)


def multiplicity(tests: DataFrame, family: int | None = None, level: float = 0.05, keys: tuple = (), order: tuple = ("scenario_id",)) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over a family that may be larger than the number of known p.

    A hypothesis whose p is unknown counts in the family; its adjusted p and its discoveries are unknown too.
    """
    size = F.lit(family).cast("double") if family else F.col("_n").cast("double")
    tests = tests if family else with_count(tests, keys, "_n")
    out = tests.withColumn("family", size).drop("_n").withColumn("bonferroni_p", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.col("p") * F.col("family"))))
    out = benjamini_hochberg(out, "p", keys, order, "bh_p", "family")
    return out.withColumn("bonferroni_discovery", F.col("bonferroni_p") <= level).withColumn("bh_discovery", F.col("bh_p") <= level)


def multiplicity_counts(tests: DataFrame, level: float = 0.05, keys: tuple = ()) -> DataFrame:
    """What a family of hypotheses has come to.  tests: a row each of multiplicity(), with its scenario's ``status``.

    Hypotheses that are not eligible (INVALID or FAILED) are counted by status alone.
    """
    able = ~F.col("status").isin("INVALID", "FAILED")
    return tests.groupBy(*keys).agg(
        F.count("*").alias("configurations"), F.count_if(F.col("status") == "INVALID").alias("invalid"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(able).alias("eligible"),
        F.count_if(able & F.col("p").isNotNull()).alias("known_p"), F.count_if(able & F.col("p").isNull()).alias("unavailable"), F.count_if(F.col("p") <= level).alias("raw_exceedances"),
        F.count_if(F.col("bonferroni_p") <= level).alias("bonferroni_exceedances"), F.count_if(F.col("bh_p") <= level).alias("bh_discoveries"),
    )


def roll_up(parts: DataFrame, keys: tuple = ()) -> DataFrame:
    """The worst availability of a report's parts: UNAVAILABLE over INSUFFICIENT over AVAILABLE."""
    code = F.when(F.col("availability") == "UNAVAILABLE", 2).when(F.col("availability") == "INSUFFICIENT", 1).otherwise(0)
    worst = F.max(code)
    return parts.groupBy(*keys).agg(F.when(worst == 2, "UNAVAILABLE").when(worst == 1, "INSUFFICIENT").otherwise("AVAILABLE").alias("availability"))
