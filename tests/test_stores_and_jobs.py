"""Tables on disk, runs with their records, and digests of large groups."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quantmill.operators import grid, panel, quality, signals
from quantmill.plans import jobs
from quantmill.sources.tables import Table

SCHEMA = "symbol string, day string, price double, loaded int"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def table(tmp_path, part="substring(day, 1, 7)"):
    return Table(str(tmp_path / "table"), SCHEMA, ("symbol", "day"), "loaded", part)


def held(t, spark, **options):
    return sorted(tuple(r) for r in t.read(spark, **options).collect())


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    t = table(tmp_path)
    assert held(t, spark) == [] and t.merge(rows(spark, [])) == []
    assert t.merge(rows(spark, [("A", "2024-01-05", 1.0, 1), ("A", "2024-02-05", 2.0, 1), ("B", "2024-03-01", 3.0, 1)])) == ["2024-01", "2024-02", "2024-03"]
    before = t.current(spark)
    assert t.merge(rows(spark, [("A", "2024-02-05", 9.0, 2), ("C", "2024-02-06", 4.0, 2), ("C", "2024-04-01", 5.0, 2), ("A", "2024-02-05", 8.0, 0)])) == ["2024-02", "2024-04"]
    after = t.current(spark)
    assert {p for p in before if after[p] == before[p]} == {"2024-01", "2024-03"} and after["2024-02"][1] == 2
    assert held(t, spark) == [("A", "2024-01-05", 1.0, 1), ("A", "2024-02-05", 9.0, 2), ("B", "2024-03-01", 3.0, 1), ("C", "2024-02-06", 4.0, 2), ("C", "2024-04-01", 5.0, 2)]
    assert held(t, spark, version=1) == [("A", "2024-01-05", 1.0, 1), ("A", "2024-02-05", 2.0, 1), ("B", "2024-03-01", 3.0, 1)]
    assert t.version(spark) == 2 and held(t, spark, parts=["2024-03"]) == [("B", "2024-03-01", 3.0, 1)]
    assert all("2024-03" in f for f in t.read(spark, ["2024-03"]).inputFiles())


def test_a_load_that_breaks_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = table(tmp_path)
    t.merge(rows(spark, [("A", "2024-01-05", 1.0, 1)]))
    new = rows(spark, [("A", "2024-01-05", 2.0, 2), ("A", "2024-02-05", 2.0, 2)])

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", broken)
        with pytest.raises(OSError):
            t.merge(new)
    assert held(t, spark) == [("A", "2024-01-05", 1.0, 1)] and t.version(spark) == 1
    with pytest.raises(Exception, match="bad row"):  # in the middle of a write
        t.merge(new.withColumn("price", F.when(F.col("day") > "2024-02", F.raise_error(F.lit("bad row")).cast("double")).otherwise(F.col("price"))))
    assert held(t, spark) == [("A", "2024-01-05", 1.0, 1)]
    t.merge(new)
    assert held(t, spark) == [("A", "2024-01-05", 2.0, 2), ("A", "2024-02-05", 2.0, 2)]


def test_merge_equals_a_dictionary(spark, tmp_path):
    """Odd keys: nulls, empty texts, characters that folder names escape; ties of the order go to the later load."""
    rng, t, own = random.Random(3), table(tmp_path, "symbol"), {}
    symbols = [None, "", "a/b", "c:d=e%", "x y", "é", "plain"]
    for load in range(3):
        batch = {}
        for _ in range(12):
            k = rng.choice(symbols), f"2024-01-{rng.randint(1, 4):02d}"
            batch[k] = (*k, rng.random(), rng.randint(0, 2))
        t.merge(rows(spark, list(batch.values())))
        for k, r in batch.items():
            if k not in own or r[3] >= own[k][3]:
                own[k] = r
    assert sorted(map(str, held_rows(t, spark))) == sorted(map(str, own.values()))


def held_rows(t, spark):
    return [tuple(r) for r in t.read(spark).collect()]


def test_digest_of_one_large_group(spark):
    data = [(i % 977, f"v{i % 50_000}") for i in range(60_000)] + [(1, None)]
    frame = spark.createDataFrame(data, "a int, b string").withColumn("g", F.lit("all"))
    counts: dict[str, int] = {}
    for a, b in data:
        d = hashlib.sha256(json.dumps({"a": a, "b": b}, separators=(",", ":")).encode()).hexdigest()
        counts[d] = counts.get(d, 0) + 1
    leaves: dict[str, list] = {}
    for d in sorted(counts):
        leaves.setdefault(d[:4], []).append(f"{d}:{counts[d]}")
    plain = hashlib.sha256(",".join(f"{k}={hashlib.sha256(','.join(v).encode()).hexdigest()}" for k, v in sorted(leaves.items())).encode()).hexdigest()
    digest = lambda f: quality.content_digest(f, ["a", "b"], "g").first()["digest"]
    assert digest(frame) == plain == digest(frame.repartition(7))
    assert len({plain, digest(frame.limit(60_000)), digest(frame.union(frame.limit(1))), digest(frame.withColumn("a", F.when(F.col("b") == "v7", 0).otherwise(F.col("a"))))}) == 4
    assert not quality.content_digest(frame.limit(0), ["a", "b"], "g").collect()


def research_panel(spark, n=150, noise=0.02):
    rng = random.Random(4)
    level, out = 4.0, []
    for i in range(n):
        level += rng.gauss(0, 0.02)
        out.append(("A", "B", i, 2.718281828 ** (level + rng.gauss(0, noise)), 2.718281828**level, True, True))
    return spark.createDataFrame(out, "symbol_y string, symbol_x string, pos long, price_y double, price_x double, observed_y boolean, observed_x boolean")


def test_research_with_grid_and_record(spark, tmp_path):
    rows, store = research_panel(spark), jobs.run_store(str(tmp_path / "runs"))
    folds = panel.folds(spark.createDataFrame([(150,)], "n long"), 80, 20)
    base = {"entry_z": 1.0, "exit_z": 0.25, "stop_z": 3.5, "zscore_lookback": 10, "formation_window": 80, "trading_window": 20}
    scenarios = grid.parameter_grid(spark, {"entry_z": [0.1, 1.0, 1.5]}, base)
    options = {"target": 1000.0, "lookback": 10}
    run = jobs.research(rows, jobs.Request(folds, signals.Rules(1.0, 0.25, 3.5), 50, scenarios=scenarios, dates=150, options=options), store, "2024-01-a")
    record = {r["stage"]: (r["status"], r["rows"]) for r in run["record"].collect()}
    assert {s for s, _ in record.values()} == {"COMPLETED"} and record["grid"] == ("COMPLETED", 3) and record["calendar"][1] == 60
    assert sorted(r["status"] for r in run["grid"].collect()) == ["COMPLETED", "COMPLETED", "INVALID"] and run["validation"].first()["psr"] is not None
    base_return = run["grid"].filter("is_baseline").first()["total_return"]
    assert base_return == pytest.approx(run["report"].first()["total_return"]) and base_return != 0
    other = jobs.research(rows, jobs.Request(folds.limit(0), signals.Rules(1.0, 0.25, 3.5), 50, validate=False, options=options), store, "2024-01-b")
    record = {r["stage"]: (r["status"], r["reason"]) for r in other["record"].collect()}
    assert record["grid"] == ("NOT_REQUESTED", None) and record["validation"] == ("NOT_REQUESTED", None) and record["calendar"] == ("UNAVAILABLE", "no fold fits into the panel")
    assert record["report"] == ("UNAVAILABLE", "calendar is not available") and record["screening"][0] == record["diagnostic"][0] == "COMPLETED" and "calendar" not in other
    assert store.read(spark).filter("run_id = '2024-01-a'").count() == 8 and store.read(spark).count() == 16


def test_a_failed_stage_leaves_the_others(spark):
    folds = spark.createDataFrame([(0, 0, 79, 80, 99), (1, 20, 99, 105, 124)], "fold_id long, formation_start_pos long, formation_end_pos long, trading_start_pos long, trading_end_pos long")
    run = jobs.research(research_panel(spark), jobs.Request(folds, signals.Rules(1.0, 0.25, 3.5), 50, options={"lookback": 10}))
    record = {r["stage"]: (r["status"], r["reason"]) for r in run["record"].collect()}
    assert record["calendar"][0] == "FAILED" and record["screening"][0] == record["diagnostic"][0] == "COMPLETED" and run["diagnostic"].count() == 150
    assert record["coverage"] == ("UNAVAILABLE", "calendar is not available") and record["grid"][0] == "NOT_REQUESTED"
