"""Every registered query of the pairs library that has SQL gives the same rows; the others give rows."""

from __future__ import annotations

import pytest

from quantmill import registry
from tests.compare import database, difference

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert not difference(registry.queries()[name](spark, DATA), con.sql(SQL[name]))


#: These read the cleaned market, which needs prices on 95 % of the dates.
DENSE = {n for n in registry.queries().keys() - SQL.keys() if n.split("_")[0] in ("K03", "K05", "K06", "O01", "V08", "V09") or n.split("_")[0] in ("R04", "R05", "R06", "R07", "R11", "R12", "R13", "R14")}
#: No violation, breach or unselected pair need be there.
MAY_BE_EMPTY = {"S08_load_screening", "G01_selected_pairs", "G03_most_selected", "G04_mean_diagnostics", "G05_rejection_counts", "H15_rank_one"}


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - SQL.keys()))
def test_query_runs(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.01" if name in DENSE else DATA).count()
    assert rows > 0 or name in MAY_BE_EMPTY


def test_scenarios_have_figures(spark):
    """On the dense market every valid scenario completes, and what is made of scenarios has figures."""
    q = {n: registry.queries()[n](spark, "/root/testdata/sf0.01") for n in ("K05_coverage", "R12_grid_run", "R06_common_reports", "R11_grid_sensitivity", "R13_grid_table", "V08_multiplicity_counts", "O01_stages")}
    assert q["K05_coverage"].first()["coverage"] == 1.0
    by_status = {r["status"]: r["count"] for r in q["R12_grid_run"].groupBy("status").count().collect()}
    assert by_status == {"COMPLETED": 75, "INVALID": 15} and q["R06_common_reports"].filter("total_return is null").count() == 0
    assert q["R11_grid_sensitivity"].first()["headline"] and q["R13_grid_table"].filter("baseline_difference is not null").count() == 75
    counts = q["V08_multiplicity_counts"].first()
    assert (counts["eligible"], counts["known_p"]) == (75, 75) and {r["status"] for r in q["O01_stages"].collect()} == {"COMPLETED"}


def test_sparse_market_has_no_folds(spark):
    """At this scale no symbol has prices on enough dates: nothing breaks, and what lacks is said."""
    assert registry.queries()["K05_coverage"](spark, DATA).count() <= 1
    record = {r["stage"]: r["status"] for r in registry.queries()["O01_stages"](spark, DATA).collect()}
    assert record["calendar"] == "UNAVAILABLE" and record["report"] == "UNAVAILABLE"


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
