"""Folds along the ordered rows of a key, in time that grows with their number.

What a fold gives is gathered in runs: appending to an array copies it, so a run's array is kept short, and only arrays
of runs are appended to the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a run.
RUN = 128


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gathered(rows: Column, start: Column, step, kind: str, run: int = RUN) -> Column:
    """Array of what ``step`` gives along ``rows``, nulls left out.

    ``step(state, row)`` is a struct of the next ``state`` and ``made``, of type ``kind`` or null.
    """
    none = F.array().cast(f"array<{kind}>")
    more = lambda out, x: F.when(x["made"].isNull(), out).otherwise(F.array_append(out, x["made"]))
    one = lambda s, r: let(step(s["state"], r), lambda x: F.struct(x["state"].alias("state"), more(s["out"], x).alias("out")))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(rows) / run).cast("int") - 1, F.lit(0))), lambda k: F.slice(rows, k * run + 1, F.lit(run)))
    along = lambda s, part: let(F.aggregate(part, F.struct(s["state"].alias("state"), none.alias("out")), one), lambda x: F.struct(x["state"].alias("state"), F.array_append(s["out"], x["out"]).alias("out")))
    whole = F.aggregate(runs, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), along)
    return F.flatten(whole["out"])
