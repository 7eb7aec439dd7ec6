"""Values that are named several times and computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it may name often; written out, the value would be computed at each place."""
    return F.transform(F.array(value), body)[0]


def with_computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions: each is computed once a row.

    Spark moves a filter below the projection that makes its columns and writes
    their expressions into it, once for each place where it names them. A table
    function of one row keeps them where they are; it needs no shuffle.
    """
    made = rows.withColumns({f"_made_{k}": c for k, c in columns.items()})
    kept = [c for c in rows.columns if c not in columns]
    return made.select(*kept, F.inline(F.array(F.struct(*(F.col(f"_made_{k}").alias(k) for k in columns)))))
