"""Stage boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed right here, once per row.

    The optimizer moves a filter below the projection that computes its column by copying the
    expression, and a copy of the whole text work per filter is far dearer than the rows it saves
    (through several projections the copies multiply). Nothing is moved below a generator's own
    output, so these columns come out of a generator that yields one row.
    """
    kept = [name for name in rows.columns if name not in columns]
    one = F.array(F.struct(*(column.alias(name) for name, column in columns.items())))
    return rows.select(*kept, F.inline(one))
