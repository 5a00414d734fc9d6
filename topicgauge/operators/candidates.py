"""Conditional rows: a fixed list of rules, each giving at most one row per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITIES = ("high", "medium", "low")


def priority(order: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PRIORITIES)), order)



def ranked_rows(
    reports: DataFrame, keys: Sequence[str], rules: Sequence[tuple[Column, Column]], limit: int, position: str
) -> DataFrame:
    """Rows of the rules that hold, in struct order, at most ``limit`` per report.

    The candidates live in one array on the report row, so ordering and limiting them
    needs neither a window nor a shuffle.
    """
    candidates = F.array_compact(F.array(*[F.when(cond, row) for cond, row in rules]))
    ordered = F.slice(F.sort_array(candidates), 1, limit)
    rows = reports.select(*keys, F.posexplode_outer(ordered).alias(position, "_r"))
    return rows.filter(F.col(position).isNotNull()).select(
        *keys, (F.col(position) + 1).alias(position), "_r.*"
    )
