"""Ranks inside a report, i.e. inside one ``(query_id, doc_id)`` group.

Chunks cut from a document row form a group no larger than that row, so a plain window is
right for them. A pre-chunked or vector table has no such bound: one document may hold a
third of all rows. The caller says which kind it is, and pre-chunked reports are ranked in
cells of similarity, where no task sees more than one cell; the result is the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORT = ("query_id", "doc_id")
#: Similarity cells of a hot report, and the rows that tied chunks may share a cell with.
_CELLS = 1 << 15
_BLOCK_ROWS = 1 << 16


def row_number_in_cells(
    rows: DataFrame,
    group: Sequence[str],
    coarse: Mapping[str, Column],
    fine: Mapping[str, Column],
    order: str,
    out: str,
) -> DataFrame:
    """``row_number() over (partition by group order by coarse, fine, order)`` without a whole group in a task.

    Rows are numbered inside their ``(coarse, fine)`` cell. Cell counts, aggregated before
    the shuffle, give each cell its offset: a running sum over the fine cells of a coarse
    cell, plus one over the coarse cells of a group.
    """
    keys = list(group)
    wide, cell = [*keys, *coarse], [*keys, *coarse, *fine]
    before = (Window.unboundedPreceding, -1)
    keyed = rows.withColumns({**coarse, **fine})
    counts = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*wide).orderBy(*fine).rowsBetween(*before)
    across = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(*before)
    bases = (
        counts.groupBy(*wide)
        .agg(F.sum("_n").alias("_t"))
        .select(*wide, F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base"))
    )
    offsets = counts.select(*cell, F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_off")).join(bases, wide)
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(order))
    return (
        keyed.withColumn("_local", local)
        .join(offsets, cell)
        .withColumn(out, (F.col("_local") + F.col("_off") + F.col("_base")).cast("int"))
        .drop("_local", "_off", "_base", *coarse, *fine)
    )


def position_in_group(rows: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """0-based position by a whole-number column, for a group of any size."""
    block = {"_block": F.floor(F.col(order) / _BLOCK_ROWS)}
    numbered = row_number_in_cells(rows, [group], block, {"_one": F.lit(0)}, order, out)
    return numbered.withColumn(out, F.col(out) - 1)


def _order(descending: bool) -> list[Column]:
    s = F.col("similarity")
    return [s.desc() if descending else s.asc(), F.col("chunk_index").asc()]


def rank_chunks(
    scored: DataFrame, pre_chunked: bool = False, descending: bool = True, out: str = "similarity_rank"
) -> DataFrame:
    """Add the rank (ties by chunk index) and the report's size, minimum and maximum.

    ``pre_chunked`` is for tables of chunks that no document row bounds; they are read several
    times, so store what is costly to compute.
    """
    return _rank_in_cells(scored, descending, out) if pre_chunked else _rank_by_window(scored, descending, out)


def _rank_by_window(scored: DataFrame, descending: bool, out: str) -> DataFrame:
    whole = Window.partitionBy(*REPORT)
    s = F.col("similarity")
    extent = {"report_chunks": F.count("*"), "report_min": F.min(s), "report_max": F.max(s)}
    ranked = scored.withColumn(out, F.row_number().over(whole.orderBy(*_order(descending))))
    return ranked.withColumns({k: a.over(whole) for k, a in extent.items()})


def _rank_in_cells(scored: DataFrame, descending: bool, out: str) -> DataFrame:
    """Cells are counted before the shuffle, so a report's offsets come from at most 2 * _CELLS rows.

    Inside a cell a window numbers the rows. A cell that holds more than ``_BLOCK_ROWS`` is split
    by exact value and, where values tie, by blocks of the chunk index.
    """
    key = -F.col("similarity") if descending else F.col("similarity")
    cell = [*REPORT, "_cell"]
    rows = scored.withColumn("_cell", F.floor((key + 1.0) * _CELLS))
    counts = rows.groupBy(*cell).agg(
        F.count("*").alias("_n"), F.min("similarity").alias("_min"), F.max("similarity").alias("_max")
    )
    whole = Window.partitionBy(*REPORT)
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *cell, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"),
        F.sum("_n").over(whole).alias("report_chunks"), F.min("_min").over(whole).alias("report_min"),
        F.max("_max").over(whole).alias("report_max"),
    )
    placed = rows.join(offsets, cell)
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(*_order(descending)))
    calm = placed.filter(F.col("_n") <= _BLOCK_ROWS).withColumn("_place", local)
    full = row_number_in_cells(
        placed.filter(F.col("_n") > _BLOCK_ROWS), cell, {"_key": key}, {"_block": F.floor(F.col("chunk_index") / _BLOCK_ROWS)},
        "chunk_index", "_place",
    )
    numbered = calm.unionByName(full).withColumn(out, (F.col("_ahead") + F.col("_place")).cast("int"))
    return numbered.drop("_cell", "_n", "_ahead", "_place")


def top_n(scored: DataFrame, n: int, descending: bool = True) -> DataFrame:
    """Best (or worst) ``n`` chunks per report. The limit is applied before the shuffle as well."""
    w = Window.partitionBy(*REPORT).orderBy(*_order(descending))
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def first_n(rows: DataFrame, n: int, *within: str) -> DataFrame:
    """First ``n`` rows per report, or per report and the columns ``within`` it, in document order."""
    w = Window.partitionBy(*REPORT, *within).orderBy("chunk_index")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
