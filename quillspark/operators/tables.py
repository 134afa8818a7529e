"""Tables: cells, spans and LaTeX rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import latex_escape


def number_cells(cells: DataFrame, table: str, row: str, order: str) -> DataFrame:
    """Cells with ``cell_row`` and ``cell_col``, counted from 0 within a table."""
    return cells.withColumns({
        "cell_row": (F.dense_rank().over(Window.partitionBy(table).orderBy(row)) - 1).cast("int"),
        "cell_col": (F.row_number().over(Window.partitionBy(table, row).orderBy(order)) - 1).cast("int"),
    })


def spans(cells: DataFrame, table: str = "table_id", row: str = "row", right: str = "right") -> DataFrame:
    """Cells with ``boundary``, the number of their right edge among the distinct ones of the table, and ``col_span``: how many column boundaries
    each one crosses.  One shuffle by table."""
    numbered = cells.withColumn("boundary", (F.dense_rank().over(Window.partitionBy(table).orderBy(right)) - 1).cast("int"))
    left = F.lag("boundary").over(Window.partitionBy(table, row).orderBy(right))
    return numbered.withColumn("col_span", (F.col("boundary") - F.coalesce(left, F.lit(-1))).cast("int"))


def latex_rows(cells: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``keys`` and ``latex``: the cells of each row in order, escaped and joined."""
    one = F.struct(F.col(order).alias("o"), latex_escape(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), " & ")
    return cells.groupBy(*keys).agg(F.concat(joined, F.lit(" \\\\")).alias("latex"))


def table_shape(cells: DataFrame, table: str) -> DataFrame:
    """``rows``, ``cols`` and ``cells`` of every table, from ``cell_row`` and ``cell_col``."""
    return cells.groupBy(table).agg((F.max("cell_row") + 1).alias("rows"), (F.max("cell_col") + 1).alias("cols"), F.count("*").alias("cells"))
