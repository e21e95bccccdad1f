"""Table analysis on cell rows: spans, merges, labels, sections, units, regions and years.

cells: form_id, section, table_idx, row, col, row_span, col_span, text, ... (native addresses); grid_columns and
vmerge_groups turn the other dialect (cell_seq, grid_span, vmerge) into addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slotweave.functions import textfn as X
from slotweave.operators import colocated

TABLE = ["form_id", "section", "table_idx"]
#: Words that begin a region (fixed).
REGION = "세입|세출|수입|지출|비용|수익"


def _by(*order: str) -> WindowSpec:
    return Window.partitionBy(*TABLE).orderBy(*order)


def grid_columns(cells: DataFrame) -> DataFrame:
    """col: first grid column of each cell of a row (cell_seq order, grid_span columns each)."""
    before = Window.partitionBy(*TABLE, "row").orderBy("cell_seq").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum("grid_span").over(before), F.lit(0)).cast("int"))


def vmerge_groups(cells: DataFrame) -> DataFrame:
    """start_row: of a vertically merged cell (vmerge `restart` or `continue`) the row where its group starts, else its own."""
    so_far = Window.partitionBy(*TABLE, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.coalesce("vmerge", F.lit("")) != "continue", F.col("row")), ignorenulls=True).over(so_far)
    return cells.withColumn("start_row", F.coalesce(start, "row"))


def hmerge_groups(cells: DataFrame) -> DataFrame:
    """Horizontal merges: (table, row, from_col, to_col)."""
    return cells.filter("col_span > 1").select(*TABLE, "row", F.col("col").alias("from_col"), (F.col("col") + F.col("col_span") - 1).alias("to_col"))


def table_shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*TABLE).agg(F.countDistinct("row").alias("row_count"), F.max(F.col("col") + F.col("col_span")).cast("long").alias("column_count"))


def row_labels(cells: DataFrame) -> DataFrame:
    """(table, row, row_label): the text of each row's first cell."""
    return cells.groupBy(*TABLE, "row").agg(F.min_by(X.strip("text"), "col").alias("row_label"))


def col_labels(cells: DataFrame) -> DataFrame:
    """(table, col, col_label): texts of the first row, repeated over the columns a cell spans."""
    top = Window.partitionBy(*TABLE)
    head = cells.withColumn("top", F.min("row").over(top)).filter(F.col("row") == F.col("top"))
    return head.select(*TABLE, F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"), X.strip("text").alias("col_label"))


def table_sections(cells: DataFrame) -> DataFrame:
    """(table, start_row, end_row): a new section begins where a row repeats the first row's label, unless it is blank."""
    rows = row_labels(cells).withColumn("head", F.first("row_label").over(_by("row")))
    again = (F.col("row_label") == F.col("head")) & (F.col("head") != "")
    rows = rows.withColumn("island", F.sum(F.when(again, 1).otherwise(0)).over(_by("row")))
    return rows.groupBy(*TABLE, "island").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row")).drop("island")


def unit_declarations(cells: DataFrame) -> DataFrame:
    """Cells that declare a unit for their own table; never inherited."""
    return cells.filter(X.is_unit_declaration("text")).select(*TABLE, "row", "col", X.strip("text").alias("text"))


def regions(cells: DataFrame) -> DataFrame:
    """(table, start_col, end_col, keyword): columns split at those whose label has a region word.

    The first region runs from column 0 to the first such column and carries its word; each later one begins where
    the last ended; the last runs to the table's end and carries the last word.
    """
    labels = col_labels(cells)
    hits = labels.filter(F.col("col_label").rlike(REGION))
    hits = hits.select(*TABLE, F.coalesce(F.lag("col").over(_by("col")), F.lit(0)).alias("start_col"), F.col("col").alias("end_col"), F.col("col_label").alias("keyword"))
    last = hits.groupBy(*TABLE).agg(F.max_by(F.struct("end_col", "keyword"), "end_col").alias("x")).join(table_shape(cells), TABLE)
    tail = last.select(*TABLE, F.col("x.end_col").alias("start_col"), F.col("column_count").cast("int").alias("end_col"), F.col("x.keyword").alias("keyword"))
    return hits.unionByName(tail)


def year_columns(cells: DataFrame) -> DataFrame:
    return col_labels(cells).withColumn("year", X.year_of("col_label")).filter("year IS NOT NULL").select(*TABLE, "col", "year", F.col("col_label").alias("label"))


def cell_labels(cells: DataFrame, clustered: bool = False) -> DataFrame:
    """cells with cell_label: row label / column label at the cell's own coordinates, blanks left out.

    With `clustered` the cells are already dealt by form_id, and nothing is shuffled.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = colocated.left_join(cells, row_labels(cells), [*TABLE, "row"], clustered)
    rows = colocated.left_join(rows, col_labels(cells), [*TABLE, "col"], clustered)
    return rows.withColumn("cell_label", F.concat_ws(" / ", some("row_label"), some("col_label")))


def table_fields(cells: DataFrame, clustered: bool = False) -> DataFrame:
    """Value fields of a data table: cells with a value outside the first row and column."""
    top = Window.partitionBy(*TABLE)
    rows = cell_labels(cells, clustered).withColumns({"top": F.min("row").over(top), "side": F.min("col").over(top)})
    return rows.filter((F.col("row") > F.col("top")) & (F.col("col") > F.col("side")) & ~X.is_blank("text")).select(*TABLE, "row", "col", F.col("cell_label").alias("label"), X.strip("text").alias("original_text"))


def inner_tables(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables (form_id, section, table_idx, parent_table, parent_row, parent_col) that lie in a cell, with its text."""
    outer = cells.select("form_id", "section", F.col("table_idx").alias("parent_table"), F.col("row").alias("parent_row"), F.col("col").alias("parent_col"), F.col("text").alias("parent_text"))
    return tables.join(outer, ["form_id", "section", "parent_table", "parent_row", "parent_col"])


