"""Row x column matrices of any width, as blocks of fixed-width arrays.

A pivot has one plan column for every column of the matrix: the list of columns passes through the driver, and
plans end at some thousands.  Here the columns (days, orders, …) get an index in their order, worked out by range
slices, and a matrix row is kept as blocks: ``(row, block)`` with an array of ``width`` cells.  Blocks without any
cell are not kept.  A block is built from at most ``width`` cells, so no row of any length is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import materialize

WIDTH = 128


def column_index(cells: DataFrame, column: str, slices: int | None = None) -> DataFrame:
    """``column, idx``: the distinct columns numbered from 0 in their order (null is no column)."""
    slices = slices or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.select(column).where(F.col(column).isNotNull()).distinct()
    cut = materialize(found.repartitionByRange(slices, column).withColumn("_slice", F.spark_partition_id()), "matrix-columns")
    # a row per slice
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).select("_slice", F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(column)) - 1
    return materialize(cut.withColumn("_at", inside).join(sizes, "_slice")
                       .select(column, (F.col("_off") + F.col("_at")).cast("long").alias("idx")), "matrix-index")


def matrix_blocks(df: DataFrame, row: str, column: str, value: str = "value", how: str = "avg", width: int = WIDTH,
                  index: DataFrame | None = None) -> DataFrame:
    """``row, block, cells``: an array of ``width`` doubles a block, null where there is no cell.

    ``how="avg"`` averages a cell's readings, ``"unique"`` expects one and fails on more.  ``index`` (from
    :func:`column_index`) gives several matrices the same columns; columns that are not in it are left out.
    Rows with a null row, column or value are no cells."""
    index = column_index(df, column) if index is None else index
    whole = df.select(row, column, F.col(value).cast("double").alias("_v")).dropna(how="any")
    cell = F.avg("_v")
    if how == "unique":
        cell = F.when(F.count("_v") > 1, F.raise_error(F.concat(F.lit("several readings in cell "), F.max(F.col(column).cast("string"))))
                      .cast("double")).otherwise(F.max("_v"))
    cells = whole.groupBy(row, column).agg(cell.alias("_v")).join(index, column)
    blocks = cells.groupBy(row, F.floor(F.col("idx") / width).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("idx") % width).cast("int").alias("p"), "_v"))).alias("_e"))
    # a step per cell that is there: the gap before it as a run of nulls, then the cell; the rest behind the last one
    gap = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col("_e"), k - 1)["p"])
    filled = F.flatten(F.transform("_e", lambda e, k: F.concat(gap(e["p"] - before(k) - 1), F.array(e["_v"]))))
    return blocks.select(row, "block", F.concat(filled, gap(width - 1 - F.element_at("_e", -1)["p"])).alias("cells"))


def matrix_cells(blocks: DataFrame, row: str, column: str, index: DataFrame, width: int = WIDTH) -> DataFrame:
    """Back to long form: ``row, column, value`` of the cells that are there."""
    flat = blocks.select(row, "block", F.posexplode("cells").alias("_p", "value")).where(F.col("value").isNotNull())
    return flat.withColumn("idx", F.col("block") * width + F.col("_p")).join(index, "idx").select(row, column, "value")
