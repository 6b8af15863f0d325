"""Reading order of a page's blocks (T9-T12), with windows over one page at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as T
from ..settings import Settings

PAGE = ("source", "page")


def column_side(x0: Column, x1: Column, mid: Column, tolerance: float) -> Column:
    """-1 left, 1 right, 0 across the middle; left is tested first."""
    return F.when(x1 <= mid + tolerance, -1).when(x0 >= mid - tolerance, 1).otherwise(0)


def read_order(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``blocks(source, page, ord, x0, y0, x1, mid, ...)`` with side, band and pos (from 1).

    Blocks across the middle cut the page into bands; a band is the number of such blocks that start
    no lower, found with a range frame over the page. A band's own wide block comes first, then the left
    column, then the right one, each from top to bottom.
    """
    tol = (settings or Settings()).column_tolerance
    side = column_side(F.col("x0"), F.col("x1"), F.col("mid"), tol)
    wide = (F.col("side") == 0).cast("int")
    key = [F.bround("y0", 1), F.bround("x0", 1), F.col("ord")]
    above = Window.partitionBy(*PAGE).orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    among = Window.partitionBy(*PAGE, "side").orderBy(*key)
    band = F.when(F.col("side") == 0, F.row_number().over(among)).otherwise(F.coalesce(F.sum(wide).over(above), F.lit(0)))
    rank = F.when(F.col("side") == 0, 0).when(F.col("side") < 0, 1).otherwise(2)
    order = Window.partitionBy(*PAGE).orderBy("band", rank, *key)
    return blocks.withColumn("side", side).withColumn("band", band.cast("int")).withColumn("pos", F.row_number().over(order))


def page_blocks(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Text blocks in reading order, cleaned; empty and noisy ones go only after ordering, since
    a wide noisy block still ends a band. ``blocks`` has block_type too (S3: 0 is text).

    Texts are cleaned below the windows, once a row: a filter on them above a projection would be evaluated
    with the whole of it."""
    cleaned = blocks.where("block_type = 0").withColumn("text", T.clean("text"))
    cleaned = cleaned.withColumn("_keep", (F.col("text") != "") & ~T.is_noise("text"))
    return read_order(cleaned, settings).where("_keep").select(*PAGE, "pos", "text")
