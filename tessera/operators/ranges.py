"""Range and point joins, and sets of numbered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(ranges: DataFrame, items: DataFrame, doc: str = "doc") -> DataFrame:
    """Items whose number lies in a range of their document and whose page is the range's or one of the two after it.
    Ranges are at most seven wide, so they are unrolled to an equi-join; of ranges that claim an item the last wins; a set has two members or more."""
    flat = ranges.select(doc, "s", "e", "rpage", F.explode(F.sequence("s", "e")).alias("num"))
    hit = items.join(flat, [doc, "num"]).where(F.col("page").between(F.col("rpage"), F.col("rpage") + 2))
    sized = hit.withColumn("n_", F.count("*").over(Window.partitionBy(doc, "s", "e", "rpage"))).where("n_ >= 2").drop("n_")
    w = Window.partitionBy(doc, "page", "num").orderBy(F.desc("rpage"), F.desc("s"), F.desc("e"))
    return sized.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def missing(ranges: DataFrame, items: DataFrame, doc: str = "doc") -> DataFrame:
    """Numbers of a range that no item of its pages has."""
    flat = ranges.select(doc, "s", "e", "rpage", F.explode(F.sequence("s", "e")).alias("num"))
    near = items.select(doc, "num", F.explode(F.sequence(F.col("page") - 2, F.col("page"))).alias("rpage"))
    return flat.join(near.distinct(), [doc, "num", "rpage"], "left_anti")


#: Cells of boxes are of sides 1, 4, 16, ... times a unit; coordinates beyond this are held at it.
STEP, FAR = 2, float(2**40)


def _level(side: Column, unit: float) -> Column:
    """The least level whose cells are as wide as a side."""
    return (F.ceil(F.log2(F.greatest(F.least(side, F.lit(FAR)) / unit, F.lit(1.0))) / STEP) * STEP).cast("int")


def _cell(x: Column, level: Column, unit: float) -> Column:
    return F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), x.cast("double"))) / (F.pow(F.lit(2.0), level) * unit)).cast("long")


def _cells(boxes: DataFrame, unit: float) -> DataFrame:
    """Each box in the cells of its own levels that it touches, across and down: at most two each way. Boxes without an inside or a side are in none."""
    full = boxes.where("x2 >= x1 AND y2 >= y1").withColumns({"lx_": _level(F.col("x2") - F.col("x1"), unit), "ly_": _level(F.col("y2") - F.col("y1"), unit)})
    across = F.sequence(_cell(F.col("x1"), F.col("lx_"), unit), _cell(F.col("x2"), F.col("lx_"), unit))
    down = F.sequence(_cell(F.col("y1"), F.col("ly_"), unit), _cell(F.col("y2"), F.col("ly_"), unit))
    return full.withColumn("cx_", F.explode(across)).withColumn("cy_", F.explode(down))


def _probes(points: DataFrame, cells: DataFrame, unit: float, x: str, y: str) -> DataFrame:
    """Each point in its cell of every pair of levels that some box has (some dozens at most: a level for each power of four)."""
    pairs = sorted((r.lx_, r.ly_) for r in cells.select("lx_", "ly_").distinct().collect())
    levels = F.array(*[F.struct(F.lit(a).alias("lx_"), F.lit(b).alias("ly_")) for a, b in pairs]) if pairs else F.array().cast("array<struct<lx_:int,ly_:int>>")
    flat = points.withColumn("l_", F.explode_outer(levels)).withColumns({"lx_": F.col("l_.lx_"), "ly_": F.col("l_.ly_")}).drop("l_")
    return flat.withColumns({"cx_": _cell(F.col(x), F.col("lx_"), unit), "cy_": _cell(F.col(y), F.col("ly_"), unit)})


def meet(points: DataFrame, boxes: DataFrame, by: list[str], kind: str = "inner", unit: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the boxes (x1, y1, x2, y2, borders included) of their group that they lie in; columns of boxes other than ``by`` must have names of their own.

    Boxes are filed under cells of about their own width and height, four at most, however large they are; a point looks into its one cell of each size of cell in use. So a box as large
    as a page costs no more than a small one, and small ones are met by the points near them alone. Each pair meets once. ``kind`` left keeps every probe of a point that meets none."""
    cells = _cells(boxes, unit)
    keys = [*by, "lx_", "ly_", "cx_", "cy_"]
    on = F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2"))
    left, right = _probes(points, cells, unit, x, y).alias("p"), cells.alias("b")
    for c in keys:
        on = on & (F.col(f"p.{c}") == F.col(f"b.{c}"))
    rest = [F.col(f"b.{c}") for c in boxes.columns if c not in by]
    return left.join(right, on, kind).select(*[F.col(f"p.{c}") for c in points.columns], *rest)


def outside(points: DataFrame, boxes: DataFrame, by: list[str], unit: float = 1.0) -> DataFrame:
    """Points that lie in none of the boxes of their group; points without a place are among them, repeated ones as often as they come."""
    marked = points.select(F.monotonically_increasing_id().alias("id_"), F.struct(*points.columns).alias("row_"), *points.columns)
    flat = meet(marked, boxes.select(*by, "x1", "y1", "x2", "y2", F.lit(True).alias("hit_")), by, "left", unit)
    return flat.groupBy("id_").agg(F.max("hit_").alias("hit_"), F.first("row_").alias("row_")).where("hit_ IS NULL").select("row_.*")
