"""Masks grown by areas and bounded by labels, on rows (page, x, y); every area of every page is its own group of rows.

Pixels meet areas by page and by cells of 64 pixels, never all of a page with all its areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.operators.areas import grown_mask
from plumage.operators.detect import majority_label
from plumage.operators.raster import dilated

CELL = 64


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL), F.floor((high - 1) / CELL)))


def in_areas(pixels: DataFrame, areas: DataFrame, pad: Column, width: int, height: int) -> DataFrame:
    """Rows of ``areas`` (page, area, x1, y1, x2, y2, r; right and bottom exclusive) with each pixel in them, grown by ``pad`` in the image.

    wx1 to wy2 are the grown bounds.
    """
    a = areas.withColumns(
        {"wx1": F.greatest(F.col("x1") - pad, F.lit(0)), "wy1": F.greatest(F.col("y1") - pad, F.lit(0)), "wx2": F.least(F.col("x2") + pad, F.lit(width)), "wy2": F.least(F.col("y2") + pad, F.lit(height))}
    ).where("wx2 > wx1 and wy2 > wy1")
    a = a.withColumn("tx", _cells(F.col("wx1"), F.col("wx2"))).withColumn("ty", _cells(F.col("wy1"), F.col("wy2")))
    p = pixels.select("page", "x", "y", F.floor(F.col("x") / CELL).alias("tx"), F.floor(F.col("y") / CELL).alias("ty"))
    return a.join(p, ["page", "tx", "ty"]).where("x >= wx1 and x < wx2 and y >= wy1 and y < wy2").drop("tx", "ty")


def grown(pixels: DataFrame, areas: DataFrame, labels: DataFrame, width: int, height: int) -> DataFrame:
    """(page, x, y): the pixels in and around each area, dilated by its r and kept inside the label that most of its own pixels have.

    Only areas with a pixel of their own count. Pixels up to 2 r outside take part and are grown to; an area none of whose pixels
    has a label above 0 isn't bounded by one. For areas of any size; those that fit in a tile are grown there (``areas.covered``).
    """
    near = in_areas(pixels, areas, 2 * F.col("r"), width, height).withColumn("own", F.expr("x >= x1 and x < x2 and y >= y1 and y < y2"))
    voted = majority_label(near.where("own").join(labels.where("label > 0"), ["page", "x", "y"]).select("page", "area", "label"), "page", "area").select("page", "area", F.col("label").alias("bound"))
    real = near.where("own").select("page", "area").distinct().join(voted, ["page", "area"], "left")
    out = near.join(real, ["page", "area"]).select("page", "area", "x", "y", "r", "bound", "wx1", "wy1", "wx2", "wy2")
    for axis in "xy":  # a square goes line by line
        out = out.withColumn(axis, F.explode(F.sequence(F.col(axis) - F.col("r"), F.col(axis) + F.col("r")))).where(f"{axis} >= w{axis}1 and {axis} < w{axis}2").distinct()
    out = out.select("page", "x", "y", "bound").distinct().join(labels.select("page", "x", "y", "label"), ["page", "x", "y"], "left")
    return out.where("bound is null or coalesce(label, 0) = bound").select("page", "x", "y").distinct()


def expanded(pixels: DataFrame, blocks: DataFrame, labels: DataFrame, width: int, height: int, ratio: float, least: int, most: int) -> DataFrame:
    """A mask (page, x, y) grown for erasing: around text blocks first, then around each connected area that no block has covered.

    blocks: (page, area, x1, y1, x2, y2, r); labels: (page, x, y, label), or rectangles (page, x1, y1, x2, y2, v) to paint. An uncovered
    area's radius is ``ratio`` of its shorter side, ``least`` to ``most``; its bounds are grown by that radius before its pixels vote
    for a label.
    """
    return grown_mask(pixels, blocks, labels, width, height, (ratio, least, most), ("grown", "grown"), {"grown": grown})


def ring(mask: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """(page, x, y): the places within r of a mask's pixels that aren't in it."""
    own = mask.select("page", "x", "y").distinct()
    return dilated(own.withColumn("v", F.lit(255)), r, width, height).select("page", "x", "y").join(own, ["page", "x", "y"], "left_anti")


def filled(pixels: DataFrame, fills: DataFrame) -> DataFrame:
    """pixels (page, x, y, label, masked, r, g, b) with the fills (page, label, r, g, b) written to the masked pixels of their labels.

    ``masked`` stays true only where nothing was written.
    """
    f = fills.select("page", "label", F.struct("r", "g", "b").alias("_f"))
    out = pixels.join(f, ["page", "label"], "left").withColumn("_on", F.col("masked") & F.col("_f").isNotNull())
    return out.withColumns({c: F.when(F.col("_on"), F.col(f"_f.{c}")).otherwise(F.col(c)) for c in "rgb"}).withColumn("masked", F.col("masked") & ~F.col("_on")).drop("_f", "_on")
