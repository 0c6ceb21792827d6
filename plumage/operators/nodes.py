"""Projections and lookups on page nodes (page, ord, kind, role, text, ...), and small rules on colours and sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.functions.text import nonblank, trimmed
from plumage.operators import tiles
from plumage.operators.lineage import cut


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of a kind, numbered from the bottom of each page's stack."""
    w = Window.partitionBy("page").orderBy("ord")
    return nodes.where(F.col("kind") == kind).withColumn("position", F.row_number().over(w) - 1)


def first_of_role(nodes: DataFrame, role: str) -> DataFrame:
    """The lowest node of a role on each page that has one."""
    return nodes.where(F.col("role") == role).groupBy("page").agg(F.min(F.struct("ord", "name")).alias("n")).select("page", "n.ord", "n.name")


def required(pages: DataFrame, nodes: DataFrame, role: str) -> DataFrame:
    """Each page with its first node of a role; a page without one fails the query when its row is read."""
    found = pages.join(first_of_role(nodes, role), "page", "left")
    return found.withColumn("name", F.when(F.col("ord").isNull(), F.raise_error(F.concat(F.lit(f"no {role} on page "), F.col("page").cast("string")))).otherwise(F.col("name")))


def targets(nodes: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Nodes with a text that isn't blank, restricted to the allowed ids if there is a list."""
    rows = nodes.where(nonblank(F.col("text")))
    return rows if allowed is None else rows.join(allowed, "id", "left_semi")


def by_index(predictions: DataFrame, nodes: DataFrame, index: str) -> DataFrame:
    """Predictions joined to a page's nodes by their place from 0; places that don't exist are ignored."""
    w = Window.partitionBy("page").orderBy("ord")
    placed = nodes.withColumn(index, F.row_number().over(w) - 1)
    return predictions.join(placed, ["page", index])


def same_ids(a: DataFrame, b: DataFrame, key: str, id_col: str) -> DataFrame:
    """By key, whether both sides have the same ids, each as often: a stricter test than equal sizes and membership."""
    side = lambda df, s: df.groupBy(key, id_col).agg(F.count("*").alias(s))
    both = side(a, "x").join(side(b, "y"), [key, id_col], "full_outer")
    return both.groupBy(key).agg(F.bool_and(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same"))


def latest_status(log: DataFrame, key: str) -> DataFrame:
    """The newest status of each target."""
    return log.groupBy(key).agg(F.max_by("status", "seq").alias("status"))


def patched_list(current: DataFrame, patch: DataFrame, key: str, secret: str) -> DataFrame:
    """A replaced list: its rows are the patch's, but a redacted secret keeps the current one."""
    old = current.select(F.col(key), F.col(secret).alias("_old"))
    return patch.join(old, key, "left").withColumn(secret, F.when(F.col(secret) == "[REDACTED]", F.col("_old")).otherwise(F.col(secret))).drop("_old")


def _gray(c: list[Column]) -> Column:
    return F.greatest(*c) - F.least(*c) <= 10


def snapped(c: list[Column]) -> list[Column]:
    """Nearly black becomes black, nearly white white; grays by 60 steps, colours by 12."""
    low = F.when(_gray(c), 60).otherwise(12)
    dark, light = F.greatest(*c) <= low, F.least(*c) >= 255 - low
    return [F.when(dark, 0).when(light, 255).otherwise(x) for x in c]


def similar_colours(a: list[Column], b: list[Column], by: int = 16) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & (F.abs(x - y) <= by)
    return out


def scaled(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Sides with the longer one at most ``most``; at least 1."""
    longer = F.greatest(w, h)
    return tuple(F.when(longer <= most, x).otherwise(F.greatest(F.round(x * (F.lit(float(most)) / longer)), F.lit(1)).cast("int")) for x in (w, h))


def ceil_multiple(v: Column, m: int) -> Column:
    return (F.ceil(v / m) * m).cast("int") if m else v


def crop_side(low: Column, high: Column, margin: int, size: int) -> tuple[Column, Column]:
    """A side grown by the margin about its middle; what one border cuts off is added at the other end."""
    middle, half = F.floor((low + high) / 2), F.floor((high - low + 2 * margin) / 2)
    a, z = middle - half, middle + half
    left = F.greatest(F.greatest(a, F.lit(0)) - F.greatest(z - size, F.lit(0)), F.lit(0))
    right = F.least(F.least(z, F.lit(size)) + F.greatest(-a, F.lit(0)), F.lit(size))
    left = F.least(left, F.lit(size))
    return left.cast("int"), F.least(F.greatest(right, left + 1), F.lit(size)).cast("int")


def dilate_radius(font: Column, w: Column, h: Column, ratio: float, least: int, most: int) -> Column:
    """From the font size, or the shorter side (1 at least) where it is unknown."""
    size = F.coalesce(font, F.greatest(F.least(w, h), F.lit(1)).cast("double"))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.round(size * ratio).cast("int")))


def rate(n: Column, seconds: Column) -> Column:
    """Items a second; 0 where no time has passed."""
    return F.coalesce(F.try_divide(n, seconds), F.lit(0.0))


def alpha_restored(pixels: DataFrame, ring: DataFrame) -> DataFrame:
    """Masked pixels (page, x, y, alpha) take the median alpha of the ring around the mask where it is under 128."""
    m = ring.groupBy("page").agg(F.floor(F.median("alpha")).cast("int").alias("m"))
    out = pixels.join(m, "page", "left")
    return out.withColumn("alpha", F.when(F.col("m") < 128, F.col("m")).otherwise(F.col("alpha"))).drop("m")


def united(labels: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``labels`` (keys, c, l) with l the least over all that edges (keys, c, d; in both directions) connect.

    Each round every l found so far takes the least l that touches it, and what that one takes in turn, so long paths don't
    need a round for each step.
    """
    now = cut(labels)
    while True:
        beside = edges.join(now.select(*keys, F.col("c").alias("d"), F.col("l").alias("other")), [*keys, "d"]).groupBy(*keys, "c").agg(F.min("other").alias("other"))
        least = now.join(beside, [*keys, "c"], "left").groupBy(*keys, "l").agg(F.least(F.col("l"), F.coalesce(F.min("other"), F.col("l"))).alias("to"))
        least = cut(least)
        if not least.where("to < l").limit(1).count():
            return now
        jump = least.select(*keys, F.col("l").alias("to"), F.col("to").alias("next"))
        to = least.join(jump, [*keys, "to"], "left").select(*keys, "l", F.coalesce("next", "to").alias("next"))
        now = cut(now.join(to, [*keys, "l"]).select(*keys, "c", F.col("next").alias("l")))


def components(pixels: DataFrame) -> DataFrame:
    """(page, x, y, c): pixels with the number of their connected area, diagonals included; all pages at once.

    Areas are found in each tile first; those of tiles beside each other that touch are joined, if there are any.
    """

    def local(stack, tx, ty):
        n, h, w = stack.shape
        places, roots = tiles.component_roots(stack > 0)
        at = places // (h * w)
        x, y, rx, ry = places % w, places // w % h, roots % w, roots // w % h
        left, top = tx[at] * tiles.SIDE, ty[at] * tiles.SIDE
        yield at, {"x": (x + left).astype(np.int32), "y": (y + top).astype(np.int32), "c": (ry + top << 20) + rx + left}

    found = cut(tiles.by_stack(tiles.points(pixels, ["page"], F.lit(1)), ["page"], "x int, y int, c bigint", local))
    beside = " or ".join(f"{a} % {tiles.SIDE} = {tiles.SIDE - 1} or ({a} > 0 and {a} % {tiles.SIDE} = 0)" for a in "xy")
    rim = found.where(beside)
    if not rim.limit(1).count():
        return found
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = rim.select("page", F.col("c").alias("d"), near.alias("o"), "x", "y").select("page", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "d")
    touch = cut(rim.join(around, ["page", "x", "y"]).where("c <> d").select("page", "c", "d").distinct())
    joined = united(touch.select("page", "c").distinct().withColumn("l", F.col("c")), touch, ["page"])
    return found.join(joined, ["page", "c"], "left").select("page", "x", "y", F.coalesce("l", "c").alias("c"))


def component_boxes(pixels: DataFrame) -> DataFrame:
    """Bounding boxes (page, x1, y1, x2, y2, n; right and bottom exclusive) of connected pixels, diagonals included."""
    return components(pixels).groupBy("page", "c").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count("*").alias("n")).drop("c")


def renderable(nodes: DataFrame) -> DataFrame:
    """Nodes with a translation that isn't blank, which is trimmed."""
    return nodes.where(nonblank(F.col("translation"))).withColumn("translation", trimmed(F.col("translation")))


def selected(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen nodes (page, id), numbered in each page's stacking order among themselves."""
    w = Window.partitionBy("page").orderBy("ord")
    return nodes.join(chosen.select("page", "id"), ["page", "id"], "left_semi").withColumn("position", F.row_number().over(w) - 1)


Point = tuple[Column, Column]


def quad_box(quad: list[Point]) -> list[Column]:
    """Least and largest x and y of four points, as x1, y1, x2, y2."""
    xs, ys = zip(*quad)
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def quad_axes(quad: list[Point]) -> tuple[Column, Column]:
    """Lengths of the lines between the middles of opposite sides: first to third, then fourth to second side."""
    middle = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(quad, quad[1:] + quad[:1])]
    length = lambda a, b: F.sqrt(F.pow(b[0] - a[0], 2) + F.pow(b[1] - a[1], 2))
    return length(middle[0], middle[2]), length(middle[3], middle[1])


def _between(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, high if isinstance(high, Column) else F.lit(high)), low if isinstance(low, Column) else F.lit(low))


def font_bounds(width: Column, height: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    """Least font size of a page (a ninetieth of its longer side, 12 to 28) and largest of a box (72 at most, above the least)."""
    least = _between(F.greatest(width, height) / 90.0, 12.0, 28.0)
    return least, _between(F.least(box_h * 0.45, box_w * 0.9), least + 1, 72.0)


def stroke_width(font: Column) -> Column:
    """A tenth of the font size, 1.2 to 8."""
    return _between(font * 0.1, 1.2, 8.0)


def stroke(block: Column, whole: Column, predicted: Column, font: Column, auto: Column) -> Column:
    """The outline (colour, width) of a text, null where it is switched off.

    block and whole: structs (enabled, colour, width) of the block's and the document's style, null where there is none; the
    first that there is decides, and ``enabled`` false means no outline. Without either it has the contrasting colour
    ``auto`` and the predicted width if that is above 0. A missing width follows from the font size.
    """
    styled = lambda s: F.when(s["enabled"], F.struct(s["colour"].alias("colour"), F.coalesce(s["width"], stroke_width(font)).alias("width")))
    other = F.struct(auto.alias("colour"), F.when(predicted > 0, predicted).otherwise(stroke_width(font)).alias("width"))
    return F.when(block.isNotNull(), styled(block)).when(whole.isNotNull(), styled(whole)).otherwise(other)


def text_colour(styled: Column, own: Column, predicted: Column, black: Column) -> Column:
    """The style's colour where the text has a style of its own, else the predicted one, else black."""
    return F.when(styled, own).otherwise(F.coalesce(predicted, black))


def crop_bounds(width: Column, height: Column, b: dict[str, Column], expand: Column, font: Column, vertical: Column) -> dict[str, Column]:
    """Whole-pixel bounds of a text block (x, y, w, h) in an image; ``b`` may hold lines_x1 to lines_y2, the extent of its lines.

    Only blocks to ``expand`` (of a line detector, or with lines) take their lines in and get padding: 0.12 of the font size along the
    writing and 0.18 across it, at least 0.08 and 2 pixels. A missing font size is the shorter side. Bounds hold a pixel at least.
    """
    right, bottom = b["x"] + b["w"], b["y"] + b["h"]
    size = F.coalesce(font, F.greatest(F.least(b["w"], b["h"]), F.lit(1.0)))
    least = F.greatest(size * 0.08, F.lit(2.0))
    along, across = F.greatest(size * 0.12, least), F.greatest(size * 0.18, least)
    pad_x, pad_y = F.when(vertical, across).otherwise(along), F.when(vertical, along).otherwise(across)
    low = lambda c, pad, side: _between(F.floor(c - pad), 0, side - 1)
    x1 = F.when(expand, low(F.least(b["x"], b["lines_x1"]), pad_x, width)).otherwise(F.floor(F.greatest(b["x"], F.lit(0.0)))).cast("int")
    y1 = F.when(expand, low(F.least(b["y"], b["lines_y1"]), pad_y, height)).otherwise(F.floor(F.greatest(b["y"], F.lit(0.0)))).cast("int")
    x2 = F.when(expand, F.ceil(F.greatest(right, b["lines_x2"]) + pad_x)).otherwise(F.ceil(right))
    y2 = F.when(expand, F.ceil(F.greatest(bottom, b["lines_y2"]) + pad_y)).otherwise(F.ceil(bottom))
    return {"x1": x1, "y1": y1, "x2": _between(x2, x1 + 1, width).cast("int"), "y2": _between(y2, y1 + 1, height).cast("int")}


def centred(b: dict[str, Column], w: Column, h: Column) -> tuple[Column, Column]:
    """Upper left corner, rounded, of a w x h sprite in the middle of the box (x, y, w, h)."""
    return F.round(b["x"] + b["w"] * 0.5 - w * 0.5), F.round(b["y"] + b["h"] * 0.5 - h * 0.5)
