"""Boxes as struct<x0,y0,x1,y1> of pixels. Areas are LONG: products of pixels overflow INT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, OVERLAP = 1250, 0.15
CROP = 900
PAD_LEAST, PAD_SHARE = 150, 0.25
MOST_EDGE, MOST_PIXELS = 2576, 3_000_000


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(v).cast("int").alias(n) if isinstance(v, str) else v.cast("int").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def _long(b: Column, side: str) -> Column:
    return b[side].cast("long")


def area(b: Column) -> Column:
    """Of the box; 0 for one that is inside out."""
    return F.greatest(_long(b, "x1") - _long(b, "x0"), F.lit(0)) * F.greatest(_long(b, "y1") - _long(b, "y0"), F.lit(0))


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def intersection(a: Column, b: Column) -> Column:
    w = F.least(_long(a, "x1"), _long(b, "x1")) - F.greatest(_long(a, "x0"), _long(b, "x0"))
    h = F.least(_long(a, "y1"), _long(b, "y1")) - F.greatest(_long(a, "y0"), _long(b, "y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't overlap or have no area."""
    common = intersection(a, b)
    union = (_long(a, "x1") - _long(a, "x0")) * (_long(a, "y1") - _long(a, "y0")) + (_long(b, "x1") - _long(b, "x0")) * (_long(b, "y1") - _long(b, "y0")) - common
    return F.when(common > 0, F.coalesce(F.try_divide(common.cast("double"), union.cast("double")), F.lit(0.0))).otherwise(F.lit(0.0))


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / F.lit(2.0)).alias("x"), ((b["y0"] + b["y1"]) / F.lit(2.0)).alias("y"))


def centre_inside(a: Column, b: Column) -> Column:
    """The centre of a lies in b, its border included. Doubled, so that it stays in integers."""
    return (a["x0"] + a["x1"]).between(2 * b["x0"], 2 * b["x1"]) & (a["y0"] + a["y1"]).between(2 * b["y0"], 2 * b["y1"])


def manhattan(a: Column, b: Column) -> Column:
    """Between centres."""
    return F.abs((a["x0"] + a["x1"]) - (b["x0"] + b["x1"])) / F.lit(2.0) + F.abs((a["y0"] + a["y1"]) - (b["y0"] + b["y1"])) / F.lit(2.0)


def shift(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def scale(b: Column, sx: Column, sy: Column) -> Column:
    """Multiplied and cut to whole pixels."""
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def from_tile(b: Column, tile: Column, sx: Column, sy: Column) -> Column:
    """A reader's box inside a tile as a box on the page."""
    return shift(scale(b, sx, sy), tile["x0"], tile["y0"])


def to_tile(b: Column, tile: Column, sx: Column, sy: Column) -> Column:
    """A box on the page in a reader's units inside a tile."""
    return box((b["x0"] - tile["x0"]) / sx, (b["y0"] - tile["y0"]) / sy, (b["x1"] - tile["x0"]) / sx, (b["y1"] - tile["y0"]) / sy)


def reader_scale(thousandths: Column, side: Column) -> Column:
    """Pixels for one unit of a reader: side / 1000 for those that answer on a scale of 0 to 1000, else 1."""
    return F.when(thousandths, side / F.lit(1000.0)).otherwise(F.lit(1.0))


def shift_points(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).cast("int").alias("x"), (p["y"] + dy).cast("int").alias("y")))


def points_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def rescale_zones(zones: Column, by: Column) -> Column:
    """Zones read off a reduced page, on the page itself."""
    return F.transform(zones, lambda z: F.struct(z["kind"].alias("kind"), scale(z["bbox"], 1 / by, 1 / by).alias("bbox")))


def padded(b: Column, width: Column, height_: Column, least: int = PAD_LEAST, share: float = PAD_SHARE) -> Column:
    """Widened on each side by a share of its extent, at least `least`, and kept on the page."""
    px = F.greatest(F.lit(least), ((b["x1"] - b["x0"]) * share).cast("int"))
    py = F.greatest(F.lit(least), ((b["y1"] - b["y0"]) * share).cast("int"))
    return box(F.greatest(F.lit(0), b["x0"] - px), F.greatest(F.lit(0), b["y0"] - py), F.least(width, b["x1"] + px), F.least(height_, b["y1"] + py))


def fit_scale(width: Column, height_: Column, edge: int = MOST_EDGE, pixels: int = MOST_PIXELS) -> Column:
    """The largest scale up to 1 at which an image keeps a longest edge and a number of pixels."""
    return F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height_), F.sqrt(F.lit(float(pixels)) / (width.cast("double") * height_)))


def crop_window(b: Column, width: Column, height_: Column, size: int = CROP) -> Column:
    """A square around the centre, pushed right and down to the page's origin, then cut at its far edges."""
    x0 = F.greatest(F.lit(0), F.floor((b["x0"] + b["x1"]) / 2) - size // 2)
    y0 = F.greatest(F.lit(0), F.floor((b["y0"] + b["y1"]) / 2) - size // 2)
    return box(x0, y0, F.least(width.cast("long"), x0 + size), F.least(height_.cast("long"), y0 + size))


def inspector_window(b: Column, width: Column, height_: Column, pad: int = 60) -> Column:
    return box(F.greatest(F.lit(0), b["x0"] - pad), F.greatest(F.lit(0), b["y0"] - pad), F.least(width, b["x1"] + pad), F.least(height_, b["y1"] + pad))


def quarters(b: Column, share: float = 0.55) -> Column:
    """Four overlapping parts of a tile, numbered from the top left by rows."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    pw, ph = (w * share).cast("int"), (h * share).cast("int")
    corners = [(F.lit(0), F.lit(0)), (w - pw, F.lit(0)), (F.lit(0), h - ph), (w - pw, h - ph)]
    return F.array(*[F.struct(F.lit(i).alias("sub_tile"), box(b["x0"] + x, b["y0"] + y, b["x0"] + x + pw, b["y0"] + y + ph).alias("box")) for i, (x, y) in enumerate(corners)])


def hit(b: Column, x, y, pad: int = 0) -> Column:
    return F.lit(x).between(b["x0"] - pad, b["x1"] + pad) & F.lit(y).between(b["y0"] - pad, b["y1"] + pad)


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """Where tiles begin along one side: every `step` pixels, and one flush with the far edge if a strip would be left."""
    step = int(tile * (1 - overlap))
    steps = F.sequence(F.lit(0), F.greatest(length - tile, F.lit(0)), F.lit(step))
    return F.when(F.element_at(steps, -1) + tile < length, F.concat(steps, F.array(length - tile))).otherwise(steps)


def tile_grid(pages: DataFrame, tile: int = TILE, overlap: float = OVERLAP) -> DataFrame:
    """page, tile_id, box: overlapping tiles that cover pages (page, width, height), row by row."""
    rows = pages.select("page", "width", "height", tile_starts(F.col("width"), tile, overlap).alias("xs"), tile_starts(F.col("height"), tile, overlap).alias("ys"))
    corners = F.flatten(F.transform("ys", lambda y: F.transform("xs", lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return rows.select("page", "width", "height", F.posexplode(corners).alias("i", "c")).select(
        "page",
        F.format_string("t%02d", "i").alias("tile_id"),
        box(F.col("c.x"), F.col("c.y"), F.least(F.col("c.x") + tile, F.col("width")), F.least(F.col("c.y") + tile, F.col("height"))).alias("box"),
    )
