"""Texts and payloads for readers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(items: Column, line, none: str | None = None) -> Column:
    """One line per element; `none` where there is none."""
    lines = F.array_join(F.transform(items, line), "\n")
    empty = F.coalesce(F.size(items), F.lit(0)) <= 0
    return F.when(empty, F.lit(none)).otherwise(lines)


def tile_prompt(sheet_id: Column, tile: Column, symbols: Column, prefixes: Column) -> Column:
    """What a reader is told about a tile: its place, and the sheet's legend."""
    place = F.format_string("Sheet %s, page pixels x%d-%d, y%d-%d.", F.coalesce(sheet_id, F.lit("unknown")), tile["x0"], tile["x1"], tile["y0"], tile["y1"])
    legend = listed(symbols, lambda s: F.concat(F.lit("- "), s["shape"], F.lit(": "), s["meaning"]))
    codes = listed(prefixes, lambda p: F.concat(F.lit("- "), p["code"], F.lit(" = "), p["meaning"]))
    return F.concat_ws("\n", place, F.when(legend.isNotNull(), F.concat(F.lit("Symbols of this sheet:\n"), legend)), F.when(codes.isNotNull(), F.concat(F.lit("Codes of this sheet:\n"), codes)))


def dispute_prompt(items: Column) -> Column:
    """Numbered disputes (array<struct<id, box, kind, claim_a, claim_b>>) as lines."""
    at = lambda d: F.concat(F.lit("["), d["id"].cast("string"), F.lit("] at "), F.array_join(F.array(*[d["box"][s].cast("string") for s in ("x0", "y0", "x1", "y1")]), ","))
    both = lambda d: F.concat(at(d), F.lit(": A reads '"), d["claim_a"], F.lit("', B reads '"), d["claim_b"], F.lit("'"))
    one = lambda d: F.concat(at(d), F.when(d["kind"] == "solo_a", F.lit(": only A reads '")).otherwise(F.lit(": only B reads '")), F.coalesce(d["claim_a"], d["claim_b"]), F.lit("'"))
    return listed(items, lambda d: F.when(d["kind"] == "conflict", both(d)).otherwise(one(d)), "(none)")


def image_block(png: Column) -> Column:
    """An image as a JSON block of base64."""
    return F.to_json(F.struct(F.lit("image/png").alias("media_type"), F.base64(png).alias("data")))
