"""Spatial joins on a grid, and greedy folds over overlapping boxes.

Boxes are dealt to the cells that they touch and joined on (page, cell); a pair counts in the one cell that holds the top left
corner of its intersection, so no pair is seen twice and none is lost. Every join is an equi-join with a residual condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions.geometry import centre_inside, iou

CELL = 256


def _rows(rows: list[tuple], page: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [page, *[pa.float64() if n == "iou" else pa.int64() for n in names[1:]]]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def on_grid(df: DataFrame, box: str = "bbox", cell: int = CELL) -> DataFrame:
    """df once per cell that its box touches: plus cx, cy."""
    b = F.col(box)
    side = lambda lo, hi: F.sequence(F.floor(lo / cell), F.greatest(F.floor(hi / cell), F.floor(lo / cell)))
    return df.withColumn("cx", F.explode(side(b["x0"], b["x1"]))).withColumn("cy", F.explode(side(b["y0"], b["y1"])))


def owns(a: Column, b: Column, cell: int = CELL) -> Column:
    """The joined cell is the one of the intersection's top left corner."""
    return (F.col("cx") == F.floor(F.greatest(a["x0"], b["x0"]) / cell)) & (F.col("cy") == F.floor(F.greatest(a["y0"], b["y0"]) / cell))


def overlapping(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", cell: int = CELL, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left (page, bbox, ...) and right (page, other, ...) boxes of a page that meet a condition which implies that
    the boxes touch. how: inner, left_semi or left_anti; the last two give rows of left once each, by page and ord. on: more
    columns of both sides that must be equal."""
    a, b = on_grid(left, "bbox", cell), on_grid(right, "other", cell)
    pairs = a.join(b, ["page", "cx", "cy", *on]).where(owns(F.col("bbox"), F.col("other"), cell) & condition)
    if how == "inner":
        return pairs.drop("cx", "cy")
    hits = pairs.select("page", "ord").distinct()
    return left.join(hits, ["page", "ord"], how)


def with_match(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of left (page, ord, bbox) that overlap some box of right by more than a threshold of IoU."""
    return overlapping(left, right.select("page", F.col("bbox").alias("other")), iou(F.col("bbox"), F.col("other")) > threshold, "left_semi")


def without_match(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    return overlapping(left, right.select("page", F.col("bbox").alias("other")), iou(F.col("bbox"), F.col("other")) > threshold, "left_anti")


def unread(regions: DataFrame, observations: DataFrame) -> DataFrame:
    """Regions that hold the centre of no observation and whose own centre lies in none."""
    either = centre_inside(F.col("bbox"), F.col("other")) | centre_inside(F.col("other"), F.col("bbox"))
    return overlapping(regions, observations.select("page", F.col("bbox").alias("other")), either, "left_anti")


def coverage(regions: DataFrame, observations: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per page: detector_regions, observations, matched, coverage, observations_without_detection. One join gives both
    directions."""
    count = lambda df, name: df.groupBy("page").agg(F.count(F.lit(1)).alias(name))
    found = observations.select("page", F.col("ord").alias("o_ord"), F.col("bbox").alias("other"))
    pairs = overlapping(regions.select("page", F.col("ord").alias("r_ord"), "bbox"), found, iou(F.col("bbox"), F.col("other")) > threshold)
    met = pairs.groupBy("page").agg(F.count_distinct("r_ord").alias("matched"), F.count_distinct("o_ord").alias("detected"))
    out = count(regions, "detector_regions").join(count(observations, "observations"), "page", "full").join(met, "page", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(
        "page", *[zero(c).alias(c) for c in ("detector_regions", "observations", "matched")], F.try_divide(zero("matched"), F.col("detector_regions")).alias("coverage"),
        (zero("observations") - zero("detected")).alias("observations_without_detection"),
    )


def best_overlap(regions: DataFrame, observations: DataFrame, threshold: float = 0.25) -> DataFrame:
    """For each region the observation that overlaps it most, above a threshold; of equals the first. page, ord, obs_ord, iou."""
    pairs = overlapping(
        regions.select("page", "ord", "bbox"), observations.select("page", F.col("ord").alias("obs_ord"), F.col("bbox").alias("other")), iou(F.col("bbox"), F.col("other")) > threshold
    ).withColumn("iou", iou(F.col("bbox"), F.col("other")))
    return pairs.groupBy("page", "ord").agg(F.max(F.struct("iou", (-F.col("obs_ord")).alias("neg"))).alias("m")).select("page", "ord", (-F.col("m.neg")).alias("obs_ord"), "m.iou")


def suppressed(boxes: DataFrame, threshold: float, on: tuple[str, ...] = ()) -> DataFrame:
    """page, ord of the boxes (page, ord, score, bbox) that greedy suppression drops: by score, then ord, a box stays if it
    overlaps none that stays by more than a threshold of IoU. on: columns in which two boxes must agree to compete.

    A dropped box drops no other, so no plain anti-join will do. Only boxes that overlap another above the threshold need
    the fold; it streams over those pairs, page by page, in order.
    """
    b = boxes.select("page", *on, F.col("ord").alias("b_ord"), F.col("score").alias("b_score"), F.col("bbox").alias("other"))
    first = (F.col("b_score") > F.col("score")) | ((F.col("b_score") == F.col("score")) & (F.col("b_ord") < F.col("ord")))
    edges = overlapping(boxes.select("page", *on, "ord", "score", "bbox"), b, first & (iou(F.col("bbox"), F.col("other")) > threshold), on=on).select("page", "ord", "score", "b_ord", "b_score")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Dropped boxes: in order, those with an edge to one that stays. What comes before a box is decided already."""
        page, dropped = None, set()
        for batch in batches:
            out = []
            for p, o, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != page:
                    page, dropped = p, set()
                if before not in dropped and o not in dropped:
                    dropped.add(o)
                    out.append((p, o))
            yield _rows(out, batch.schema.field(0).type, ["page", "ord"])

    in_order = edges.repartition("page").sortWithinPartitions("page", F.desc("score"), "ord").select("page", "ord", "b_ord")
    return in_order.mapInArrow(fold, f"page {boxes.schema['page'].dataType.simpleString()}, ord bigint")


def suppress_overlaps(regions: DataFrame, threshold: float = 0.4) -> DataFrame:
    """regions without those that greedy suppression drops."""
    return regions.join(suppressed(regions, threshold), ["page", "ord"], "left_anti")


def greedy_pairs(options: DataFrame, group: list[str], a: str, b: str, *better: Column) -> DataFrame:
    """group, a, b: one-to-one pairs out of options (group, a, b, ...): in order of a, each takes the first b that is not yet
    taken, in the order `better`, then b. A unit of work is a group, streamed in order; only the b taken in it are held."""
    in_order = options.repartition(*group).sortWithinPartitions(*group, a, *better, b).select(F.to_json(F.struct(*group)).alias("g"), *group, a, b)
    schema = in_order.drop("g").schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, last = None, set(), None
        for batch in batches:
            keep = []
            for i, (g, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(len(group) + 1).to_pylist(), batch.column(len(group) + 2).to_pylist(), strict=True)):
                if g != now:
                    now, used, last = g, set(), None
                if x != last and y not in used:
                    used.add(y)
                    last = x
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).drop_columns(["g"])

    return in_order.mapInArrow(fold, schema)


def greedy_match(first: DataFrame, second: DataFrame, threshold: float = 0.20) -> DataFrame:
    """One-to-one matches: in order of `first`, each takes the box of `second` not yet taken that it overlaps most, at least
    by a threshold of IoU; of equals the first. page, a_ord, b_ord, iou. Any overlap competes; the threshold only decides
    whether the best counts."""
    pairs = overlapping(
        first.select("page", F.col("ord").alias("a_ord"), "bbox"), second.select("page", F.col("ord").alias("b_ord"), F.col("bbox").alias("other")), iou(F.col("bbox"), F.col("other")) >= threshold
    ).select("page", "a_ord", "b_ord", "bbox", "other")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, used, last = None, set(), None
        for batch in batches:
            out = []
            for p, a, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != page:
                    page, used, last = p, set(), None
                if a != last and b not in used:
                    used.add(b)
                    out.append((p, a, b, v))
                    last = a
            yield _rows(out, batch.schema.field(0).type, ["page", "a_ord", "b_ord", "iou"])

    # The measure is taken after the shuffle: with the join's condition in one method it would be too long to be compiled.
    measured = pairs.repartition("page").select("page", "a_ord", "b_ord", iou(F.col("bbox"), F.col("other")).alias("iou"))
    in_order = measured.sortWithinPartitions("page", "a_ord", F.desc("iou"), "b_ord")
    return in_order.mapInArrow(fold, f"page {first.schema['page'].dataType.simpleString()}, a_ord bigint, b_ord bigint, iou double")


def in_any_zone(zones: Column, b: Column, kinds: list[str] | None = None) -> Column:
    """b's centre lies in one of the zones (array<struct<kind, bbox>>), of certain kinds if given."""
    test = lambda z: centre_inside(b, z["bbox"]) if kinds is None else z["kind"].isin(kinds) & centre_inside(b, z["bbox"])
    return F.coalesce(F.exists(zones, test), F.lit(False))


def first_zone(zones: Column, b: Column) -> Column:
    """The first zone that holds b's centre, or null."""
    return F.get(F.filter(zones, lambda z: centre_inside(b, z["bbox"])), F.lit(0))


def touching(a: list, b: list, threshold: float, most: int = 1 << 20) -> Iterator[tuple]:
    """i, j, iou (arrays) of the boxes a and b (four arrays each: x0, y0, x1, y1) that overlap at least by a threshold of IoU:
    a sweep down the page, up to about `most` pairs at a time."""
    order = np.argsort(b[1], kind="stable")
    b = [c[order] for c in b]
    tallest = max(0, int((b[3] - b[1]).max(initial=0)))
    lo = np.searchsorted(b[1], a[1] - tallest, "right")
    n = np.maximum(np.searchsorted(b[1], a[3], "left") - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + most, "right")))
        part = n[start:stop]
        i = np.repeat(np.arange(start, stop), part)
        j = np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(lo[start:stop], part)
        w = np.minimum(a[2][i], b[2][j]) - np.maximum(a[0][i], b[0][j])
        i, j, w = i[w > 0], j[w > 0], w[w > 0]
        common = w * np.maximum(np.minimum(a[3][i], b[3][j]) - np.maximum(a[1][i], b[1][j]), 0)
        i, j, common = i[common > 0], j[common > 0], common[common > 0]
        union = (a[2][i] - a[0][i]) * (a[3][i] - a[1][i]) + (b[2][j] - b[0][j]) * (b[3][j] - b[1][j]) - common
        share = np.divide(common, union, out=np.zeros(len(i)), where=union != 0)
        near = share >= threshold
        yield i[near], order[j[near]], share[near]
        start = stop


def pairs_of_page(a: pa.Table, b: pa.Table, threshold: float) -> list[tuple[int, int, float]]:
    """greedy_match of one page's readings (ord, bbox): places in a and b, iou. A reading without a box matches none."""

    def boxes(t: pa.Table) -> tuple[list, np.ndarray]:
        box = t.column("bbox").combine_chunks()
        sides = [pc.struct_field(box, s) for s in ("x0", "y0", "x1", "y1")]
        known = np.logical_and.reduce([s.is_valid().to_numpy(zero_copy_only=False) for s in sides])
        return [pc.fill_null(s, 0).to_numpy(zero_copy_only=False).astype(np.int64)[known] for s in sides], np.flatnonzero(known)

    (at, a_row), (bt, b_row) = boxes(a), boxes(b)
    if not len(a_row) or not len(b_row):
        return []
    i, j, share = (np.concatenate(x) for x in zip(*touching(at, bt, threshold), strict=True))
    i, j = a_row[i], b_row[j]
    a_ord, b_ord = (t.column("ord").to_numpy()[k] for t, k in ((a, i), (b, j)))
    best = np.lexsort((b_ord, -share, a_ord))
    taken, used, out = set(), set(), []
    for x, y, v in zip(i[best].tolist(), j[best].tolist(), share[best].tolist(), strict=True):
        if x not in taken and y not in used:
            taken.add(x)
            used.add(y)
            out.append((x, y, v))
    return out
