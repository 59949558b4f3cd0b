"""Readings of pages to answers: confidence floor, prose zones, seam duplicates, rules, first value per category."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import text as X
from drawlake.operators.rules import RuleSet, applied
from drawlake.operators.spatial import CELL, in_any_zone
from drawlake.sources.scratch import cut, stored

SEAM_IOU = 0.25
NOT_EQUIPMENT = ["annotation", "line_label", "other"]


@dataclass
class Resolved:
    """tagged: every reading with its flags; unique: readings left after dedupe, with what the rules made of them; the rest
    are results by page."""

    tagged: DataFrame
    unique: DataFrame
    provenance: DataFrame
    answers: DataFrame
    audit: DataFrame
    unclaimed: DataFrame


def legend_codes(prefixes: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(prefixes, lambda p: F.upper(F.trim(F.coalesce(p["code"], F.lit(""))))), lambda c: c != ""))


def flagged(observations: DataFrame, contexts: DataFrame, ruleset: RuleSet) -> DataFrame:
    """observations plus low (under the floor), suppressed (in a prose zone), codes and sheet_id of their page. A missing
    confidence counts as 1 here."""
    pages = contexts.select("page", "suppress_regions", "sheet_id", legend_codes(F.col("system_prefixes")).alias("codes"))
    low = F.coalesce(F.col("confidence"), F.lit(1.0)) < F.lit(ruleset.min_confidence)
    zone = in_any_zone(F.col("suppress_regions"), F.col("bbox"), ruleset.suppress_region_kinds) if ruleset.suppress_region_kinds else F.lit(False)
    return observations.join(pages, "page", "left").withColumn("low", low).withColumn("suppressed", ~F.col("low") & zone).drop("suppress_regions")


def drop_seam_copies(df: DataFrame, norm: Column, threshold: float = SEAM_IOU) -> DataFrame:
    """Greedy: by confidence (missing as 0), then ord, a reading stays unless it overlaps one of equal text that stays.

    One shuffle on the page, none if they are dealt by page already; rows stream through in order, and of a text that fills a page only the boxes that
    stay are held, by the cells that they touch.
    """
    keyed = df.withColumns({"norm_text_": norm, "score_": F.coalesce(F.col("confidence"), F.lit(0.0))})
    in_order = keyed.repartition("page").sortWithinPartitions("page", "norm_text_", F.desc("score_"), "ord")
    new = F.struct("page", "norm_text_")
    at = df.columns.index("bbox")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(len(df_columns)).to_pylist()
            box = batch.column(at)
            x0, y0, x1, y1 = (box.field(i).to_pylist() for i in range(4))
            stays = []
            for i, g in enumerate(groups):
                g = (g["page"], g["norm_text_"])
                if g != last:
                    last, held = g, {}
                one = (x0[i], y0[i], x1[i], y1[i])
                if None in one:  # a reading without a box overlaps nothing
                    stays.append(True)
                    continue
                cells = [(cx, cy) for cx in range(one[0] // CELL, one[2] // CELL + 1) for cy in range(one[1] // CELL, one[3] // CELL + 1)]
                alone = not any(box_iou(other, one) > threshold for c in cells for other in held.get(c, ()))
                if alone:
                    for c in cells:
                        held.setdefault(c, []).append(one)
                stays.append(alone)
            yield batch.filter(pa.array(stays)).drop_columns(["group_"])

    df_columns = df.columns
    return in_order.select(*df_columns, new.alias("group_")).mapInArrow(fold, df.schema)


def box_iou(a: tuple, b: tuple) -> float:
    """The overlap of two boxes over their union, as functions.geometry.iou has it for columns."""
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if both and union else 0.0


def verdict_maps(verdicts: DataFrame) -> DataFrame:
    """page, tag, verdicts: per tag of a page a map category -> whether the check said yes."""
    pair = F.struct(F.col("category"), (F.col("answer") == "yes").alias("yes"))
    return verdicts.groupBy("page", F.substring_index("tag_key", "|", -1).alias("tag")).agg(F.map_from_entries(F.array_distinct(F.collect_list(pair))).alias("verdicts"))


def resolve(observations: DataFrame, contexts: DataFrame, ruleset: RuleSet, verdicts: DataFrame | None = None, keep: bool = False, keep_unique: bool = True) -> Resolved:
    """The whole plan. observations and contexts as in schemas; verdicts only of the questions that the rules ask now. keep
    materialises the deduped readings and the provenance, for callers that use several results; without keep_unique only the
    provenance, for those that use nothing else of the readings."""
    tagged = flagged(observations, contexts, ruleset)
    kept = tagged.where(~F.col("low") & ~F.col("suppressed")).drop("low", "suppressed")
    unique = drop_seam_copies(kept, ruleset.norm(F.col("text")))
    checks = None
    if verdicts is not None:
        maps = verdict_maps(verdicts).withColumnRenamed("page", "v_page")
        unique = unique.join(maps, (F.col("page") == F.col("v_page")) & (X.key(F.col("text")) == F.col("tag")), "left").drop("v_page", "tag")
        checks = F.col("verdicts")
    unique = unique.withColumn("applied", applied(ruleset, F.col("codes"), checks))
    if keep and keep_unique:
        unique = cut(unique)
    values = unique.select("*", F.explode("applied").alias("a")).select("*", "a.rule", "a.category", F.explode("a.values").alias("value"))
    first = F.struct(
        F.col("rule"), (-F.coalesce(F.col("confidence"), F.lit(0.0))).alias("o1"), F.col("ord"), F.col("bbox"), F.col("text"), F.col("symbol"), F.col("confidence"), F.col("tile_id")
    )
    provenance = values.groupBy("page", "category", "value").agg(F.min(first).alias("f")).select(
        "page", "category", "value", "f.bbox", "f.text", "f.symbol", "f.confidence", "f.tile_id", "f.rule", "f.ord"
    )
    if keep:
        provenance = cut(provenance) if keep_unique else stored(provenance)
    pid = contexts.where(F.coalesce(F.col("sheet_id"), F.lit("")) != "").select("page", F.lit("pid").alias("category"), ruleset.norm(F.col("sheet_id")).alias("value"))
    answers = provenance.select("page", "category", "value").unionByName(pid)
    unclaimed = unique.where((F.size("applied") == 0) & (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "")).select(
        "page", "ord", "text", "kind", "symbol", "attached_to", "bbox", "tile_id", "confidence"
    )
    return Resolved(tagged, unique, provenance, answers, audit(tagged, unique), unclaimed)


def audit(tagged: DataFrame, unique: DataFrame) -> DataFrame:
    """page, input, low_confidence, suppressed, duplicates, resolved, unclaimed."""
    count = lambda c: F.count_if(c)
    before = tagged.groupBy("page").agg(F.count(F.lit(1)).alias("input"), count(F.col("low")).alias("low_confidence"), count(F.col("suppressed")).alias("suppressed"))
    after = unique.groupBy("page").agg(
        F.count(F.lit(1)).alias("resolved"), count((F.size("applied") == 0) & (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "")).alias("unclaimed")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return before.join(after, "page", "left").select(
        "page", "input", "low_confidence", "suppressed",
        (F.col("input") - F.col("low_confidence") - F.col("suppressed") - zero("resolved")).alias("duplicates"),
        zero("resolved").alias("resolved"), zero("unclaimed").alias("unclaimed"),
    )


def answer_lists(answers: DataFrame) -> DataFrame:
    """page, category, values: sorted."""
    return answers.groupBy("page", "category").agg(F.array_sort(F.collect_set("value")).alias("values"))


def answer_maps(answers: DataFrame) -> DataFrame:
    """page, answers: one map of sorted lists per page."""
    lists = answer_lists(answers)
    return lists.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "values")))).alias("answers"))


def unclassified(unclaimed: DataFrame) -> DataFrame:
    """Unclaimed readings that look like tags of equipment, one per text whatever its case; no. is their place on the page,
    by kind, then text."""
    t = X.squeeze(F.col("text"))
    rows = unclaimed.withColumn("text", t).where(
        ~F.coalesce(F.col("kind"), F.lit("")).isin(NOT_EQUIPMENT) & X.has_tag_shape(F.col("text")) & ~F.rlike(F.replace(F.col("text"), F.lit(" ")), F.lit(r"^\d+$"))
    )
    first = F.struct((-F.coalesce(F.col("confidence"), F.lit(0.0))).alias("o1"), "ord", "text", "kind", "symbol", "attached_to", "bbox")
    one = rows.groupBy("page", F.upper("text").alias("u")).agg(F.min(first).alias("f")).select("page", "f.text", "f.kind", "f.symbol", "f.attached_to", "f.bbox", "u")
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.coalesce("kind", F.lit("")), "text", "u")) - 1
    return one.withColumn("no", place.cast("int")).drop("u")


def unclaimed_sample(unclaimed: DataFrame, most: int = 150) -> DataFrame:
    """Per page up to `most` unclaimed readings, one per text and kind, in input order: what a rule assistant is shown."""
    key = [F.col("page"), F.upper(F.trim(F.coalesce(F.col("text"), F.lit("")))), F.col("kind")]
    one = unclaimed.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where("n = 1")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("ord"))).where(F.col("n") <= most).drop("n")
