"""Answers held against a sparse key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.functions.text import key as norm


def documents_of_sheets(contexts: DataFrame, answer_key: DataFrame) -> DataFrame:
    """page, document_id: the key's document with the sheet's number, the lowest if several; sheets without one are left out."""
    pids = answer_key.where("category = 'pid'").groupBy(norm(F.col("value")).alias("k")).agg(F.min("document_id").alias("document_id"))
    sheets = contexts.where(F.coalesce(F.col("sheet_id"), F.lit("")) != "").select("page", norm(F.col("sheet_id")).alias("k"))
    return sheets.join(pids, "k").select("page", "document_id")


def score_categories(answers: DataFrame, answer_key: DataFrame, pages: DataFrame) -> DataFrame:
    """page, category, in_key, expected, got, found, missed, extra, cleanup_only (arrays), recall.

    pages: page, document_id. Values compare by capitals and digits; cleanup_only lists matches that hold only so. Of a
    category that the key lacks, everything is extra and recall is null.
    """
    given = answers.join(pages.select("page"), "page", "left_semi").select("page", "category", "value", F.lit(False).alias("keyed"))
    rows = pages.join(answer_key, "document_id").select("page", "category", "value", F.lit(True).alias("keyed")).unionByName(given)
    side = lambda c: F.collect_list(F.when(c, F.col("value")))
    # Values that compare equal meet in one small group; what is found, missed or extra is decided there.
    met = rows.groupBy("page", "category", norm(F.col("value")).alias("k")).agg(side(F.col("keyed")).alias("e"), side(~F.col("keyed")).alias("g"))
    none = F.array().cast("array<string>")
    met = met.withColumn("found", F.when(F.size("g") > 0, F.col("e")).otherwise(none)).withColumn("raw", F.transform("g", lambda v: F.trim(v)))
    parts = {
        "expected": F.col("e"), "got": F.col("g"), "found": F.col("found"), "missed": F.when(F.size("g") == 0, F.col("e")).otherwise(none),
        "extra": F.when(F.size("e") == 0, F.col("g")).otherwise(none), "cleanup_only": F.filter("found", lambda v: ~F.array_contains("raw", F.trim(v))),
    }
    whole = met.select("page", "category", *[c.alias(n) for n, c in parts.items()]).groupBy("page", "category")
    sets = whole.agg(*[F.array_sort(F.flatten(F.collect_list(n))).alias(n) for n in parts])
    return sets.select("page", "category", (F.size("expected") > 0).alias("in_key"), *parts, F.try_divide(F.size("found"), F.size("expected")).alias("recall"))


def totals(categories: DataFrame, by: list[str] | None = None) -> DataFrame:
    """matched, missed, extra, exact_matched, cleanup_only_matched, recall, key_precision, per page unless told otherwise. Only
    categories of the key count."""
    n = lambda c: F.sum(F.size(c)).cast("long")
    grouped = categories.where("in_key").groupBy(*(["page"] if by is None else by))
    out = grouped.agg(n("found").alias("matched"), n("missed").alias("missed"), n("extra").alias("extra"), n("cleanup_only").alias("cleanup_only_matched"))
    return out.withColumn("exact_matched", F.col("matched") - F.col("cleanup_only_matched")).withColumns(
        {"recall": F.try_divide(F.col("matched"), F.col("matched") + F.col("missed")), "key_precision": F.try_divide(F.col("matched"), F.col("matched") + F.col("extra"))}
    )


def extra_values(categories: DataFrame) -> DataFrame:
    """page, category, value, expected_n: given but not in the key."""
    return categories.select("page", "category", F.explode("extra").alias("value"), F.size("expected").alias("expected_n"))


def health(page_totals: DataFrame, coverage: DataFrame) -> DataFrame:
    """The figures of a page in one row."""
    return page_totals.join(coverage, "page", "left")


def report_text(categories: DataFrame, page_totals: DataFrame, coverage: DataFrame) -> DataFrame:
    """page, report: recall and coverage, a line per category of the key, and how many values the key doesn't know."""
    from drawlake.functions.values import percent

    n = lambda c: F.size(c).cast("string")
    line = F.concat(F.col("category"), F.lit(": "), n("found"), F.lit("/"), n("expected"), F.when(F.size("missed") > 0, F.concat(F.lit(", missed "), F.array_join("missed", " | "))).otherwise(F.lit("")))
    noise = F.sum(F.when(~F.col("in_key"), F.size("got")).otherwise(F.size("extra")))
    lines = categories.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("in_key"), F.struct("category", line.alias("line"))))).alias("l"), noise.cast("string").alias("noise"))
    joined = page_totals.join(lines, "page").join(coverage, "page", "left")
    head = F.concat(F.lit("recall "), percent(F.col("recall")), F.lit(", coverage "), percent(F.col("coverage")))
    return joined.select("page", F.concat_ws("\n", head, F.array_join(F.col("l.line"), "\n"), F.concat(F.lit("not in the key: "), F.col("noise"))).alias("report"))
