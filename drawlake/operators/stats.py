"""Rollups of reader calls and of finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars at prices per million tokens; null where a price is not known, so that an unpriced call never looks free."""
    return F.coalesce(input_tokens, F.lit(0)) / F.lit(1e6) * price_in + F.coalesce(output_tokens, F.lit(0)) / F.lit(1e6) * price_out


def priced(calls: DataFrame, models: DataFrame) -> DataFrame:
    """calls with cost from the catalogue; a model that it lacks leaves the cost null."""
    joined = calls.drop("cost").join(models.select("model", "price_in", "price_out"), "model", "left")
    return joined.withColumn("cost", call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"))).drop("price_in", "price_out")


def checked_models(names: DataFrame, models: DataFrame) -> DataFrame:
    """names (model) with their catalogue rows; a model that the catalogue lacks is an error."""
    return names.join(models.withColumnRenamed("model", "known"), F.col("model") == F.col("known"), "left").withColumn(
        "model", F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown model "), "model"))).otherwise(F.col("model"))
    ).drop("known")


def by_tier(models: DataFrame, tier: str) -> DataFrame:
    return models.where(F.col("tier") == tier)


def rollup_columns() -> list[Column]:
    error = F.coalesce(F.col("status") == "error", F.lit(False))
    return [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(error).alias("errors"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
        F.count_if(F.col("cost").isNull() & ~error).alias("unpriced_calls"),
        F.avg(F.coalesce("latency", F.lit(0.0))).alias("avg_latency"),
        F.avg("ttft").alias("avg_ttft"),
    ]


def layer_stats(calls: DataFrame) -> DataFrame:
    """Per layer: calls, errors, tokens, cost of the priced calls, unpriced calls, mean latency, mean time to the first token."""
    return calls.groupBy(F.coalesce("layer", F.lit("?")).alias("layer")).agg(*rollup_columns())


def layer_models(calls: DataFrame) -> DataFrame:
    """layer, models: distinct, in the order they were first called."""
    first = calls.where(F.col("model").isNotNull()).groupBy(F.coalesce("layer", F.lit("?")).alias("layer"), "model").agg(F.min("at").alias("at"))
    return first.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("at", "model"))).alias("m")).select("layer", F.col("m.model").alias("models"))


def total_cost(layers: DataFrame) -> DataFrame:
    """total_cost (of costs rounded by layer), total_calls, unpriced_calls."""
    return layers.agg(F.bround(F.sum(F.bround("cost", 4)), 4).alias("total_cost"), F.sum("calls").alias("total_calls"), F.sum("unpriced_calls").alias("unpriced_calls"))


def cost_or_null(calls: DataFrame, by: list[str]) -> DataFrame:
    """cost summed; null as soon as one call has none."""
    return calls.groupBy(*by).agg(F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.array_sort(F.collect_set("error")).alias("messages"),
    )


def newest_calls(calls: DataFrame, most: int = 40, ties: tuple[str, ...] = ("layer", "tile")) -> DataFrame:
    """A report of the last calls, newest first; of equal times by the columns `ties`, descending."""
    return calls.orderBy(F.desc("at"), *map(F.desc, ties)).limit(most)


def progress(calls: DataFrame, tie: str = "event_id") -> DataFrame:
    """calls with what had been done up to each of them, by layer: done, failed, tokens, spent (priced calls)."""
    w = Window.partitionBy("layer").orderBy("at", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(c).over(w)
    error = (F.coalesce(F.col("status") == "error", F.lit(False))).cast("long")
    return calls.withColumns({
        "done": total(F.lit(1).cast("long")), "failed": total(error), "tokens": total(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))), "spent": total(F.coalesce("cost", F.lit(0.0))),
    })


def figures(totals: DataFrame, coverage: DataFrame, audit: DataFrame, agreement: DataFrame) -> DataFrame:
    """A page's figures in one row, as a viewer's tiles show them: recall, key_precision, coverage, resolved, unclaimed,
    agreement_rate. A page is there if one of the four knows it."""
    out = audit.select("page", "resolved", "unclaimed").join(coverage.select("page", "coverage"), "page", "full")
    return out.join(totals.select("page", "recall", "key_precision"), "page", "full").join(agreement.select("page", "agreement_rate"), "page", "full")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each page."""
    names = [c for c in runs.columns if c not in ("page", "run_at")]
    return runs.groupBy("page").agg(F.max(F.struct("run_at", *names)).alias("r")).select("page", "r.*")


def recall_history(runs: DataFrame) -> DataFrame:
    """runs with previous (the last recall that was known before) and delta; runs of one time in the order of run_no, if there."""
    w = Window.partitionBy("page").orderBy("run_at", *[c for c in ("run_no",) if c in runs.columns]).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("previous", F.last("recall", ignorenulls=True).over(w)).withColumn("delta", F.col("recall") - F.col("previous"))


def report(runs: DataFrame) -> DataFrame:
    """matched, missed and recall over graded pages."""
    return runs.where(F.col("recall").isNotNull()).agg(F.sum("matched").alias("matched"), F.sum("missed").alias("missed")).withColumn(
        "recall", F.try_divide(F.col("matched"), F.col("matched") + F.col("missed"))
    )
