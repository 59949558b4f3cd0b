"""python -m drawlake resolve | score | report | history | snapshot | bench: queries over tables of readings."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake import schemas
from drawlake.operators import benchmarks, cascade, scoring, stats
from drawlake.operators.resolve import resolve, unclassified
from drawlake.sources import readers, writers


def snapshot(df: DataFrame, title: str) -> str:
    """A finished, small result as one HTML page that carries its rows as JSON."""
    rows = json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><pre id="out"></pre><script>const rows = {rows};\nout.textContent = JSON.stringify(rows, null, 1);</script>\n'


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    p = argparse.ArgumentParser(prog="drawlake")
    p.add_argument("what", choices=["resolve", "score", "report", "history", "snapshot", "bench"])
    p.add_argument("--observations", help="Parquet folder, or JSON caches (page*.json)")
    p.add_argument("--contexts")
    p.add_argument("--rules")
    p.add_argument("--key")
    p.add_argument("--runs")
    p.add_argument("--pages", type=int, nargs="*")
    p.add_argument("--to", help="folder for the answers, or file of a snapshot")
    p.add_argument("--second", help="readings of a second reader (Parquet): the two are reconciled first")
    p.add_argument("--rulings", help="a judge's rulings (Parquet) on what the two dispute")
    p.add_argument("--models", nargs="*", help="only readings of these models")
    p.add_argument("--document-id", type=int, help="score against this document of the key, whatever the sheet's number")
    p.add_argument("--fresh", action="store_true", help="forget what --to holds of the pages")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--configs", help="JSON file of a benchmark's configurations")
    p.add_argument("--results", help="Parquet folder of a benchmark's results")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.what == "bench":
        done = spark.read.parquet(a.results)
        out = benchmarks.todo(benchmarks.configs(spark, a.configs), a.pages or [], done).orderBy("config", "page") if a.configs else benchmarks.pivot(done, a.pages or []).orderBy("config")
    elif a.what in ("report", "history"):
        runs = readers.run_history(spark, a.runs, a.pages)
        out = stats.report(stats.latest_runs(runs)) if a.what == "report" else stats.recall_history(runs).orderBy("page", "run_at")
    else:
        obs = readers.cached_observations(spark, a.observations) if a.observations.endswith(".json") else spark.read.schema(schemas.OBSERVATIONS).parquet(a.observations)
        obs = obs.where(F.col("page").isin(a.pages)) if a.pages else obs
        obs = obs.where(F.col("model").isin(a.models)) if a.models else obs
        ctx = spark.read.schema(schemas.CONTEXTS).parquet(a.contexts)
        if a.second:
            compared = cascade.compare(obs, spark.read.schema(schemas.OBSERVATIONS).parquet(a.second))
            rulings = spark.read.schema(schemas.RULINGS).parquet(a.rulings) if a.rulings else spark.createDataFrame([], schemas.RULINGS)
            obs = cascade.merge(compared, cascade.disputes(compared, ctx), rulings).drop("source", "dispute", "claim_a", "claim_b")
        r = resolve(obs, ctx, readers.rules(spark, a.rules), keep=True)
        out = r.answers.orderBy("page", "category", "value")
        if a.what == "score":
            key = readers.answer_key(spark, a.key)
            sheets = scoring.documents_of_sheets(ctx, key) if a.document_id is None else ctx.select("page", F.lit(a.document_id).alias("document_id"))
            out = scoring.totals(scoring.score_categories(r.answers, key, sheets))
        elif a.what == "resolve" and a.to:
            if a.fresh:
                for name in ("answers", "unclassified", "audit"):
                    writers.drop_pages(spark, f"{a.to}/{name}", [x[0] for x in ctx.select("page").distinct().collect()])
            writers.write_answers(r.answers, ctx, f"{a.to}/answers")
            unclassified(r.unclaimed).write.mode("overwrite").json(f"{a.to}/unclassified")
            r.audit.write.mode("overwrite").json(f"{a.to}/audit")
    if a.what == "snapshot":
        with open(a.to, "w", encoding="utf-8") as f:
            f.write(snapshot(out, "answers"))
    elif not a.quiet:
        out.show(1000, truncate=False)
    return out


if __name__ == "__main__":
    main()
