"""Visual checks of readings: which to ask, what is known, and flag letters of connectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import text as X
from drawlake.functions.geometry import manhattan
from drawlake.operators.rules import RuleSet, all_match

FLAG_GRID = 50


def questions(ruleset: RuleSet) -> dict[str, str]:
    """category -> question of the rules that ask one."""
    return {r["category"]: r["verify"]["question"] for r in ruleset.rules if r.get("verify")}


def candidates(observations: DataFrame, ruleset: RuleSet) -> DataFrame:
    """page, category, tag_key, question_hash and the reading to ask about: per rule and tag the most confident, the first of equals."""
    parts = []
    for i, rule in enumerate(ruleset.rules):
        if rule.get("verify"):
            hits = observations.where(all_match(rule.get("when")) & (X.key(F.col("text")) != ""))
            parts.append(hits.select("*", F.lit(i).alias("rule"), F.lit(rule["category"]).alias("category"), X.hash_id(F.lit(rule["verify"]["question"])).alias("question_hash")))
    if not parts:
        raise ValueError("no rule asks a question")
    both = reduce(DataFrame.unionByName, parts).withColumn("tag_key", X.tag_key(F.col("category"), F.col("text")))
    best = F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("o1"), "rule", "ord", "question_hash", "text", "bbox", "confidence"))
    return both.groupBy("page", "category", "tag_key").agg(best.alias("b")).select("page", "category", "tag_key", "b.question_hash", "b.ord", "b.text", "b.bbox", "b.confidence", "b.rule")


def current(verdicts: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Verdicts on the questions that the rules ask now."""
    known = [F.struct(F.lit(c).alias("c"), X.hash_id(F.lit(q)).alias("h")) for c, q in questions(ruleset).items()]
    if not known:
        return verdicts.where("false")
    return verdicts.where(F.exists(F.array(*known), lambda k: (k["c"] == F.substring_index("tag_key", "|", 1)) & (k["h"] == F.col("question_hash"))))


def todo(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates without a verdict on their question."""
    return asked.join(verdicts.select("page", "tag_key", "question_hash").distinct(), ["page", "tag_key", "question_hash"], "left_anti")


def verdict_counts(verdicts: DataFrame, asked: DataFrame) -> DataFrame:
    """page, yes, no, missing. Both sides grow with the pages; a cache's compressed size says little about its rows, so it isn't broadcast."""
    joined = asked.join(verdicts.select("page", "tag_key", "question_hash", "answer").hint("merge"), ["page", "tag_key", "question_hash"], "left")
    yes = F.coalesce(F.col("answer") == "yes", F.lit(False))
    return joined.groupBy("page").agg(F.count_if(yes).alias("yes"), F.count_if(F.col("answer").isNotNull() & ~yes).alias("no"), F.count_if(F.col("answer").isNull()).alias("missing"))


def flag_jobs(provenance: DataFrame, observations: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Values of connector categories that lack their flag letter: page, category, value, number, rest, box, key. The box is the
    nearest connector's of the same number, by distance of centres and then ord, else the value's own."""
    cats = sorted({r["category"] for r in ruleset.rules if r.get("read_flag_letter")})
    pattern = r"^(\d{4,6})\b(.*)$"
    bare = provenance.where(F.col("category").isin(cats) & F.rlike("value", F.lit(pattern))).select(
        "page", "category", "value", "bbox", F.regexp_extract("value", pattern, 1).alias("number"), F.regexp_extract("value", pattern, 2).alias("rest")
    )
    connectors = observations.where("kind = 'continuation_connection'").select("page", X.key(F.col("text")).alias("number"), F.col("bbox").alias("other"), F.col("ord").alias("c_ord"))
    near = bare.join(connectors, ["page", "number"]).withColumn("d", manhattan(F.col("other"), F.col("bbox")))
    nearest = near.groupBy("page", "category", "value").agg(F.min(F.struct("d", "c_ord", "other")).alias("c")).select("page", "category", "value", F.col("c.other").alias("connector"))
    jobs = bare.join(nearest, ["page", "category", "value"], "left").withColumn("box", F.coalesce("connector", "bbox"))
    cell = lambda side: F.floor(F.col("box")[side] / FLAG_GRID).cast("string")
    return jobs.withColumn("key", F.concat_ws("|", "category", "number", cell("x0"), cell("y0"))).drop("connector", "bbox")


def with_letters(answers: DataFrame, jobs: DataFrame, flags: DataFrame) -> DataFrame:
    """answers with the letters that were read put before their numbers; values that become equal are one."""
    letter = F.upper(F.trim("letter"))
    read = jobs.join(flags.select("page", "key", "letter"), ["page", "key"]).where(X.is_one_letter(letter)).select("page", "category", "value", F.concat(letter, "number", "rest").alias("renamed"))
    return answers.join(read, ["page", "category", "value"], "left").select("page", "category", F.coalesce("renamed", "value").alias("value")).distinct()


def best_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row per key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def checked(asked: DataFrame, cache: DataFrame | None, ask, path: str) -> DataFrame:
    """Verdicts on all that is asked: those of the cache, and of the rest what `ask` (a function of the candidates that lack
    one: page, category, tag_key, answer, question_hash) answers, which is appended to the cache at `path`."""
    left = asked if cache is None else todo(asked, cache)
    answered = ask(left).select("page", "category", "tag_key", "answer", "question_hash")
    answered.write.mode("append").parquet(path)
    spark = asked.sparkSession
    return spark.read.schema(answered.schema).parquet(path)
