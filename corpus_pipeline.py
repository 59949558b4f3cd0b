"""A corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes each stage's result as
Parquet in the folder that driver and executors share and reads it again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm import bpe, decontaminate, line_dedup, near_duplicates, toxicity
from drawlake.llm.common import shared_folder, table
from drawlake.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go.

    Null and empty texts, and rows of null doc_id, are scored like others and stay where nothing speaks against them. Equal
    rows go or stay together. Columns, whatever their names, and types are kept; an empty table gives an empty one.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars, if there, follows the text. Every document stays, if with an empty text.

    Equal texts of a host count as one page: one of them is to stay after near duplicates, with its lines. Null texts stay
    null, with n_chars null; rows of a null source are one host; equal rows stay equal. Extra columns pass through whatever
    their names, n_lines and n_dropped among them; an empty table gives an empty one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    out = line_dedup.drop_boilerplate(docs.toDF(*names), host=at["source"], text=at["text"])
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id; of its repeated rows, one.

    Documents without words (null and empty texts) and of null doc_id are no copies of anything and all stay, but for
    repeated rows of one doc_id. Columns are kept; an empty table gives an empty one.
    """
    return near_duplicates.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; equal rows go or stay together; columns, whatever their names, are kept; an empty table, or
    an empty benchmark, loses nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text they decode to, as counts and digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per row; a null text is empty and has no tokens; an empty table gives no rows. Other columns are not read.
    """
    return bpe.digests(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Toxicity, alignment and BPE have no form in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
