"""Token counts of flat, unindexed token files by a scan for separators.

A token file is the ids of document after document, each ended by one end-of-document id, with no index. It is read in blocks
of bytes that know nothing of documents. A vectorised search gives the separators of each block; a prefix scan over the blocks
of a file then knows, for each block, how many documents ended before it and how many tokens of its first document stand in
earlier blocks. The scan runs over superblocks first and then inside each, so no task sees all blocks of a large file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm import words as W
from drawlake.llm.common import cut, ship, tidy

DTYPE = "<u2"
END = 65_535  # id of the end of a document
BLOCK_TOKENS = 1 << 16
SUPER = 256  # blocks of a superblock
SPLIT = 128 << 20  # bytes of a file that stay together


def _openable(path: str) -> bool:
    """Whether workers can open a path of this scheme by themselves."""
    try:
        FileSystem.from_uri(_uri(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def read_files(spark: SparkSession, path: str, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data of token files at a path that Spark reads.

    Spark only lists the files; each block is a range of bytes that the task it falls to reads by itself, SPLIT bytes of a
    file to a task or a few, so a file may be of any size and a lost task reads its ranges again. Where workers can't open
    the paths' scheme, Spark hands files over whole, and one may hold 2 GB. An empty file has one empty block; no file, no
    blocks.
    """
    ship(spark)
    step = block_tokens * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path)
    some = files.select("path").first()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    system, place = FileSystem.from_uri(_uri(name))
                    now, file = name, system.open_input_file(place)
                data = file.read_at(step, block * step)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(data.as_buffer())
                for i, a in enumerate(range(0, max(len(view), 1), step)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([bytes(view[a : a + step])], pa.binary())], names=["file", "block", "data"])

    schema = "file string, block long, data binary"
    if some is not None and not _openable(some["path"]):
        return files.select("path", "content").mapInArrow(tidy(whole), schema)
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / step)
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    dealt = blocks.repartition("path", F.floor(F.col("block") / max(1, SPLIT // step))).sortWithinPartitions("path", "block")
    return dealt.mapInArrow(tidy(ranges), schema)


def separators(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """file, block, size, ends, head, last, inner: per block its tokens, its separators, the tokens before the first, the
    place of the last, and the tokens between each two."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype) if data.is_valid else np.zeros(0, dtype)
                at = np.flatnonzero(ids == end)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, np.diff(at) - 1))
            size, ends, head, last, inner = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(ends, pa.int64()), pa.array(head, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "size", "ends", "head", "last", "inner"],
            )

    return blocks.select(F.col("file").cast("string"), F.col("block").cast("long"), "data").mapInArrow(
        tidy(run), "file string, block long, size long, ends long, head long, last long, inner array<long>"
    )


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """file, ordinal, n_tokens (long), ended (boolean): a row per document of blocks (file, block, data), whose numbers run
    from 0 without gaps in each file.

    The separator is not counted. Two separators in a row hold an empty document. Tokens after the last separator of a
    file are a document that has not ended; a file that ends on a separator, and an empty file, have none. A null block is
    empty. No blocks give no rows.
    """
    seen = cut(separators(blocks, end, dtype).withColumn("super", F.floor(F.col("block") / SUPER)))
    before_super = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Inside a superblock: tokens and documents before each block, and the place of the last separator before it.
    local = seen.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("ended", F.coalesce(F.sum("ends").over(inside), F.lit(0)))
    local = local.withColumn("latest", F.max(F.col("at") + F.col("last")).over(inside))
    supers = seen.groupBy("file", "super").agg(
        F.sum("size").alias("sizes"), F.sum("ends").alias("all_ends"), F.max(F.when(F.col("ends") > 0, F.struct("block", "last"))).alias("final")
    )
    tails = local.where(F.col("ends") > 0).groupBy("file", "super").agg(F.max(F.col("at") + F.col("last")).alias("final_at"))
    supers = supers.drop("final").join(tails, ["file", "super"], "left")
    supers = supers.withColumn("base", F.coalesce(F.sum("sizes").over(before_super), F.lit(0))).withColumn("base_ends", F.coalesce(F.sum("all_ends").over(before_super), F.lit(0)))
    supers = supers.withColumn("base_latest", F.max(F.col("base") + F.col("final_at")).over(before_super))
    # Over the file: start of the block, and start of the document that is open there.
    placed = cut(
        local.join(supers.select("file", "super", "base", "base_ends", "base_latest"), ["file", "super"])
        .withColumn("start", F.col("base") + F.col("at"))
        .withColumn("open", F.coalesce(F.col("base") + F.col("latest"), F.col("base_latest"), F.lit(-1)) + 1)
        .withColumn("first", F.col("base_ends") + F.col("ended"))
        .drop("at", "latest", "base", "base_latest", "base_ends")
    )
    sizes = F.concat(F.array(F.col("start") - F.col("open") + F.col("head")), F.col("inner"))
    done = (
        placed.where(F.col("ends") > 0)
        .select("file", "first", F.posexplode(sizes).alias("i", "n_tokens"))
        .select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    )
    per_file = placed.groupBy("file").agg(
        F.sum("size").alias("size"), F.sum("ends").alias("ends"), F.max(F.greatest(F.col("open"), F.coalesce(F.col("start") + F.col("last") + 1, F.lit(0)))).alias("open")
    )
    rest = per_file.where(F.col("size") > F.col("open")).select("file", F.col("ends").alias("ordinal"), (F.col("size") - F.col("open")).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(rest)


def flat_stream(docs: DataFrame, text: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Texts as flat token blocks (file, block, data), a file per task, and the order they were written in (file, ordinal,
    doc_id). A token is a word; its id a hash of it below END. Both come from one pass that is materialised. Null texts are
    empty documents; an empty table makes no file."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, ordinal = str(TaskContext.get().partitionId()), 0, 0
        left = np.zeros(0, DTYPE)

        def written(data: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal block
            n = len(data)
            block += n
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n), pa.array(range(block - n, block), pa.int64()), pa.array([x.tobytes() for x in data], pa.binary()), pa.nulls(n, pa.int64())], names=["file", "number", "data", "doc_id"]
            )

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                found, at = W.hashes(batch.column(1).slice(a, 512).to_pylist())
                n = len(at) - 1
                ids = (found % np.uint64(END)).astype(DTYPE)
                left = np.concatenate([left, np.insert(ids, at[1:], np.array(END, DTYPE))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.nulls(n, pa.binary()), batch.column(0).slice(a, n)], names=["file", "number", "data", "doc_id"]
                )
                ordinal += n
                full = len(left) // block_tokens
                if full:
                    yield written([left[i * block_tokens : (i + 1) * block_tokens] for i in range(full)])
                    left = left[full * block_tokens :]
        if len(left):
            yield written([left])

    both = cut(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "file string, number long, data binary, doc_id long"))
    blocks = both.where(F.col("data").isNotNull()).select("file", F.col("number").alias("block"), "data")
    return blocks, both.where(F.col("data").isNull()).select("file", F.col("number").alias("ordinal"), "doc_id")


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every document, by writing the texts as a flat token stream and scanning it.

    A null or empty text has no tokens; a null doc_id stays null; repeated rows are documents of their own; an empty table
    gives no rows. Only doc_id and text are read.
    """
    blocks, order = flat_stream(docs)
    return count_tokens(blocks).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")


SQL = r"""
select doc_id, cast(coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), 0) as bigint) as n_tokens from documents
"""
