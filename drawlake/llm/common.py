"""What the operators of this subpackage share: reading tables, shipping code, cutting lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.sources.scratch import cut, shared_folder  # noqa: F401

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name. Only Spark's reader touches the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give Python workers this package once per application, so that functions pickled by reference resolve."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == "10000":  # Spark's default: ten thousand long texts in one batch would not fit
        spark.conf.set(_BATCH_ROWS, "1000")
    if getattr(sc, "_drawlake_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="drawlake"))
    archive = os.path.join(folder, "drawlake_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(archive)
    sc._drawlake_shipped = True


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow; when a task is over, the memory it freed goes back to the system. Workers outlive tasks, and several
    idle ones share an executor's memory with the one that runs."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def drop_if_there(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that the operator is about to write itself."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
