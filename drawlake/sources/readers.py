"""Sources: files of pages, caches of layers, keys, rules, and readers that turn images into rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake import schemas
from drawlake.functions import text as X
from drawlake.functions.geometry import from_tile, reader_scale
from drawlake.operators.rules import RuleSet
from drawlake.sources.scratch import cut

# Extensions by what reads them, and shares of the page that tell a scan.
PDF, IMAGES = [".pdf"], [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
SCAN_SHARE, SCAN_SHARE_WITHOUT_TEXT = 0.90, 0.50


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of files; content is only read if it is used."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a landing folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)


def with_format(df: DataFrame, path: str = "path") -> DataFrame:
    """df plus format: pdf or image by extension; another extension is an error."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return df.withColumn(
        "format", F.when(ext.isin(PDF), "pdf").when(ext.isin(IMAGES), "image").otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.col(path))).cast("string"))
    )


def page_method(images: DataFrame) -> DataFrame:
    """page, method of pages by their images (page, page_area, image_area, text_chars): a scan if the largest image covers
    nearly all of it, or half of it without a text layer; else digital."""
    per = images.groupBy("page").agg(F.coalesce(F.try_divide(F.max("image_area"), F.max("page_area")), F.lit(0.0)).alias("share"), F.coalesce(F.max("text_chars"), F.lit(0)).alias("chars"))
    scan = (F.col("share") >= SCAN_SHARE) | ((F.col("share") >= SCAN_SHARE_WITHOUT_TEXT) & (F.col("chars") == 0))
    return per.select("page", F.when(scan, "scan").otherwise("digital").alias("method"))


def frames(df: DataFrame, column: str = "frames") -> DataFrame:
    """One row per frame of a multi-frame image."""
    return df.select("*", F.posexplode(column).alias("source_page_index", "frame")).drop(column)


def next_page(pages: DataFrame) -> DataFrame:
    return pages.agg((F.coalesce(F.max("page"), F.lit(0)) + 1).alias("page"))


def list_pages(pages: DataFrame, cached: DataFrame) -> DataFrame:
    """pages in order, with whether a cache exists for each."""
    seen = cached.select("page").distinct().withColumn("cached", F.lit(True))
    return pages.join(seen, "page", "left").withColumn("cached", F.coalesce("cached", F.lit(False))).orderBy("page")


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table with a known schema, or None where there is none or it is empty."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return None if df.isEmpty() else df


def first_of(spark: SparkSession, paths: list[str], schema: str) -> DataFrame | None:
    """The first table that exists and has rows: a cache, then its older names or places."""
    return next((df for p in paths if (df := table_or_none(spark, p, schema)) is not None), None)


def newest(listing: DataFrame, prefix: str) -> DataFrame:
    """The last written file whose name starts with a prefix."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listing.where(name.startswith(prefix)).agg(F.max(F.struct("modificationTime", "path")).alias("f")).select("f.path", "f.modificationTime").where("path is not null")


def cached_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations out of JSON caches: each file a bare list, or an object of observations and meta. A cache with failed tiles
    counts as none."""
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    one = "struct<text:string,kind:string,symbol:string,attached_to:string,line_color:string,bbox:array<int>,confidence:double,tile_id:string,model:string,sub_tile:int>"
    bare = F.ltrim("value").startswith("[")
    rows = raw.select(
        F.regexp_extract("file", r"page=?(\d+)[^/]*(?:/[^/]*)?$", 1).cast("int").alias("page"),
        F.when(bare, F.from_json("value", f"array<{one}>")).otherwise(F.from_json("value", f"struct<observations:array<{one}>>")["observations"]).alias("o"),
        F.when(~bare, F.get_json_object("value", "$.meta.tiles_failed").cast("int")).alias("failed"),
    ).where(F.coalesce("failed", F.lit(0)) == 0)
    b = F.struct(*[F.get("o.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return rows.select("page", F.posexplode("o").alias("ord", "o")).select(
        "page", F.col("ord").cast("long").alias("ord"), "o.text", "o.kind", "o.symbol", "o.attached_to", "o.line_color", b.cast(box).alias("bbox"), "o.confidence", "o.tile_id", "o.model", "o.sub_tile"
    )


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """document_id, category, value out of a key whose values are strings or lists of strings."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<documents:array<struct<document_id:int,answers:map<string,variant>>>>")["documents"]).alias("d"))
    rows = raw.select("d.document_id", F.explode("d.answers").alias("category", "v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<string>"), F.array(F.try_variant_get("v", "$", "string")))
    return rows.select("document_id", "category", F.explode(listed).alias("value")).where("value is not null")


def rules(spark: SparkSession, path: str) -> RuleSet:
    """A rules file in YAML, or in JSON. It is configuration: the driver reads it through Spark, from any store."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return RuleSet.of(json.loads(text))
    except ValueError:
        import yaml

        return RuleSet.of(yaml.safe_load(text))


def run_history(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    runs = spark.read.schema(schemas.RUNS).parquet(path)
    return (runs.where(F.col("page").isin(pages)) if pages else runs).orderBy("page", "run_at")


def keyed_sheets(contexts: DataFrame, key: DataFrame, observations: DataFrame) -> DataFrame:
    """page, document_id of sheets that have a key and readings."""
    from drawlake.operators.scoring import documents_of_sheets

    return documents_of_sheets(contexts.dropDuplicates(["page"]), key).join(observations.select("page").distinct(), "page", "left_semi")


def load_run(runs: DataFrame, observations: DataFrame, regions: DataFrame, contexts: DataFrame) -> dict[str, DataFrame]:
    """The last run of every page with its caches, each by page."""
    from drawlake.operators.stats import latest_runs

    last = latest_runs(runs)
    pages = last.select("page")
    return {"runs": last} | {n: df.join(pages, "page", "left_semi") for n, df in (("observations", observations), ("regions", regions), ("contexts", contexts))}


Reader = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class ReaderSpec:
    """A pluggable reader: read turns one tile (a frame of one row: page, tile_id, box and what it needs) into a frame of
    readings or regions whose boxes are in the reader's units, with input_tokens and output_tokens if it knows them;
    thousandths tells that the units run from 0 to 1000. available: None, or why it can't run now."""

    name: str
    read: Reader
    thousandths: bool = False
    available: str | None = None


class CutOff(Exception):
    """A reader's answer was cut off: the tile is to be read again in quarters. input_tokens and output_tokens were spent."""

    def __init__(self, input_tokens: int = 0, output_tokens: int = 0):
        super().__init__("the answer was cut off")
        self.input_tokens, self.output_tokens = input_tokens, output_tokens


_PLACE = "page int, tile_id string, sub_tile int, tx0 int, ty0 int, tx1 int, ty1 int"
_USAGE = "input_tokens bigint, output_tokens bigint, error string, cut_off boolean"
_READING = "text string, kind string, symbol string, attached_to string, line_color string, x0 double, y0 double, x1 double, y1 double, confidence double"
_REGION = "x0 double, y0 double, x1 double, y1 double, score double, poly array<struct<x:int,y:int>>, text string, text_score double"


def _tile_by_tile(tiles: DataFrame, read: Reader, columns: str, workers: int | None) -> DataFrame:
    """What a reader says of each tile, and what it cost. A tile that fails gives one row with its error and the tokens that
    the error carries; a tile where nothing is seen gives one row of nulls. workers bounds the tiles read at a time."""
    schema = ", ".join([_PLACE, columns, _USAGE])
    names = [c.strip().split(" ")[0] for c in schema.replace("struct<x:int,y:int>", "struct").split(",")]
    place = names[:7]
    box = F.col("box")
    flat = tiles.withColumn("sub_tile", F.col("sub_tile") if "sub_tile" in tiles.columns else F.lit(None).cast("int"))
    flat = flat.select("*", *[box[c].cast("int").alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    flat = flat.repartition(workers) if workers else flat

    def of(tile: pd.DataFrame) -> list[dict]:
        try:
            rows = read(tile).to_dict("records") or [{}]
            for r in rows[1:]:  # the tokens are the call's, stated once
                r |= {c: 0 for c in ("input_tokens", "output_tokens") if c in r}
            return [r | {"cut_off": False} for r in rows]
        except Exception as e:  # a tile's failure is a row, so that the others go on
            spent = {c: int(getattr(e, c, 0)) for c in ("input_tokens", "output_tokens")}
            return [{"error": f"{type(e).__name__}: {e}"[:200], "cut_off": isinstance(e, CutOff), **spent}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            where = batch[place].to_dict("records")
            rows = [r | at for i, at in enumerate(where) for r in of(batch.iloc[[i]])]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return flat.mapInPandas(run, schema)


def _on_page(found: DataFrame, thousandths: bool) -> DataFrame:
    """found with its boxes as bbox on the page, and its tile as box."""
    tile = F.struct(*[F.col(f"t{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    sx = reader_scale(F.lit(thousandths), F.col("tx1") - F.col("tx0"))
    sy = reader_scale(F.lit(thousandths), F.col("ty1") - F.col("ty0"))
    b = F.when(F.col("x0").isNotNull(), from_tile(F.struct("x0", "y0", "x1", "y1"), tile, sx, sy))
    return found.withColumns({"bbox": b, "box": tile, "error": X.clipped(F.col("error"), 200)}).drop("x0", "y0", "x1", "y1", "tx0", "ty0", "tx1", "ty1")


def observe(tiles: DataFrame, reader: ReaderSpec, workers: int | None = None) -> DataFrame:
    """Readings of tiles (page, tile_id, box, what the reader needs) on their pages: tile by tile, in parallel over partitions.

    A tile that fails is one row with its error; one that holds nothing, a row without text. input_tokens and output_tokens
    are a call's, on its first row. cut_off marks tiles to be read again in quarters.
    """
    if reader.available:
        raise RuntimeError(f"{reader.name} is blocked: {reader.available}")
    return _on_page(_tile_by_tile(tiles, reader.read, _READING, workers), reader.thousandths).withColumn("model", F.lit(reader.name))


def detect(tiles: DataFrame, detector: ReaderSpec, workers: int | None = None) -> DataFrame:
    """Regions of tiles, or of whole pages given as one tile each: score, poly and what the detector read, on their pages."""
    if detector.available:
        raise RuntimeError(f"{detector.name} is blocked: {detector.available}")
    found = _tile_by_tile(tiles, detector.read, _REGION, workers)
    moved = F.transform("poly", lambda q: F.struct((q["x"] + F.col("tx0")).cast("int").alias("x"), (q["y"] + F.col("ty0")).cast("int").alias("y")))
    return _on_page(found.withColumn("poly", moved), detector.thousandths)


def observe_all(tiles: DataFrame, reader: ReaderSpec, least: int = 500, workers: int | None = None) -> DataFrame:
    """observe(), where tiles whose answer was cut off are read again in quarters, and those in theirs, until they are narrower
    than `least`; such a tile keeps its error. Each level's readings are materialised, so no tile is read twice."""
    out, todo = None, tiles
    while True:
        found = cut(observe(todo, reader, workers))
        again = F.col("cut_off") & (F.col("box.x1") - F.col("box.x0") >= least)
        done = found.where(~again)
        out = done if out is None else out.unionByName(done)
        cut_off = found.where(again).select("page", "tile_id", "box")
        if cut_off.isEmpty():
            return out
        out = out.unionByName(found.where(again).where("input_tokens + output_tokens > 0").withColumn("error", F.lit(None).cast("string")).withColumn("cut_off", F.lit(False)))  # what the cut-off call cost
        todo = split_tiles(cut_off, least)


def only_tiles(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tiles that are asked for (page, tile_id)."""
    return tiles.join(wanted.select("page", "tile_id").distinct(), ["page", "tile_id"], "left_semi")


def split_tiles(tiles: DataFrame, least: int = 500) -> DataFrame:
    """Quarters of tiles whose answer was cut off, for another read; tiles narrower than `least` are not split again."""
    from drawlake.functions.geometry import quarters

    return tiles.where(F.col("box.x1") - F.col("box.x0") >= least).select("page", "tile_id", F.explode(quarters(F.col("box"))).alias("q")).select("page", "tile_id", "q.sub_tile", "q.box")
