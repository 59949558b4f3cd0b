"""Registered queries over sources, sinks, readers, runs and streams, each beside its DuckDB SQL.

Queries that write do so in a folder of their own under the session's shared folder, and read back what they wrote.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from drawlake.config import RunConfig
from drawlake.functions import geometry as G
from drawlake.functions import prompts
from drawlake.functions import values as V
from drawlake.operators import assistant, benchmarks, cascade, resolve, review, rules as R, scoring, spatial, stats, tables, verify
from drawlake.plans.proxies import contexts, frame, observations, rules, table_reads
from drawlake.plans.queries import DISPUTES, IOU, NARROW, PRICED, SCORED, UNIQUE, VOTED, _compared, _recall_sql, _scored, _verdicts, emitted_sql, query, resolved
from drawlake.plans.stages import Run, Stage
from drawlake.sources import limits, readers, writers
from drawlake.sources.scratch import shared_folder, stored
from drawlake.streaming import calls as streams


def own_folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def rows_sql(names: str, rows: list[tuple]) -> str:
    """The SQL of a few known rows."""
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


# Files and caches -------------------------------------------------------------------------------------------------------------

EXTENSIONS = [".PDF", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


@query("pages_", "select page, case when page % 8 = 0 then 'pdf' else 'image' end format from pages_")
def page_formats(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.col("page") % 8 + 1)
    paths = frame(spark, sf_dir, "pages_").select("page", F.concat(F.lit("/in/p"), F.col("page").cast("string"), ext).alias("path"))
    return readers.with_format(paths).select("page", "format")


@query("pages_", "select page, cast(i - 1 as int) source_page_index, i frame from (select page, unnest(range(1, page % 4 + 2)) i from pages_) t")
def image_frames(spark, sf_dir):
    """A page per frame of a multi-frame image that a decoder has taken apart."""
    images = frame(spark, sf_dir, "pages_").select("page", F.sequence(F.lit(1).cast("long"), (F.col("page") % 4 + 1).cast("long")).alias("frames"))
    return readers.frames(images).select("page", "source_page_index", "frame")


@query(sql=rows_sql("idx, category, emit, keys", [(i, r["category"], r["emit"], ",".join(R.ordered(r))) for i, r in enumerate(rules().rules)]))
def rules_file(spark, sf_dir):
    """The rules written as YAML and read again: categories, modes, and the order of their keys."""
    path = own_folder(spark)
    spark.createDataFrame([(writers.rules_text(rules()),)], "value string").coalesce(1).write.text(path)
    again = readers.rules(spark, path)
    return spark.createDataFrame([(i, r["category"], r["emit"], ",".join(r)) for i, r in enumerate(again.rules)], "idx int, category string, emit string, keys string")


@query("obs", "select page, row_number() over (partition by page order by ord) - 1 ord, text, kind, cast(x0 as int) x0, confidence, tile_id from obs where page % 3 = 0 or page % 7 <> 0")
def cached_readings(spark, sf_dir):
    """Caches written as JSON, bare lists and lists with meta, and read again; a cache with failed tiles is none."""
    o = frame(spark, sf_dir, "obs")
    box = F.array(*[F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("bbox")
    one = F.struct("ord", "text", "kind", "symbol", "attached_to", box, "confidence", "tile_id")
    lists = o.groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("o")).withColumn("o", F.transform("o", lambda x: x.dropFields("ord")))
    meta = F.struct(F.when(F.col("page") % 7 == 0, 1).otherwise(0).alias("tiles_failed"))
    value = F.when(F.col("page") % 3 == 0, F.to_json("o")).otherwise(F.to_json(F.struct(F.col("o").alias("observations"), meta.alias("meta"))))
    path = own_folder(spark)
    lists.select("page", value.alias("value")).repartition("page").write.partitionBy("page").text(path)
    return readers.cached_observations(spark, f"{path}/*/*.txt").select("page", "ord", "text", "kind", "bbox.x0", "confidence", "tile_id")


@query("regions", "select page, ord, score from regions")
def older_cache(spark, sf_dir):
    """The first place that has rows: the newest is not there, the one before it is empty."""
    path, schema = own_folder(spark), "page int, ord bigint, score double"
    found = frame(spark, sf_dir, "regions").select("page", "ord", "score")
    found.limit(0).write.parquet(f"{path}/v2")
    found.write.parquet(f"{path}/v1")
    return readers.first_of(spark, [f"{path}/v3", f"{path}/v2", f"{path}/v1"], schema)


@query("runs", "select concat('/c/page7_', run_no) path from runs where page = 7 order by run_at desc, concat('/c/page7_', run_no) desc limit 1")
def newest_cache(spark, sf_dir):
    listing = frame(spark, sf_dir, "runs").select(F.concat(F.lit("/c/page"), F.col("page").cast("string"), F.lit("_"), F.col("run_no").cast("string")).alias("path"), F.col("run_at").alias("modificationTime"))
    return readers.newest(listing, "page7_").select("path")


@query("runs obs regions zones", """+ l as (select * from runs qualify row_number() over (partition by page order by run_at desc, run_no desc) = 1)
select l.page, l.run_no, (select count(*) from obs o where o.page = l.page) readings, (select count(*) from regions r where r.page = l.page) regions, (select count(distinct page) from zones z where z.page = l.page) contexts from l""")  # fmt: skip
def last_run_caches(spark, sf_dir):
    got = readers.load_run(frame(spark, sf_dir, "runs"), frame(spark, sf_dir, "obs"), frame(spark, sf_dir, "regions"), contexts(spark, sf_dir))
    out = got["runs"].select("page", "run_no")
    for name, alias in (("observations", "readings"), ("regions", "regions"), ("contexts", "contexts")):
        out = out.join(got[name].groupBy("page").agg(F.count(F.lit(1)).alias(alias)), "page", "left")
    return out.na.fill(0)


@query("runs", "select page, strftime(run_at, '%Y%m%d-%H%M%S') stamp, recall, matched, missed from runs")
def run_records(spark, sf_dir):
    """Run records appended one after the other, and the history read back."""
    path = own_folder(spark)
    runs = frame(spark, sf_dir, "runs").select("page", "run_at", "recall", "matched", "missed")
    for part in range(2):
        writers.append_run(runs.where(F.col("matched") % 2 == part), path)
    return writers.stamped(readers.run_history(spark, path)).select("page", "stamp", "recall", "matched", "missed")


@query("obs", "select page, count(*) n, sum(x0) total from obs where page % 5 <> 1 group by page")
def dropped_pages(spark, sf_dir):
    """A layer cached by page, some pages written again, and others forgotten."""
    path = own_folder(spark)
    rows = frame(spark, sf_dir, "obs").select("page", "ord", F.col("bbox.x0").cast("long").alias("x0"))
    writers.cache_pages(rows.withColumn("x0", F.lit(0).cast("long")), path)
    writers.cache_pages(rows, path)
    gone = [r[0] for r in frame(spark, sf_dir, "pages_").where("page % 5 = 1").select("page").collect()]
    writers.drop_pages(spark, path, gone)
    return spark.read.schema("ord bigint, x0 bigint, page int").parquet(path).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("x0").alias("total"))


@query("pages_", "select page, sha1(concat(width, 'x', height, 'pixels of ', page // 2)) sha1 from pages_ where page % 3 <> 0")
def changed_pages(spark, sf_dir):
    """Pages whose pixels differ from those written before are written again."""
    pages = frame(spark, sf_dir, "pages_").withColumn("pixels", F.concat(F.lit("pixels of "), F.expr("page div 2").cast("string")).cast("binary"))
    from drawlake.functions.text import pixel_fingerprint

    old = pages.select("page", F.when(F.col("page") % 3 == 0, pixel_fingerprint(F.col("width"), F.col("height"), F.col("pixels"))).otherwise("other").alias("sha1"))
    path = own_folder(spark)
    writers.write_pages(pages, old, path)
    return spark.read.parquet(path).select("page", "sha1")


@query("", "select r_name as name, length(r_name) + 1 as length from region")
def uploads(spark, sf_dir):
    """Files that land in a folder, as a stream."""
    path = own_folder(spark)
    names = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"), F.col("r_name").alias("value"))
    names.repartition("name").write.partitionBy("name").text(f"{path}/in")
    # A written folder nests its files by name; a landing folder is one level of them.
    found = readers.file_stream(spark, f"{path}/in/*").select(F.url_decode(F.regexp_extract("path", r"name=([^/]+)/", 1)).alias("name"), F.octet_length("content").cast("long").alias("length"))
    streams.start(found, lambda df, _: df.write.mode("append").parquet(f"{path}/out"), f"{path}/state", mode="append", every=None).awaitTermination()
    return spark.read.parquet(f"{path}/out")


# Readers ----------------------------------------------------------------------------------------------------------------------


def _tiles(spark, sf_dir):
    return G.tile_grid(frame(spark, sf_dir, "pages_"))


TILES = """+ xs as (select page, width, height, unnest(list_distinct(list_concat(generate_series(0, greatest(width - 1250, 0), 1062), [greatest(width - 1250, 0)]))) x from pages_),
ys as (select page, unnest(list_distinct(list_concat(generate_series(0, greatest(height - 1250, 0), 1062), [greatest(height - 1250, 0)]))) y from pages_),
tiles as (select xs.page, concat('t', lpad(cast(row_number() over (partition by xs.page order by y, x) - 1 as varchar), 2, '0')) tile_id, cast(x as int) tx0, cast(y as int) ty0,
  cast(least(x + 1250, width) as int) tx1, cast(least(y + 1250, height) as int) ty1 from xs join ys on xs.page = ys.page)"""  # fmt: skip


def _says_its_name(tile: pd.DataFrame) -> pd.DataFrame:
    """A reader that sees a valve in every tile, but fails on the third of pages that divide by ten."""
    t = tile.iloc[0]
    if t["page"] % 10 == 0 and t["tile_id"] == "t02":
        raise RuntimeError("unreadable")
    return pd.DataFrame([{"text": f"V{t['page']}-{t['tile_id']}", "kind": "valve", "x0": 100.0, "y0": 200.0, "x1": 300.0, "y1": 400.0, "confidence": 0.9, "input_tokens": 1000, "output_tokens": 10}])


@query("pages_", TILES + """ select page, tile_id, case when bad then null else concat('V', page, '-', tile_id) end as text,
  case when not bad then cast(trunc(100 * ((tx1 - tx0) / 1000.0)) as int) + tx0 end x0, case when not bad then cast(trunc(400 * ((ty1 - ty0) / 1000.0)) as int) + ty0 end y1,
  case when bad then 0 else 1000 end input_tokens, case when bad then 'RuntimeError: unreadable' end error from (select *, page % 10 = 0 and tile_id = 't02' bad from tiles) t""")  # fmt: skip
def tile_readings(spark, sf_dir):
    """Readings of all tiles; a tile that fails is one row with its error, and its neighbours are read."""
    found = readers.observe(_tiles(spark, sf_dir), readers.ReaderSpec("fixture", _says_its_name, thousandths=True), workers=8)
    return found.select("page", "tile_id", "text", "bbox.x0", "bbox.y1", F.col("input_tokens").cast("int").alias("input_tokens"), "error")


def _boxes(tile: pd.DataFrame) -> pd.DataFrame:
    n = int(tile.iloc[0]["page"]) % 3
    return pd.DataFrame([{"x0": 10.0 * k, "y0": 5.0, "x1": 10.0 * k + 8, "y1": 9.0, "score": 0.5 + k / 10, "poly": [{"x": 10 * k, "y": 5}, {"x": 10 * k + 8, "y": 9}], "text": f"r{k}", "text_score": 0.25} for k in range(n)])


@query("pages_", TILES + """, k as (select *, unnest(case page % 3 when 0 then [null] when 1 then [0] else [0, 1] end) k from tiles)
select page, tile_id, case when k is not null then tx0 + 10 * k end x0, case when k is not null then ty0 + 9 end y1, 0.5 + k / 10 score, concat('r', k) as text, case when k is not null then tx0 + 10 * k + 8 end poly_x
from (select page, tile_id, tx0, ty0, k, case when k is null then null else 1 end one from k) t""".replace("concat('r', k)", "case when k is not null then concat('r', k) end").replace("0.5 + k / 10", "cast(0.5 as double) + cast(k as double) / 10"))  # fmt: skip
def tile_regions(spark, sf_dir):
    """A text detector over tiles: scores and polygons of its regions on the page; a tile without any is a row without."""
    found = readers.detect(_tiles(spark, sf_dir), readers.ReaderSpec("detector", _boxes))
    return found.select("page", "tile_id", "bbox.x0", "bbox.y1", "score", "text", F.try_element_at("poly", F.lit(2))["x"].alias("poly_x"))


def _cut_off_when_wide(tile: pd.DataFrame) -> pd.DataFrame:
    b = tile.iloc[0]
    if b["tx1"] - b["tx0"] > 700:
        raise readers.CutOff(input_tokens=7)
    return pd.DataFrame([{"text": "V1", "x0": 0.0, "y0": 0.0, "x1": 5.0, "y1": 5.0, "confidence": 0.9, "input_tokens": 1}])


@query("pages_", TILES + """, t as (select *, tx1 - tx0 > 700 wide, cast(trunc((tx1 - tx0) * 0.55) as int) pw, cast(trunc((ty1 - ty0) * 0.55) as int) ph from tiles),
q as (select page, tile_id, null sub_tile, tx0 x0, ty0 y0, 1 tokens, 'V1' as text from t where not wide
  union all select page, tile_id, null, null, null, 7, null from t where wide
  union all select page, tile_id, i, case when i % 2 = 1 then tx1 - pw else tx0 end, case when i >= 2 then ty1 - ph else ty0 end, 1, 'V1' from t cross join (select unnest([0, 1, 2, 3]) i) n where wide)
select page, tile_id, cast(sub_tile as int) sub_tile, cast(x0 as int) x0, cast(y0 as int) y0, tokens, text from q""")  # fmt: skip
def split_readings(spark, sf_dir):
    """Tiles whose answer is cut off are read again in quarters; what the cut-off call cost stays on a row of its own."""
    found = readers.observe_all(_tiles(spark, sf_dir), readers.ReaderSpec("narrow", _cut_off_when_wide))
    return found.select("page", "tile_id", "sub_tile", "bbox.x0", "bbox.y0", F.col("input_tokens").cast("int").alias("tokens"), "text")


@query("obs second zones pages_", DISPUTES + ", want as (select distinct page, tile_id from disputes)" + TILES.lstrip("+").replace("xs as", ", xs as", 1) + " select page, tile_id, tx0 x0, ty1 y1 from tiles t where exists (select 1 from want w where w.page = t.page and w.tile_id = t.tile_id)")
def pruned_tiles(spark, sf_dir):
    """The tiles of the grid that a second look is worth: those that hold a dispute."""
    wanted = cascade.tiles_to_review(cascade.disputes(_compared(spark, sf_dir), contexts(spark, sf_dir)))
    return readers.only_tiles(_tiles(spark, sf_dir), wanted).select("page", "tile_id", "box.x0", "box.y1")


SETTINGS = "# readers\nFIRST_KEY = 'abc'\nREADER=second\n"


def _settings_rows() -> list[tuple[str, str, str | None]]:
    spec = readers.ReaderSpec("first", lambda t: t)
    have = {"FIRST_KEY": "abc", "READER": "second"}
    out = [("setting", k, v) for k, v in sorted(have.items())]
    out += [("chosen", case, limits.chosen(["first", "second", "third"], "first", own, env, "READER")) for case, own, env in (("default", None, {}), ("environment", None, have), ("call", "third", have))]
    out += [("blocked", need, limits.with_availability(spec, need, have).available) for need in ("FIRST_KEY", "SECOND_KEY")]
    out += [("answer", case, limits.completed(a)) for case, a in (("whole", {"text": "x"}), ("cut", {"text": "x", "stop": "max_tokens"}), ("blocked", {"stop": "refusal"}), ("empty", {"text": ""}))]
    out += [("effort", f"{e} of {','.join(a)}", limits.clamped_effort(e, a)) for e, a in (("xhigh", ["low", "high"]), ("low", ["high"]))]
    out += [("schema", "stripped", json.dumps(limits.without_keys({"type": "object", "additionalProperties": False, "items": [{"title": 1, "type": "string"}]}, {"additionalProperties", "title"})))]
    return out


SETTINGS_WANTED = [
    ("setting", "FIRST_KEY", "abc"), ("setting", "READER", "second"), ("chosen", "default", "first"), ("chosen", "environment", "second"), ("chosen", "call", "third"),
    ("blocked", "FIRST_KEY", None), ("blocked", "SECOND_KEY", "SECOND_KEY is not set"), ("answer", "whole", None), ("answer", "cut", "the answer was cut off"),
    ("answer", "blocked", "the answer was blocked"), ("answer", "empty", "the answer was empty"), ("effort", "xhigh of low,high", "high"), ("effort", "low of high", None),
    ("schema", "stripped", '{"type": "object", "items": [{"type": "string"}]}'), ("config", "cascade", "True"), ("config", "judge", "c"), ("config", "pages", "(1, 2)"), ("config", "second", "b"), ("config", "tile", "900"),
]


@query(sql=rows_sql("topic, name, result", SETTINGS_WANTED))
def reader_settings(spark, sf_dir):
    """Settings, the choice of a reader, what blocks it, which answers can't be used, and the knobs of a run."""
    config = RunConfig.of({"DRAWLAKE_TILE": "900", "DRAWLAKE_CASCADE": "yes", "DRAWLAKE_PAGES": "1,2"}, second="b", judge="c")
    rows = _settings_rows() + [("config", k, v) for k, v in sorted(config.told().items())]
    return spark.createDataFrame(rows, "topic string, name string, result string")


@query("calls models", "select distinct c.model, m.provider, m.tier from calls c join models m on m.model = c.model")
def known_models(spark, sf_dir):
    """The catalogue's rows of the models called; one that it lacks would be an error."""
    return stats.checked_models(frame(spark, sf_dir, "calls").select("model").distinct(), frame(spark, sf_dir, "models")).select("model", "provider", "tier")


@query(sql=rows_sql("first, second, warned", [("a", "a", "model"), ("a", "b", "provider"), ("a", "c", None)]))
def reader_pairs(spark, sf_dir):
    """Pairs of readers whose agreement says little, and what they share."""
    providers = {"a": "x", "b": "x", "c": "y"}
    rows = [("a", other, (w := cascade.pair_warning("a", other, providers)) and ("model" if "the model" in w else "provider")) for other in "abc"]
    return spark.createDataFrame(rows, "first string, second string, warned string")


@query("pages_", "select page, concat('Sheet ', page, ', page pixels x0-', width, ', y0-', height, '.', chr(10), 'Symbols of this sheet:', chr(10), '- hexagon: goes on') tile, concat('[0] at 0,0,', width, ',', height, ': A reads ''V1'', B reads ''Y1''') dispute, concat('{\"media_type\":\"image/png\",\"data\":\"', base64(encode(cast(page as varchar))), '\"}') image from pages_")
def prompt_texts(spark, sf_dir):
    box = G.box(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    symbols = F.array(F.struct(F.lit("hexagon").alias("shape"), F.lit("goes on").alias("meaning")))
    codes = F.array().cast("array<struct<code:string,meaning:string>>")
    items = F.array(F.struct(F.lit(0).alias("id"), box.alias("box"), F.lit("conflict").alias("kind"), F.lit("V1").alias("claim_a"), F.lit("Y1").alias("claim_b")))
    page = F.col("page").cast("string")
    return frame(spark, sf_dir, "pages_").select("page", prompts.tile_prompt(page, box, symbols, codes).alias("tile"), prompts.dispute_prompt(items).alias("dispute"), prompts.image_block(page.cast("binary")).alias("image"))


# Decisions, verdicts and rules ---------------------------------------------------------------------------------------------------

ACTION = "case run_no % 3 when 0 then 'accept' when 1 then 'reject' else 'correct' end"


@query("runs", f"select page, concat('i', run_no % 4) id, {ACTION} as action, case when run_no % 3 = 2 then concat('C', run_no) end corrected from runs qualify row_number() over (partition by page, run_no % 4 order by run_at desc, {ACTION} desc, corrected desc nulls last) = 1")
def decision_log(spark, sf_dir):
    """Decisions that are only ever appended; the last of an item counts."""
    path = own_folder(spark)
    d = frame(spark, sf_dir, "runs").select(
        "page", F.concat(F.lit("i"), (F.col("run_no") % 4).cast("string")).alias("id"), F.expr(ACTION).alias("action"), F.expr("case when run_no % 3 = 2 then concat('C', run_no) end").alias("corrected"),
        F.lit(None).cast("string").alias("note"), F.lit("r").alias("by"), F.col("run_at").alias("at"),
    )
    for part in range(2):
        writers.append_decision(d.where(F.col("page") % 2 == part), path)
    return review.latest(spark.read.parquet(path)).select("page", "id", "decision.action", "decision.corrected")


@query("obs", r"""+ asked as (select page, ord from obs where regexp_matches(text, '^PCV\s*[0-9]') and kind = 'instrument_bubble' qualify row_number() over (partition by page, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') order by conf_pct desc, ord) = 1),
k as (select page, ord // 6 n, ord // 6 % 3 < 2 and ord // 6 % 5 <> 0 known from asked)
select page, count(*) filter (where known and n % 3 = 0) yes, count(*) filter (where known and n % 3 = 1) as no, count(*) filter (where not known) missing from k group by page""")  # fmt: skip
def verdict_counts(spark, sf_dir):
    """Verdicts cached by page, those on questions no longer asked left out, counted."""
    path = own_folder(spark)
    asked = stored(verify.candidates(frame(spark, sf_dir, "obs"), rules()).select("page", "category", "tag_key", "ord", "question_hash"))  # read twice
    writers.cache_pages(_verdicts(asked), path)
    cached = spark.read.schema("category string, tag_key string, answer string, question_hash string, page int").parquet(path)
    return verify.verdict_counts(verify.current(cached, rules()), asked)


@query("obs", r"""+ asked as (select page, concat('u_bend|', regexp_replace(upper(text), '[^A-Z0-9]', '', 'g')) tag_key, ord // 6 n from obs
where regexp_matches(text, '^PCV\s*[0-9]') and kind = 'instrument_bubble' qualify row_number() over (partition by page, tag_key order by conf_pct desc, ord) = 1)
select page, tag_key, case when n % 3 < 2 and n % 5 <> 0 then case when n % 3 = 0 then 'yes' else 'no' end else concat('asked ', n % 7) end answer from asked""")  # fmt: skip
def checked_tags(spark, sf_dir):
    """The loop of a visual check: what the cache answers, and the rest asked once and added to it."""
    path = own_folder(spark)
    asked = verify.candidates(frame(spark, sf_dir, "obs"), rules())
    known = verify.current(_verdicts(asked), rules())
    known.select("page", "category", "tag_key", "answer", "question_hash").write.parquet(path)
    cache = spark.read.schema("page int, category string, tag_key string, answer string, question_hash string").parquet(path)
    again = verify.checked(asked, cache, lambda left: left.withColumn("answer", F.concat(F.lit("asked "), F.expr("ord div 6 % 7").cast("string"))), path)
    return again.select("page", "tag_key", "answer")


@query(sql=rows_sql("n, action, category, rules", [(0, "modify", "valves", 11), (1, "add", "extra", 12), (2, "start", "", 11)]))
def rule_log(spark, sf_dir):
    """Versions of the rules, the last first, with how many rules each holds."""
    path = own_folder(spark)
    versions = [(rules(), {"action": "start", "category": ""})]
    added = R.with_proposal(rules(), "add", None, {"category": "extra", "when": {"text": "X"}, "emit": "text"})
    versions += [(added, {"action": "add", "category": "extra"}), (R.with_proposal(rules(), "modify", 3, NARROW), {"action": "modify", "category": "valves"})]
    for v, change in versions:
        writers.save_rules(spark, v, change, path)
    assert len(writers.current_rules(spark, path).rules) == 11
    log = writers.rule_versions(spark, path).select("change", "rules").toLocalIterator()
    rows = [(n, json.loads(r["change"])["action"], json.loads(r["change"])["category"], len(json.loads(r["rules"])["rules"])) for n, r in enumerate(log)]
    return spark.createDataFrame(rows, "n int, action string, category string, rules int")


PROPOSED = [
    ("capture", {"emit": "capture", "pattern": "(V)", "template": "no"}, "category,source,note,when,emit,pattern", None),
    ("template", {"emit": "template", "pattern": "(V)"}, "category,source,note,when,emit,pattern_field,pattern,template", None),
    ("split", {"emit": "split", "keep_legend_codes": True, "unless": [{"field": "kind", "pattern": "x"}]}, "category,source,note,when,unless,emit,keep_legend_codes", None),
    ("broken", {"emit": "text", "when": [{"field": "text", "pattern": "("}]}, "category,source,note,when,emit", "when/text"),
    ("all", {"emit": "text", "when": []}, "category,source,note,when,emit", "without"),
]


@query(sql=rows_sql("name, keys, problem", [(n, k, p) for n, _, k, p in PROPOSED]))
def proposals(spark, sf_dir):
    """Proposals as rules, the order of their keys, and what speaks against them."""
    out = []
    for name, told, _, _ in PROPOSED:
        rule = R.from_proposal({"category": "c", "source": "s", "reason": "r", "when": [{"field": "text", "pattern": "V"}]} | told)
        why = R.validate("add", None, rule, rules())
        out.append((name, ",".join(rule), why and why.split(" ")[0]))
    return spark.createDataFrame(out, "name string, keys string, problem string")


@query("obs zones", f"+ {UNIQUE}, a as (select distinct page, text as value from unique_ where kind = 'valve' and regexp_matches(text, '^V[1-4][0-9]*\\b')) select page, value from a")
def answers_after_rule(spark, sf_dir):
    """The valves of the cached readings once a proposal that narrows their rule is accepted."""
    proposal = {"action": "modify", "index": 3, "rule": NARROW, "before": rules().rules[3], "status": "pending"}
    _, r = assistant.accept(observations(spark, sf_dir), contexts(spark, sf_dir), rules(), proposal)
    return r.answers.where("category = 'valves'").select("page", "value")


@query("runs obs zones answer_key", """select distinct r.page from runs r where exists (select 1 from obs o where o.page = r.page) and r.page % 6 <> 1
and not exists (select 1 from answer_key k where k.category = 'pid' and k.document_id = r.page)""")  # fmt: skip
def sheets_to_propose(spark, sf_dir):
    """Finished sheets with readings, no key and no proposal yet."""
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    runs = frame(spark, sf_dir, "runs")
    return assistant.to_propose(runs, contexts(spark, sf_dir), key, frame(spark, sf_dir, "obs"), runs.where("page % 6 = 1").select("page"))


@query("obs zones answer_key", f"""select bool_or(coalesce(a.recall, 0) < coalesce(b.recall, 0)) regresses from (with recursive {_recall_sql("kind = 'valve' and regexp_matches(symbol, 'valve|bowtie') and regexp_matches(text, '^V[0-9]+\\b')")}) b
join (with recursive {_recall_sql("kind = 'valve' and regexp_matches(text, '^V[1-4][0-9]*\\b')")}) a on a.page = b.page""")  # fmt: skip
def preview_regresses(spark, sf_dir):
    """Whether the proposal loses recall on a keyed sheet."""
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    return assistant.preview(observations(spark, sf_dir), contexts(spark, sf_dir), rules(), "modify", 3, NARROW, key).regresses


# Tables and disputes ----------------------------------------------------------------------------------------------------------


@query("cells", VOTED + """, d as (select table_index, count(*) filter (where not agreed and readers > 1) disputed, max(readers) readers from won group by table_index),
n as (select table_index, count(distinct reader_no) reads from cells group by table_index) select d.table_index from d join n using (table_index) where disputed > 0 or d.readers < n.reads""")  # fmt: skip
def third_reads(spark, sf_dir):
    """Tables that two readers leave open: disputed cells, or other shapes."""
    return tables.needs_third_read(tables.vote(table_reads(spark, sf_dir))).select("table_index")


@query("cells", VOTED + """ select 0 page, cast(sum(case when not agreed and readers > 1 then 1 else 0 end) as bigint) disputed_cells,
(select count(*) from (select distinct table_index, reader_no from cells where (table_index + reader_no) % 4 = 0) s) shrunk from won""")  # fmt: skip
def table_counts(spark, sf_dir):
    """Disputed cells and tables read below their size."""
    reads = table_reads(spark, sf_dir).withColumn("read_scale", F.when((F.col("table_index") + F.col("reader_no")) % 4 == 0, 0.5).otherwise(1.0))
    return tables.table_counts(tables.vote(reads), reads)


@query("cells", """+ r as (select table_index, reader_no, row_no, row_number() over (partition by table_index, reader_no order by row_no) - 1 i, list(cell order by col) c from cells where not (row_no % 3 = 1 and col = 2) group by 1, 2, 3)
select table_index, reader_no, cast(i as int) row_no, array_to_string(list_concat(c, case when len(c) = 2 then [''] else [] end), '|') as line,
  case when i = 0 then array_to_string(list_transform([1, 2, 3], lambda k: array_to_string(list_filter([c[k], case when h.n = 3 or k < 3 then h.c[k] else '' end], lambda x: coalesce(x, '') <> ''), ' / ')), '|') end header
from (select r.*, lead(struct_pack(c := c, n := len(c))) over (partition by table_index, reader_no order by row_no) h from r) t""")  # fmt: skip
def ragged_tables(spark, sf_dir):
    """Rows of uneven length padded, and a header of two rows made one."""
    cells = frame(spark, sf_dir, "cells").where("not (row_no % 3 = 1 and col = 2)")
    rows = cells.groupBy("table_index", "reader_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("r"))
    reads = rows.groupBy("table_index", "reader_no").agg(F.array_sort(F.collect_list(F.struct("row_no", F.col("r.cell").alias("row"))))["row"].alias("rows"))
    full = tables.with_shape(reads).withColumn("header", F.array_join(V.fused_header(F.col("rows"), F.lit(2)), "|"))
    lines = full.select("table_index", "reader_no", "header", F.posexplode("rows").alias("row_no", "r"))
    return lines.select("table_index", "reader_no", "row_no", F.array_join("r", "|").alias("line"), F.when(F.col("row_no") == 0, F.col("header")).alias("header"))


@query("obs second zones", DISPUTES + """, n as (select *, row_number() over (partition by page, tile_id order by gi) - 1 n from disputes where w)
select page, gi, tile_id, n // 30 chunk, cast(n % 30 as int) id from n where n % 30 % 4 <> 3""")  # fmt: skip
def ruled_disputes(spark, sf_dir):
    """Rulings of a judge that also rules on numbers it was not asked about: those drop out."""
    chunked = cascade.chunks(cascade.disputes(_compared(spark, sf_dir), contexts(spark, sf_dir)))
    rulings = chunked.select("page", "tile_id", "chunk", F.when(F.col("id") % 4 == 3, F.col("id") + 1000).otherwise(F.col("id")).alias("id"))
    return cascade.valid_rulings(rulings, chunked).select("page", "gi", "tile_id", "chunk", "id")


# Runs and reports -------------------------------------------------------------------------------------------------------------


@query("calls models", f"""{PRICED} select event_id, layer, row_number() over w done, cast(sum(case when status = 'error' then 1 else 0 end) over w as bigint) failed, cast(sum(input_tokens + output_tokens) over w as bigint) tokens,
round(sum(coalesce(cost, 0)) over w, 5) spent from priced window w as (partition by layer order by "at", event_id rows between unbounded preceding and current row)""")  # fmt: skip
def call_progress(spark, sf_dir):
    """What had been done up to each call of a layer."""
    calls = stats.priced(frame(spark, sf_dir, "calls"), frame(spark, sf_dir, "models"))
    return stats.progress(calls).select("event_id", "layer", "done", "failed", "tokens", F.round("spent", 5).alias("spent"))


COVERED = f"""v as (select page, cast(count(*) filter (where exists (select 1 from obs o where o.page = r.page and o.x1 > r.x0 and r.x1 > o.x0 and o.y1 > r.y0 and r.y1 > o.y0 and {IOU.format(a='r', b='o')} > 0.3)) as double) / count(*) coverage from regions r group by page)"""


@query("obs zones regions answer_key", SCORED + f""", t as (select page, cast(sum(found) as double) / (sum(found) + sum(missed)) recall, cast(sum(found) as double) / (sum(found) + sum(extra)) key_precision from scored where in_key group by page),
claimed as (select distinct page, ord from hits union select distinct page, ord from unique_ where symbol = 'diamond'),
a as (select u.page, u.n resolved, u.n - coalesce(c.n, 0) unclaimed from (select page, count(*) n from unique_ group by page) u left join (select page, count(*) n from claimed group by page) c using (page)), {COVERED},
r2 as (select page, cast(count(*) filter (where twin = 0) as double) / count(*) agreement_rate from obs group by page)
select page, resolved, unclaimed, coverage, recall, key_precision, agreement_rate from a full join v using (page) full join t using (page) full join r2 using (page)""")  # fmt: skip
def page_figures(spark, sf_dir):
    """A page's figures in one row."""
    r = resolved(spark, sf_dir, keep=True)
    agreement = frame(spark, sf_dir, "obs").groupBy("page").agg((F.count_if(F.col("twin") == 0) / F.count(F.lit(1))).alias("agreement_rate"))
    return stats.figures(scoring.totals(_scored(spark, sf_dir, r.answers)), spatial.coverage(frame(spark, sf_dir, "regions"), frame(spark, sf_dir, "obs")), r.audit, agreement)


@query("obs zones regions answer_key", SCORED + f""", {COVERED}, pct as (select page, sum(found) f, sum(found) + sum(missed) n from scored where in_key group by page),
miss as (select page, category, string_agg(value, ' | ' order by value) m from expected x where not exists (select 1 from got g where g.page = x.page and g.category = x.category and g.kk = x.kk) group by page, category),
lines as (select page, string_agg(s.category || ': ' || s.found || '/' || s.expected || coalesce(', missed ' || m.m, ''), chr(10) order by s.category) l from scored s left join miss m using (page, category) where in_key group by page),
noise as (select page, cast(sum(case when in_key then extra else got end) as bigint) x from scored group by page)
select page, printf('recall %.1f%%', round_even(cast(f as double) / n * 100, 1)) || printf(', coverage %.1f%%', round_even(coverage * 100, 1)) || chr(10) || l || chr(10) || 'not in the key: ' || x report from pct join lines using (page) join noise using (page) join v using (page)""")  # fmt: skip
def page_reports(spark, sf_dir):
    """The text report of each keyed page."""
    r = resolved(spark, sf_dir, keep=True)
    scored = _scored(spark, sf_dir, r.answers)
    covered = spatial.coverage(frame(spark, sf_dir, "regions"), frame(spark, sf_dir, "obs")).select("page", "coverage")
    return scoring.report_text(scored, scoring.totals(scored), covered)


@query("obs zones answer_key", SCORED + """, t as (select page, cast(sum(found) as double) / (sum(found) + sum(missed)) recall from scored where in_key group by page) select 'right' model, page, recall from t""")
def recall_by_context(spark, sf_dir):
    """Legends read by two models over the same readings: the one misreads every sheet number, so its pages have no key."""
    c = contexts(spark, sf_dir).drop("model")
    both = c.withColumn("model", F.lit("right")).unionByName(c.withColumns({"model": F.lit("wrong"), "sheet_id": F.lit("none")}))
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    return benchmarks.by_context(both, observations(spark, sf_dir).drop("model"), rules(), key)


@query("runs", "+ m as (select concat('c', i) config, concat('m', i) model, p page from (select unnest([0, 1, 2]) i) a cross join (select unnest([1, 2, 3, 4]) p) b) select m.config, m.model, cast(m.page as int) page from m where not exists (select 1 from runs r where r.page = m.page and r.run_no % 64 = m.page and concat('c', r.run_no % 3) = m.config)")
def benchmark_todo(spark, sf_dir):
    """What a stopped benchmark still has to do, out of its file of configurations."""
    path = own_folder(spark)
    text = json.dumps({"configs": {f"c{i}": f"m{i}" for i in range(3)}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    done = frame(spark, sf_dir, "runs").where("run_no % 64 = page").select(F.concat(F.lit("c"), (F.col("run_no") % 3).cast("string")).alias("config"), "page")
    return benchmarks.todo(benchmarks.configs(spark, path), [1, 2, 3, 4], done).select("config", "model", "page")


@query("obs zones runs answer_key", SCORED + f""", free as (select u.* from unique_ u where u.symbol <> 'diamond' and not exists (select 1 from hits h where h.page = u.page and h.ord = u.ord)),
un as (select page, count(distinct upper(text)) n from free where kind not in ('annotation', 'line_label', 'other') group by page),
t as (select page, cast(sum(found) as double) / (sum(found) + sum(missed)) recall from scored where in_key group by page),
l as (select * from runs qualify row_number() over (partition by page order by run_at desc, run_no desc) = 1)
select l.page, l.run_no, u.n resolved, coalesce(un.n, 0) unclassified, t.recall is not null scored from l join (select page, count(*) n from unique_ group by page) u using (page) left join un using (page) left join t using (page)""")  # fmt: skip
def run_outputs(spark, sf_dir):
    """What a finished run leaves behind, read back: its record, unclassified readings, and a score only where there is a key."""
    path = own_folder(spark)
    r = resolved(spark, sf_dir, keep=True)
    run = stats.latest_runs(frame(spark, sf_dir, "runs")).select("page", "run_no", F.lit(1).alias("calls")).join(r.audit.select("page"), "page", "left_semi")
    writers.write_run(r.answers, contexts(spark, sf_dir), resolve.unclassified(r.unclaimed), r.audit, run, scoring.totals(_scored(spark, sf_dir, r.answers)), path)
    record = spark.read.schema("page int, run_no bigint, resolved bigint, calls int").json(f"{path}/run")
    n = spark.read.schema("page int, text string").json(f"{path}/unclassified").groupBy("page").agg(F.count(F.lit(1)).alias("unclassified"))
    score = spark.read.schema("page int, recall double").json(f"{path}/score").select("page", F.lit(True).alias("scored"))
    out = record.where("calls is null").join(n, "page", "left").join(score, "page", "left")
    return out.select("page", "run_no", "resolved", F.coalesce("unclassified", F.lit(0).cast("long")).alias("unclassified"), F.coalesce("scored", F.lit(False)).alias("scored"))


@query("obs zones", f"""+ {UNIQUE}, {emitted_sql('unique_')}, free as (select u.* from unique_ u where u.symbol <> 'diamond' and not exists (select 1 from hits h where h.page = u.page and h.ord = u.ord)),
one as (select page, text, kind from free where kind not in ('annotation', 'line_label', 'other') qualify row_number() over (partition by page, upper(text) order by conf_pct desc, ord) = 1)
select page, text, cast(row_number() over (partition by page order by kind, text) - 1 as int) as no from one""")  # fmt: skip
def unclassified_order(spark, sf_dir):
    """Unclassified readings in the order that a page lists them."""
    return resolve.unclassified(resolved(spark, sf_dir).unclaimed).select("page", "text", "no")


@query("regions", "select page, ord from regions qualify row_number() over (partition by page order by ord) <= 5")
def first_regions(spark, sf_dir):
    return benchmarks.first_regions(frame(spark, sf_dir, "regions")).select("page", "ord")


@query("obs zones", f"+ {UNIQUE}, {emitted_sql('unique_')}, a as (select distinct page, category, value from emitted union select distinct page, 'pid', concat('PID-1-SS-', cast(page as varchar)) from zones) select page, string_agg(distinct category, ',' order by category) categories, count(*) n from a group by page")
def answer_rows(spark, sf_dir):
    """A page's categories in order, as a viewer lists them, and how many values they hold."""
    lists = resolve.answer_lists(resolved(spark, sf_dir).answers)
    return lists.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"), F.sum(F.size("values")).cast("long").alias("n"))


@query("obs", "select page, max(case when pk % 2 = 0 then text end) even, max(case when pk % 3 = 0 then text end) third, coalesce(max(case when pk % 3 = 0 then text end), max(case when pk % 2 = 0 then text end)) both_ from obs group by page")
def merged_fields(spark, sf_dir):
    """Two records of a page merged: the later one's fields win, new ones are added."""
    o = frame(spark, sf_dir, "obs").groupBy("page").agg(F.max(F.when(F.col("pk") % 2 == 0, F.col("text"))).alias("even"), F.max(F.when(F.col("pk") % 3 == 0, F.col("text"))).alias("third"))
    first = F.map_filter(F.create_map(F.lit("v"), F.col("even"), F.lit("even"), F.col("even")), lambda k, v: v.isNotNull())
    second = F.map_filter(F.create_map(F.lit("v"), F.col("third"), F.lit("third"), F.col("third")), lambda k, v: v.isNotNull())
    merged = V.merged_maps(first, second)
    return o.select("page", F.try_element_at(merged, F.lit("even")).alias("even"), F.try_element_at(merged, F.lit("third")).alias("third"), F.try_element_at(merged, F.lit("v")).alias("both_"))


# Stages, events and streams ------------------------------------------------------------------------------------------------------

STAGE_ENDS = [("context", "done", "cached"), ("detect", "done", ""), ("observe", "error", "ValueError: no image"), ("tables", "blocked", "no key"), ("resolve", "pending", "needs a stage that did not finish"), ("coverage", "done", "")]


@query(sql=rows_sql("stage, state, note", STAGE_ENDS))
def stage_ends(spark, sf_dir):
    """How the stages of a run end: one kept, one that fails without stopping its siblings, one blocked, and those behind them."""

    def fails(_):
        raise ValueError("no image")

    made = lambda _: spark.range(1)
    run = Run([
        Stage("context", made, cached=lambda: spark.range(1)), Stage("detect", made), Stage("observe", fails, ("context",)), Stage("tables", made, blocked=lambda: "no key"),
        Stage("resolve", made, ("observe", "context")), Stage("coverage", made, ("detect",)),
    ])
    last = {e.stage: e for e in run.events()}
    return spark.createDataFrame([(e.stage, e.state, e.note) for e in last.values()], "stage string, state string, note string")


@query("calls", """+ e as (select event_id seq, layer as event, '{"model":"' || model || '","tokens":' || input_tokens || ',"note":"<\\/b>"}' as data from calls where event_id % 50 = 0)
select cast(row_number() over (order by seq) - 1 as int) seq, event, data from e""".replace("where event_id % 50 = 0", "where status = 'error'"))  # fmt: skip
def viewer_events(spark, sf_dir):
    """Events of the failed calls for a viewer, appended to a log as the text of a stream, and replayed from it."""
    path = own_folder(spark)
    failed = frame(spark, sf_dir, "calls").where("status = 'error'").select(F.col("event_id").alias("seq"), F.col("layer").alias("event"), "model", F.col("input_tokens").alias("tokens"), F.lit("</b>").alias("note"))
    writers.append_events(streams.events(failed), path)
    return writers.replayed(spark, path)


def _stream_calls(spark, sf_dir):
    """The calls as a stream over the events' file."""
    from drawlake.plans.queries import frame_text

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(frame_text("calls"), events=stream)


def _written(spark, df, mode: str):
    """What a streaming query over all that is there leaves in a table of the shared folder."""
    path = own_folder(spark)
    to = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")
    streams.start(df, to, f"{path}/state", mode=mode, every=None).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("calls", """select epoch_ms(time_bucket(interval 1 hour, "at")) // 1000 starts, layer, count(*) calls, count(*) filter (where status = 'error') errors from calls group by 1, 2""")
def stream_windows(spark, sf_dir):
    """Calls per hour and layer, by a streaming query over windows."""
    hourly = streams.windowed_stats(_stream_calls(spark, sf_dir).withColumn("cost", F.lit(0.0)), "1 hour", late="40 days")
    return _written(spark, hourly.select(F.unix_seconds("window.start").alias("starts"), "layer", "calls", "errors"), "complete")


@query("calls", """+ g as (select layer, "at", case when "at" - lag("at") over (partition by layer order by "at") < interval 2 minutes then 0 else 1 end starts from calls),
s as (select layer, sum(starts) over (partition by layer order by "at" rows unbounded preceding) n from g) select layer, count(*) calls from s group by layer, n""")  # fmt: skip
def stream_sessions(spark, sf_dir):
    """Calls of a layer that follow each other within two minutes, by a streaming query over sessions."""
    return _written(spark, streams.sessions(_stream_calls(spark, sf_dir), "2 minutes", "1 second").select("layer", "calls"), "complete")


@query("calls", "select distinct model, layer from calls")
def stream_repeats(spark, sf_dir):
    """The first call of a model and layer, repeats left out within the watermark."""
    return _written(spark, streams.without_repeats(_stream_calls(spark, sf_dir), ["model", "layer"], "100 days").select("model", "layer"), "append")
