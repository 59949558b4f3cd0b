import json

import pytest
from pyspark.sql import functions as F

from drawlake import schemas
from drawlake.operators.rules import RuleSet
from drawlake.plans.stages import Run, Stage
from drawlake.sources import readers, writers
from drawlake.streaming import calls


def test_caches_and_keys(spark, tmp_path):
    (tmp_path / "page3_obs.json").write_text(json.dumps([{"text": "V1", "bbox": [1, 2, 3, 4], "confidence": 0.5}]))
    (tmp_path / "page4_obs.json").write_text(json.dumps({"observations": [{"text": "V2", "bbox": [1, 2, 3, 4]}, {"text": "V3", "bbox": [5, 6, 7, 8]}], "meta": {"tiles_failed": 0}}))
    (tmp_path / "page5_obs.json").write_text(json.dumps({"observations": [{"text": "V9", "bbox": [1, 2, 3, 4]}], "meta": {"tiles_failed": 2}}))
    got = readers.cached_observations(spark, str(tmp_path / "*_obs.json")).orderBy("page", "ord").collect()
    assert [(r["page"], r["ord"], r["text"], tuple(r["bbox"])) for r in got] == [(3, 0, "V1", (1, 2, 3, 4)), (4, 0, "V2", (1, 2, 3, 4)), (4, 1, "V3", (5, 6, 7, 8))]
    (tmp_path / "key.json").write_text(json.dumps({"documents": [{"document_id": 1, "answers": {"pid": "P-1", "v": ["A", "B"]}}]}))
    assert sorted(map(tuple, readers.answer_key(spark, str(tmp_path / "key.json")).collect())) == [(1, "pid", "P-1"), (1, "v", "A"), (1, "v", "B")]
    assert readers.newest(readers.files(spark, str(tmp_path), "*_obs.json"), "page4").count() == 1


def test_page_caches_replace_only_their_pages(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = lambda rows: spark.createDataFrame(rows, "page int, v string")
    writers.cache_pages(df([(1, "a"), (2, "b")]), path)
    writers.cache_pages(df([(2, "c")]), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("page", "v").collect())) == [(1, "a"), (2, "c")]
    writers.drop_pages(spark, path, [1])
    assert [r["page"] for r in spark.read.parquet(path).collect()] == [2]
    assert readers.table_or_none(spark, str(tmp_path / "nothing"), "page int") is None
    assert readers.first_of(spark, [str(tmp_path / "nothing"), path], "page int, v string").count() == 1


def test_rules_files_and_versions(spark, tmp_path):
    rs = RuleSet([{"emit": "text", "category": "v", "when": {"text": "^V"}, "own": 1}], {"strip": True}, ["notes"], 0.35)
    (tmp_path / "rules.yaml").write_text(writers.rules_text(rs))
    read = readers.rules(spark, str(tmp_path / "rules.yaml"))
    assert read.document() == rs.document() and list(read.rules[0]) == ["category", "when", "emit", "own"]
    path = str(tmp_path / "versions")
    writers.save_rules(spark, rs, {"action": "add"}, path)
    writers.save_rules(spark, RuleSet([]), {"action": "modify"}, path)
    assert writers.current_rules(spark, path).rules == [] and writers.rule_versions(spark, path).count() == 2


def test_formats_and_methods(spark):
    paths = spark.createDataFrame([("a/b.PDF",), ("c.tif",)], "path string")
    assert [r["format"] for r in readers.with_format(paths).collect()] == ["pdf", "image"]
    with pytest.raises(Exception, match="unsupported file type"):
        readers.with_format(spark.createDataFrame([("a.exe",)], "path string")).collect()
    images = spark.createDataFrame([(1, 100.0, 95.0, 500), (2, 100.0, 60.0, 0), (3, 100.0, 60.0, 10), (4, 100.0, None, 0)], "page int, page_area double, image_area double, text_chars int")
    assert [r["method"] for r in readers.page_method(images).orderBy("page").collect()] == ["scan", "scan", "digital", "digital"]
    assert readers.next_page(images).first()["page"] == 5 and readers.next_page(images.limit(0)).first()["page"] == 1


def test_reader_failures_are_rows(spark):
    import pandas as pd

    def read(batch):
        if (batch["tile_id"] == "t01").any():
            raise RuntimeError("429 too many")
        return pd.DataFrame({"page": batch["page"], "tile_id": batch["tile_id"], "text": "V1", "x0": 100.0, "y0": 0.0, "x1": 200.0, "y1": 500.0, "confidence": 0.9})

    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    tiles = spark.createDataFrame([(1, "t00", (1000, 0, 2000, 500)), (1, "t01", (0, 0, 1000, 500))], f"page int, tile_id string, box {box}").repartition(2, "tile_id")
    out = {r["tile_id"]: r for r in readers.observe(tiles, readers.ReaderSpec("fixture", read, thousandths=True)).collect()}
    if out["t00"]["error"] is None:
        assert tuple(out["t00"]["bbox"]) == (1100, 0, 1200, 250)
    assert "429" in out["t01"]["error"]
    with pytest.raises(RuntimeError, match="blocked"):
        readers.observe(tiles, readers.ReaderSpec("fixture", read, available="no key"))
    assert readers.split_tiles(tiles).count() == 8 and readers.split_tiles(tiles, 1001).count() == 0


def test_stages(spark):
    df = spark.range(1)
    fail = Stage("c", lambda r: 1 / 0)
    run = Run([Stage("a", lambda r: df), Stage("b", lambda r: r["a"], ("a",)), fail, Stage("d", lambda r: df, ("c",)), Stage("e", lambda r: df, blocked=lambda: "no key"), Stage("f", lambda r: 1 / 0, cached=lambda: df)])
    last = {e.stage: e.state for e in run.events()}
    assert last == {"a": "done", "b": "done", "c": "error", "d": "pending", "e": "blocked", "f": "done"}
    again = Run([Stage("a", lambda r: df)], cache_only=True)
    assert [e.state for e in again.events()] == ["waiting", "pending"]


def test_streams(spark, tmp_path):
    rows = [("D", "m", "ok", 1.0, None, 5, 5, 0.1, f"2024-01-01 00:0{i}:00") for i in range(6)] + [("E", "m", "error", 2.0, 1.0, 1, 1, None, "2024-01-01 00:01:00")]
    schema = "layer string, model string, status string, latency double, ttft double, input_tokens bigint, output_tokens bigint, cost double, at timestamp"
    df = spark.createDataFrame(rows, schema.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))
    path = str(tmp_path / "calls")
    df.repartition(3).write.parquet(path)
    seen = {}

    def keep(batch, number):
        seen["rows"] = {r["layer"]: (r["calls"], r["errors"], r["unpriced_calls"]) for r in batch.collect()}

    stats = calls.running_layer_stats(calls.read_calls(spark, path, schema, 1))
    calls.start(stats, keep, str(tmp_path / "c1"), every=None).awaitTermination()
    assert seen["rows"] == {"D": (6, 0, 0), "E": (1, 1, 0)}
    windows = calls.windowed_stats(calls.read_calls(spark, path, schema), "2 minutes")
    windows.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["calls"] for r in spark.table("w").where("layer = 'D'").collect()) == [2, 2, 2]
    one = calls.without_repeats(calls.read_calls(spark, path, schema), ["layer"])
    one.writeStream.outputMode("append").format("memory").queryName("u").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("u").count() == 2
    assert calls.sessions(df).count() == 2


def test_sinks(spark, tmp_path):
    answers = spark.createDataFrame([(1, "v", "B"), (1, "v", "A"), (2, "v", "C")], schemas.ANSWERS)
    ctx = spark.createDataFrame([(1, "S-1"), (2, "")], "page int, sheet_id string")
    assert {r["document_id"]: r["answers"] for r in writers.answer_documents(answers, ctx).collect()} == {"S-1": {"v": ["A", "B"]}, "page2": {"v": ["C"]}}
    bad = spark.createDataFrame([(1, "x", "correct", None)], "page int, id string, action string, corrected string")
    with pytest.raises(ValueError, match="correction"):
        writers.append_decision(bad, str(tmp_path / "d"))
    new, old = (spark.createDataFrame(r, "page int, sha1 string") for r in ([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "x")]))
    assert sorted(r["page"] for r in writers.changed_pages(new, old).collect()) == [2, 3]
    ev = spark.createDataFrame([(2, "done", "</x>"), (1, "init", "a")], "seq int, event string, note string")
    assert [(r["event"], r["data"]) for r in calls.events(ev).collect()] == [("init", '{"note":"a"}'), ("done", '{"note":"<\\/x>"}')]


def test_a_bad_tile_is_one_row(spark):
    import pandas as pd

    def read(tile):
        assert len(tile) == 1
        if tile["tile_id"].iloc[0] == "t07":
            raise readers.CutOff(5, 6)
        return pd.DataFrame([{"text": "V1", "x0": 0, "y0": 0, "x1": 1, "y1": 1, "input_tokens": 3}] * 2) if tile["tile_id"].iloc[0] != "t08" else pd.DataFrame()

    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    tiles = spark.createDataFrame([(1, f"t{i:02d}", (0, 0, 400, 400)) for i in range(40)], f"page int, tile_id string, box {box}").coalesce(1)
    out = readers.observe_all(tiles, readers.ReaderSpec("fixture", read), workers=3).collect()
    bad = [r for r in out if r["error"]]
    assert len(out) == 38 * 2 + 2 and [(r["tile_id"], r["input_tokens"], r["output_tokens"], r["cut_off"]) for r in bad] == [("t07", 5, 6, True)]
    assert [r["text"] for r in out if r["tile_id"] == "t08"] == [None] and sum(r["input_tokens"] or 0 for r in out) == 38 * 3 + 5


def test_stages_start_as_soon_as_they_can(spark):
    import time

    began = time.monotonic()
    at = {}

    def make(name, seconds):
        def run(_):
            at[name] = time.monotonic() - began
            time.sleep(seconds)
            return spark.range(1)

        return run

    run = Run([Stage("quick", make("quick", 0.05)), Stage("slow", make("slow", 1.5)), Stage("after", make("after", 0), ("quick",))], tick=lambda: "figures", every=0.2)
    seen = [(e.stage, e.state, e.note) for e in run.events()]
    assert at["after"] < 1.0 and ("", "running", "figures") in seen
    assert seen.index(("after", "done", "")) < seen.index(("slow", "done", ""))
    with pytest.raises(ValueError):
        list(Run([Stage("a", make("a", 0), ("nothing",))]).events())


def test_run_config():
    from drawlake.config import RunConfig

    config = RunConfig.of({"DRAWLAKE_WORKERS": "3", "DRAWLAKE_FRESH": "true", "DRAWLAKE_PAGES": "4"}, tile=800)
    assert (config.workers, config.fresh, config.pages, config.tile, config.told()["tile"]) == (3, True, (4,), 800, "800")
    with pytest.raises(ValueError):
        RunConfig(cascade=True)
    with pytest.raises(ValueError):
        RunConfig(workers=0)


def test_accepting_a_proposal(spark):
    from drawlake.operators import assistant, rules

    rs = rules.RuleSet([{"category": "v", "when": {"text": "^V"}, "emit": "text"}])
    proposal = {"action": "modify", "index": 0, "rule": {"category": "v", "when": {"text": "^W"}, "emit": "text"}, "before": {"category": "other"}, "status": "pending"}
    with pytest.raises(ValueError, match="changed"):
        assistant.accept(None, None, rs, proposal)
    with pytest.raises(ValueError, match="pending|accepted"):
        assistant.accept(None, None, rs, proposal | {"before": rs.rules[0], "status": "accepted"})
