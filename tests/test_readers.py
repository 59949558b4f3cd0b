import json

import pytest
from pyspark.sql import functions as F

from drawlake import __main__ as cli
from drawlake import schemas
from drawlake.functions import prompts
from drawlake.sources import limits
from drawlake.sources.readers import ReaderSpec


def test_pace_and_retries():
    slept, now = [], [0.0]
    pace = limits.Pace(2.0, lambda: now[0], slept.append)
    for _ in range(3):
        pace.wait()
    assert slept == [2.0, 4.0]
    waits, calls = [], []

    def read(batch):
        calls.append(batch)
        if len(calls) < 3:
            raise RuntimeError("429" if len(calls) == 1 else "odd")
        return "rows"

    assert limits.retried(read, sleep=waits.append)("b") == "rows" and waits == [20.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        limits.retried(lambda b: 1 / 0, tries=2, sleep=waits.append)("b")


def test_settings_and_choices(tmp_path):
    (tmp_path / ".env").write_text("# no\nA = '1'\nB=2\n")
    have = limits.settings(str(tmp_path / ".env"), {"B": "3"})
    assert have == {"A": "1", "B": "3"}
    spec = ReaderSpec("r", lambda b: b)
    assert limits.with_availability(spec, "A", have).available is None and "C" in limits.with_availability(spec, "C", have).available
    assert limits.chosen(["x", "y"], "x", None, {"V": "y"}, "V") == "y" and limits.chosen(["x", "y"], "x", "x", {"V": "y"}, "V") == "x"
    with pytest.raises(KeyError):
        limits.chosen(["x"], "x", "z", {}, "V")
    assert limits.clamped_effort("xhigh", ["low", "high"]) == "high" and limits.clamped_effort("low", []) is None
    assert limits.without_keys({"a": [{"b": 1, "c": 2}], "b": 3}, {"b"}) == {"a": [{"c": 2}]}
    assert [limits.completed(x) for x in ({"text": "a"}, {"text": ""}, {"stop": "max_tokens", "text": "a"}, {"stop": "blocked"})] == [None, "the answer was empty", "the answer was cut off", "the answer was blocked"]


def test_prompts(spark):
    tile = F.struct(F.lit(1).alias("x0"), F.lit(2).alias("y0"), F.lit(3).alias("x1"), F.lit(4).alias("y1"))
    symbols = F.array(F.struct(F.lit("hexagon").alias("shape"), F.lit("goes on").alias("meaning")))
    none = F.array().cast("array<struct<code:string,meaning:string>>")
    text = spark.range(1).select(prompts.tile_prompt(F.lit("S"), tile, symbols, none)).first()[0]
    assert text == "Sheet S, page pixels x1-3, y2-4.\nSymbols of this sheet:\n- hexagon: goes on"
    d = F.array(F.struct(F.lit(0).alias("id"), tile.alias("box"), F.lit("conflict").alias("kind"), F.lit("V1").alias("claim_a"), F.lit("Y1").alias("claim_b")))
    assert spark.range(1).select(prompts.dispute_prompt(d)).first()[0] == "[0] at 1,2,3,4: A reads 'V1', B reads 'Y1'"
    assert json.loads(spark.range(1).select(prompts.image_block(F.lit(b"ab"))).first()[0])["data"] == "YWI="


def test_command_line(spark, tmp_path, capsys):
    box = (0, 0, 10, 10)
    obs = [(1, 0, "V1", "valve", "bowtie", "", None, box, 0.9, "t00", "m", None), (1, 1, "XY 7", "instrument_bubble", "", "", None, (50, 50, 60, 60), 0.9, "t00", "m", None)]
    spark.createDataFrame(obs, schemas.OBSERVATIONS).write.parquet(str(tmp_path / "obs"))
    spark.createDataFrame([(1, "m", "P-1", None, None, None, [], [], [], [], 1.0, 0.0)], schemas.CONTEXTS).write.parquet(str(tmp_path / "ctx"))
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"category": "v", "when": {"text": "^V"}, "emit": "text"}]}))
    (tmp_path / "key.json").write_text(json.dumps({"documents": [{"document_id": 1, "answers": {"pid": "P_1", "v": ["V-1", "V2"]}}]}))
    common = ["--observations", str(tmp_path / "obs"), "--contexts", str(tmp_path / "ctx"), "--rules", str(tmp_path / "rules.json")]
    out = cli.main(["resolve", *common, "--to", str(tmp_path / "out")], spark)
    assert [(r["category"], r["value"]) for r in out.collect()] == [("pid", "P-1"), ("v", "V1")]
    assert spark.read.json(str(tmp_path / "out/unclassified")).first()["text"] == "XY 7"
    t = cli.main(["score", *common, "--key", str(tmp_path / "key.json")], spark).first()
    assert (t["matched"], t["missed"], t["exact_matched"]) == (2, 1, 0)
    other = cli.main(["score", *common, "--key", str(tmp_path / "key.json"), "--document-id", "1", "--quiet", "--models", "m"], spark).first()
    assert other["matched"] == 2
    second = [(1, 0, "V1", "valve", "bowtie", "", None, box, 0.8, "t00", "n", None), (1, 1, "V9", "valve", "bowtie", "", None, (90, 90, 99, 99), 0.8, "t00", "n", None)]
    spark.createDataFrame(second, schemas.OBSERVATIONS).write.parquet(str(tmp_path / "second"))
    both = cli.main(["resolve", *common, "--second", str(tmp_path / "second"), "--quiet", "--fresh", "--to", str(tmp_path / "out")], spark)
    assert [(r["category"], r["value"]) for r in both.collect()] == [("pid", "P-1"), ("v", "V1"), ("v", "V9")]
    cli.main(["snapshot", *common, "--to", str(tmp_path / "s.html")], spark)
    assert '"V1"' in (tmp_path / "s.html").read_text()
    spark.createDataFrame([(1, None, "P-1", "m", 0.5, 1, 1, 0.1, 0.0, 1.0)], schemas.RUNS).withColumn("run_at", F.current_timestamp()).write.parquet(str(tmp_path / "runs"))
    assert cli.main(["report", "--runs", str(tmp_path / "runs")], spark).first()["recall"] == 0.5
    assert cli.main(["history", "--runs", str(tmp_path / "runs"), "--pages", "1"], spark).first()["delta"] is None
    results = spark.createDataFrame([("c1", 1, 0.5, 1, 1, 1, 0.1, 1.0, 0)], "config string, page int, recall double, matched long, missed long, exact long, cost double, seconds double, tiles_failed long")
    results.write.parquet(str(tmp_path / "results"))
    (tmp_path / "configs.json").write_text(json.dumps({"configs": {"c1": "m", "c2": "n"}}))
    left = cli.main(["bench", "--results", str(tmp_path / "results"), "--configs", str(tmp_path / "configs.json"), "--pages", "1", "2", "--quiet"], spark)
    assert [(r["config"], r["page"]) for r in left.collect()] == [("c1", 2), ("c2", 1), ("c2", 2)]
    assert cli.main(["bench", "--results", str(tmp_path / "results"), "--pages", "1"], spark).first()["recall_1"] == 0.5
