import random

import pytest
from pyspark.sql import functions as F

from drawlake.functions import geometry as G
from drawlake.functions import text as X
from drawlake.functions import values as V
from drawlake.operators import benchmarks, cascade, resolve, review, rules, scoring, spatial, stats, tables, verify

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def boxes(seed, n, pages=3, span=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(span), r.randrange(span)
        out.append((r.randrange(pages), i, (x, y, x + r.randrange(1, 90), y + r.randrange(1, 90)), r.choice([0.5, 0.6, 0.7, 0.9]), r.choice(["V 1", "V1", "PI 2", "a b", "PCV2", ""])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"page int, ord bigint, bbox {BOX}, score double, text string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("seed", range(3))
def test_suppress_overlaps(spark, seed):
    rows = boxes(seed, 300)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(k[0] == r[0] and iou(k[2], r[2]) > 0.4 for k in kept):
            kept.append(r)
    got = spatial.suppress_overlaps(frame(spark, rows)).select("ord").collect()
    assert sorted(r[0] for r in got) == sorted(r[1] for r in kept)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match(spark, seed):
    a, b = boxes(seed, 200), boxes(seed + 100, 220)
    used, want = set(), []
    for x in a:
        best, at = 0.0, None
        for y in b:
            if y[0] == x[0] and y[1] not in used and iou(x[2], y[2]) > best:
                best, at = iou(x[2], y[2]), y[1]
        if at is not None and best >= 0.2:
            used.add(at)
            want.append((x[0], x[1], at))
    got = spatial.greedy_match(frame(spark, a), frame(spark, b)).select("page", "a_ord", "b_ord").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_compare_classifies_every_reading(spark):
    a, b = boxes(7, 200), boxes(107, 200)
    names = {"kind": F.lit("valve"), "symbol": F.lit(""), "attached_to": F.lit(""), "confidence": F.col("score"), "tile_id": F.lit("t00")}
    c = cascade.compare(frame(spark, a).withColumns(names), frame(spark, b).withColumns(names))
    agree, conflict, solo_a, solo_b = (df.count() for df in (c.agree, c.conflict, c.solo_a, c.solo_b))
    assert agree + conflict + solo_a == len(a) and agree + conflict + solo_b == len(b)
    for r in c.agree.collect():
        assert "".join(ch for ch in r["text"].upper() if ch.isalnum()) == "".join(ch for ch in r["agreed_with"].upper() if ch.isalnum())


def test_merge_follows_rulings(spark):
    box = (0, 0, 10, 10)
    obs = f"page int, ord bigint, text string, kind string, symbol string, attached_to string, bbox {BOX}, confidence double, tile_id string, model string"
    a = spark.createDataFrame([(1, 0, "V1", "valve", "s", "", box, 0.5, "t00", "a"), (1, 1, "V2", "valve", "s", "", (50, 50, 60, 60), 0.9, "t00", "a"), (1, 2, "V9", "valve", "s", "", (90, 90, 99, 99), 0.9, "t01", "a")], obs)
    b = spark.createDataFrame([(1, 0, "Y1", "valve", "s", "", box, 0.8, "t00", "b"), (1, 1, "V-9", "valve", "s", "", (90, 90, 99, 99), 0.7, "t01", "b")], obs)
    ctx = spark.createDataFrame([(1, [])], f"page int, suppress_regions array<struct<kind:string,bbox:{BOX}>>")
    c = cascade.compare(a, b)
    items = cascade.disputes(c, ctx)
    assert [(r["gi"], r["kind"], r["claim_a"], r["claim_b"], r["escalate"]) for r in items.orderBy("gi").collect()] == [(0, "conflict", "V1", "Y1", True), (1, "solo_a", "V2", None, True)]
    none = spark.createDataFrame([], "page int, gi bigint, present boolean, text string, kind string, symbol string, attached_to string, confidence double, model string")
    texts = lambda m: sorted((r["text"], r["source"]) for r in m.collect())
    assert texts(cascade.merge(c, items, none)) == [("V2", "unsettled"), ("V9", "agreed"), ("Y1", "unsettled")]
    ruled = spark.createDataFrame([(1, 0, True, "V7", "", "", "", 0.9, "f"), (1, 1, False, "", "", "", "", 0.9, "f")], none.schema)
    assert texts(cascade.merge(c, items, ruled)) == [("V7", "adjudicated"), ("V9", "agreed")]
    counts = cascade.merge_counts(cascade.merge(c, items, ruled), items, ruled).first()
    assert (counts["agreed"], counts["adjudicated"], counts["kept_unsettled"], counts["dropped_as_absent"]) == (1, 1, 0, 1)


def test_unread_uses_mutual_centres(spark):
    regions, obs = boxes(3, 150, 2), boxes(4, 60, 2)
    c = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    inside = lambda p, b: b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]
    want = [r[1] for r in regions if not any(o[0] == r[0] and (inside(c(r[2]), o[2]) or inside(c(o[2]), r[2])) for o in obs)]
    assert sorted(r[0] for r in spatial.unread(frame(spark, regions), frame(spark, obs)).select("ord").collect()) == sorted(want)


@pytest.mark.parametrize(("text", "want"), [("20845 J", "J20845"), ("J 20845", "J20845"), ("20845", "20845"), ("REACTOR COOLANT RC-E-1 20845 J INNER SEAL", "J20845"), ("X-A 20845", "20845"), ("123", None), (None, None)])
def test_connector_id(spark, text, want):
    assert value(spark, X.connector_id(F.lit(text).cast("string"))) == want


def test_connector_description(spark):
    text = F.lit("REACTOR COOLANT RC-E-1 (D-8) 20845 J INNER  SEAL")
    assert value(spark, X.connector_description(text, r"REACTOR\s+COOLANT")) == "RC-E-1 INNER SEAL"


@pytest.mark.parametrize(("text", "options", "want"), [("PCV 2848", {}, "PCV2848"), ("  a \n b ", {}, "a b"), ("a b", {"collapse_whitespace": True}, "ab"), ("ABCDE 1", {}, "ABCDE 1"), ("pi 1", {"uppercase": True}, "PI 1"), (None, {}, "")])
def test_normalise(spark, text, options, want):
    assert value(spark, X.normalise(F.lit(text).cast("string"), **options)) == want


def test_tag_tests(spark):
    assert [value(spark, X.has_tag_shape(F.lit(t))) for t in ("V113", "9A", '1/2"-T', "0", "-", "F-192", "a longer note of prose")] == [True, True, True, False, False, True, False]
    assert [value(spark, X.is_taglike(F.lit(t))) for t in ("V1", "", "--", "x" * 41)] == [True, False, False, False]
    assert value(spark, X.key(F.lit("PID-1-SS_A20519"))) == value(spark, X.key(F.lit("PID-1-SS-A20519")))


def test_tiles_cover_the_page(spark):
    pages = spark.createDataFrame([(0, 5088, 3296), (1, 100, 90), (2, 1250, 1251), (3, 2313, 1250)], "page int, width int, height int")
    tiles = G.tile_grid(pages).collect()
    assert sum(t["page"] == 0 for t in tiles) == 15
    for page, width, height in pages.collect():
        own = [t["box"] for t in tiles if t["page"] == page]
        for side, far, length in (("x0", "x1", width), ("y0", "y1", height)):
            spans = sorted({(b[side], b[far]) for b in own})
            assert spans[0][0] == 0 and spans[-1][1] == length
            assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_boxes(spark):
    b = F.struct(F.lit(10).alias("x0"), F.lit(20).alias("y0"), F.lit(30).alias("x1"), F.lit(60).alias("y1"))
    tile = F.struct(F.lit(100).alias("x0"), F.lit(200).alias("y0"), F.lit(1350).alias("x1"), F.lit(1450).alias("y1"))
    k = G.reader_scale(F.lit(True), F.lit(1250))
    assert tuple(value(spark, G.from_tile(b, tile, k, k))) == (112, 225, 137, 275)
    assert tuple(value(spark, G.to_tile(G.from_tile(b, tile, F.lit(1.0), F.lit(1.0)), tile, F.lit(1.0), F.lit(1.0)))) == (10, 20, 30, 60)
    assert [tuple(q["box"]) for q in value(spark, G.quarters(tile))] == [(100, 200, 787, 887), (663, 200, 1350, 887), (100, 763, 787, 1450), (663, 763, 1350, 1450)]
    assert value(spark, G.iou(b, b)) == 1.0 and value(spark, G.iou(b, tile)) == 0.0
    assert value(spark, G.fit_scale(F.lit(5000), F.lit(100))) == pytest.approx(2576 / 5000)
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3, 9), (1, 4), (7, 2))])
    assert tuple(value(spark, G.points_box(G.shift_points(points, F.lit(10), F.lit(0))))) == (11, 2, 17, 9)
    assert value(spark, G.hit(b, 35, 20, 5)) and not value(spark, G.hit(b, 36, 20, 5))


RULES = rules.RuleSet([{"category": "v", "when": {"text": r"^V\d"}, "emit": "text"}, {"category": "p", "when": {"kind": "valve"}, "emit": "capture", "pattern": r"(\d+)$"}])


def test_rules_validate_and_change(spark):
    assert "no rule 9" in rules.validate("modify", 9, {"when": {"text": "a"}}, RULES)
    assert "when/text" in rules.validate("add", None, {"when": {"text": "("}}, RULES)
    assert "pattern does" in rules.validate("add", None, {"when": {"text": "a"}, "pattern": r"(?P<n>V\d+)"}, RULES)  # Python's, not the JVM's
    assert "without a condition" in rules.validate("add", None, {"when": {}}, RULES)
    assert rules.validate("add", None, {"when": {"text": r"(?<n>V\d+)"}}, RULES) is None
    old = rules.RuleSet([{"category": "v", "when": {"text": "a"}, "emit": "text", "min_conf": 0.7, "verify": {"question": "?"}}])
    new = rules.from_proposal({"category": "v", "source": "legend", "reason": "wider", "when": [{"field": "text", "pattern": "b"}], "emit": "text"})
    changed = rules.with_proposal(old, "modify", 0, new)
    assert changed.rules[0]["min_conf"] == 0.7 and changed.rules[0]["verify"] and changed.rules[0]["when"] == {"text": "b"}
    assert old.rules[0]["when"] == {"text": "a"} and rules.changed_since(changed, 0, old.rules[0])
    with pytest.raises(ValueError):
        rules.decided({"status": "accepted"}, "accepted")
    assert rules.decided({"status": "pending"}, "rejected")["status"] == "rejected"


def test_a_rule_that_matches_but_writes_nothing_claims(spark):
    obs = spark.createDataFrame([(1, 0, "none", "valve", "", "", (0, 0, 5, 5), 0.9, "t00"), (1, 1, "V1", "x", "", "", (9, 9, 12, 12), None, "t00")], f"page int, ord bigint, text string, kind string, symbol string, attached_to string, bbox {BOX}, confidence double, tile_id string")
    ctx = spark.createDataFrame([(1, [], [], "S 1")], f"page int, suppress_regions array<struct<kind:string,bbox:{BOX}>>, system_prefixes array<struct<code:string,meaning:string>>, sheet_id string")
    r = resolve.resolve(obs, ctx, RULES)
    assert r.unclaimed.count() == 0 and sorted(map(tuple, r.answers.collect())) == [(1, "pid", "S1"), (1, "v", "V1")]
    again = resolve.answer_maps(r.answers).first()["answers"]
    assert again == {"pid": ["S1"], "v": ["V1"]}
    empty = resolve.resolve(obs.limit(0), ctx.limit(0), RULES)
    assert empty.answers.count() == 0 and empty.audit.count() == 0


def test_flag_letters(spark):
    rs = rules.RuleSet([{"category": "c", "when": {"text": "a"}, "read_flag_letter": True}])
    prov = spark.createDataFrame([(1, "c", "20842 LOOP 2", (0, 0, 10, 10)), (1, "c", "J20842 LOOP 2", (0, 0, 10, 10)), (1, "d", "20842", (0, 0, 1, 1))], f"page int, category string, value string, bbox {BOX}")
    obs = spark.createDataFrame([(1, 0, "20842", "continuation_connection", (500, 500, 520, 520)), (1, 1, "20842", "continuation_connection", (110, 60, 130, 80))], f"page int, ord bigint, text string, kind string, bbox {BOX}")
    jobs = verify.flag_jobs(prov, obs, rs)
    assert [r["key"] for r in jobs.collect()] == ["c|20842|2|1"]
    flags = spark.createDataFrame([(1, "c|20842|2|1", " j ")], "page int, key string, letter string")
    assert sorted(map(tuple, verify.with_letters(prov.select("page", "category", "value"), jobs, flags).collect())) == [(1, "c", "J20842 LOOP 2"), (1, "d", "20842")]


def test_vote_rotates_when_the_first_is_odd(spark):
    reads = [(0, 0, 1, "a", [["h"], ["1"], ["x"]], 1), (0, 0, 2, "b", [["h"], ["2"]], 1), (0, 0, 3, "c", [["h"], ["2 "]], 1)]
    df = tables.with_shape(spark.createDataFrame(reads, "page int, table_index int, reader_no int, reader string, rows array<array<string>>, header_rows int")).withColumns({"title": F.lit("T"), "kind": F.lit("data")})
    v = tables.vote(df).first()
    assert v["readers"] == ["b", "c"] and v["rows"] == [["h"], ["2"]] and v["shape_mismatch"] == ["a"] and v["cell_agreement"] == 1.0 and v["rotated"]
    two = tables.vote(df.where("reader_no in (2, 3)").withColumn("rows", F.when(F.col("reader_no") == 3, F.array(F.array(F.lit("h")), F.array(F.lit("9")))).otherwise(F.col("rows")))).first()
    assert two["rows"] == [["h"], ["2"]] and [(d["row"], d["col"], d["readings"]) for d in two["disputed"]] == [(1, 0, ["2", "9"])] and two["cell_agreement"] == 0.5


def test_table_texts(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("")), F.array(F.lit('1,"2'), F.lit("p|q\nr")))
    assert value(spark, tables.csv_text(rows)) == 'a,b\r\nx,\r\n"1,""2","p|q\nr"\r\n'
    assert value(spark, tables.markdown_text(F.lit("T"), F.lit("data"), rows, F.lit(2))) == '### T\n\n| a / x | b |\n| --- | --- |\n| 1,"2 | p\\|q r |\n'
    assert value(spark, V.rectangular(F.array(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c"))))) == [["a", ""], ["b", "c"]]


def test_align_rows(spark):
    def want(gold, header_rows, got):
        norm = lambda c: " ".join(c.split()).upper()
        rows = [[norm(c) for c in r] for r in got if any(c.strip() for c in r)]
        used, out = set(), [0] * 5
        for i, g in enumerate([[norm(c) for c in r] for r in gold]):
            scored = [(sum(bool(c) and k < len(r) and r[k] == c for k, c in enumerate(g)), -n) for n, r in enumerate(rows) if n not in used]
            best = max(scored, default=(0, 0))
            r = []
            if best[0] > 0:
                used.add(-best[1])
                r = rows[-best[1]]
            for k, c in enumerate(g):
                x = r[k] if k < len(r) else None
                at = 2 if i < header_rows else 0
                out[at] += 1
                out[at + 1] += x == c
                out[4] += bool(x) and x != c and x.replace("Y", "V") == c.replace("Y", "V")
        return tuple(out)

    r = random.Random(5)
    cells = ["", "v1", "Y1", "V1", "y 2", "3", "4"]
    gold, reads, expected = [], [], {}
    for t in range(40):
        table = [[r.choice(cells) for _ in range(3)] for _ in range(r.randrange(1, 6))]
        got = [[r.choice([c, c, r.choice(cells)]) for c in row] for row in table if r.random() < 0.9] + [["", "", ""]]
        r.shuffle(got)
        gold.append((0, t, table, 1))
        reads.append((0, t, "a", got))
        expected[t] = want(table, 1, got)
    g = spark.createDataFrame(gold, "page int, table_index int, rows array<array<string>>, header_rows int")
    out = benchmarks.align_rows(g, spark.createDataFrame(reads, "page int, table_index int, reader string, rows array<array<string>>")).collect()
    assert {x["table_index"]: (x["data_cells"], x["data_exact"], x["header_cells"], x["header_exact"], x["v_y_swaps"]) for x in out} == expected


def test_decisions(spark):
    answers = spark.createDataFrame([(1, "v", "A"), (1, "v", "B"), (1, "w", "C")], "page int, category string, value string")
    schema = "page int, id string, category string, value string, priority int, decision struct<action:string,corrected:string>"
    items = spark.createDataFrame(
        [(1, "a", "v", "A", 0, ("reject", None)), (1, "b", "v", "B", 0, ("correct", "B2")), (1, "c", "v", "Z", 0, ("correct", "Z2")), (1, "d", "w", "C", 0, ("accept", None)), (1, "e", "q", "Q", 0, ("correct", "Q2")), (1, "f", "w", "C", 1, None)], schema
    )
    assert sorted(map(tuple, review.decided_answers(answers, items).collect())) == [(1, "v", "B2"), (1, "v", "Z2"), (1, "w", "C")]
    n = review.applied_counts(answers, items).first()
    assert (n["rejected"], n["corrected"], n["accepted"]) == (1, 2, 1)
    shown = review.neighbours(items).orderBy("priority", "category", "value").collect()
    assert shown[0]["previous_id"] == shown[0]["id"] and shown[-1]["next_id"] == shown[-1]["id"]


def test_latest_decision_counts(spark):
    d = spark.createDataFrame([(1, "x", "reject", None, None, "r", "2024-01-01 00:00:00"), (1, "x", "accept", None, None, "r", "2024-01-02 00:00:00")], "page int, id string, action string, corrected string, note string, by string, at string")
    assert review.latest(d.withColumn("at", F.to_timestamp("at"))).first()["decision"]["action"] == "accept"


def test_scores(spark):
    key = spark.createDataFrame([(7, "pid", "P-1"), (7, "v", "V 1"), (7, "v", "V2"), (7, "w", "W")], "document_id int, category string, value string")
    ctx = spark.createDataFrame([(1, "P_1"), (2, "unknown"), (3, None)], "page int, sheet_id string")
    pages = scoring.documents_of_sheets(ctx, key)
    assert list(map(tuple, pages.collect())) == [(1, 7)]
    answers = spark.createDataFrame([(1, "pid", "P1"), (1, "v", "V1"), (1, "v", "V3"), (1, "new", "N"), (2, "v", "V2")], "page int, category string, value string")
    cats = scoring.score_categories(answers, key, pages)
    t = scoring.totals(cats).first()
    assert (t["matched"], t["missed"], t["extra"], t["exact_matched"], t["cleanup_only_matched"]) == (2, 2, 1, 0, 2) and t["recall"] == 0.5
    assert sorted((r["category"], r["value"]) for r in scoring.extra_values(cats).collect()) == [("new", "N"), ("v", "V3")]


def test_costs_and_models(spark):
    models = spark.createDataFrame([("a", "p", "light", 1.0, 2.0), ("b", "p", "light", None, 1.0)], "model string, provider string, tier string, price_in double, price_out double")
    calls = spark.createDataFrame([("D", "a", 10**6, 10**6), ("D", "b", 5, 5), ("D", "zz", 1, None)], "layer string, model string, input_tokens bigint, output_tokens bigint")
    assert [r["cost"] for r in stats.priced(calls, models).orderBy("model").collect()] == [3.0, None, None]
    assert stats.cost_or_null(stats.priced(calls, models), ["layer"]).first()["cost"] is None
    with pytest.raises(Exception, match="unknown model"):
        stats.checked_models(calls.select("model"), models).collect()
    assert cascade.pair_warning("a", "a", {"a": "p"}) and cascade.pair_warning("a", "b", {"a": "p", "b": "p"}) and cascade.pair_warning("a", "b", {"a": "p", "b": "q"}) is None
