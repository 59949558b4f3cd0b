"""Reference-shaped relations out of the test tables, by integer arithmetic that Spark and DuckDB do alike.

Each relation is SQL text with a few words that differ by dialect; sql(name) gives DuckDB's, frame(name) Spark's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.sources.scratch import pages_together

_OBS = """
select distinct cast(l_orderkey as bigint) ok, cast(l_partkey as bigint) pk, cast(l_suppkey as bigint) sk, cast(l_linenumber as int) ln,
  cast({floor}(l_quantity) as int) q, l_returnflag rf, l_linestatus ls from lineitem
"""

# Spark deals the lines to pages once, as narrow as they are; what is derived from them stays where its page is. "seen" is one
# condition on twin and sk there, so that no part of it goes below the exchange, which both readers then share.
_OBS_BY_PAGE = """
select distinct page, ok, pk, sk, ln, q, rf, ls from (select /*+ repartition(page) */ cast(l_orderkey div 200 as int) page, cast(l_orderkey as bigint) ok, cast(l_partkey as bigint) pk,
  cast(l_suppkey as bigint) sk, cast(l_linenumber as int) ln, cast(floor(l_quantity) as int) q, l_returnflag rf, l_linestatus ls from lineitem) l
"""

_BASE = """
select {page} page, ok, pk, sk, ln, q, rf, ls, cast(30 + (pk*7 + ln*13 + q) % 70 as int) conf_pct,
  cast((pk*37 + ln*211) % 4900 as int) x0, cast((sk*53 + ok*17) % 3200 as int) y0, cast((pk*37 + ln*211) % 4900 + 20 + q as int) x1, cast((sk*53 + ok*17) % 3200 + 18 as int) y1,
  case when pk % 17 = 0 then 'SS/CS RC' when pk % 19 = 0 then concat('REACTOR  COOLANT RC-E-1 (D-8) ', cast(20000 + pk % 20 as {text}), ' J INNER SEAL')
       when pk % 23 = 0 then concat('F-', cast(pk % 50 as {text})) when rf = 'A' then concat('V', cast(pk % 1000 as {text}))
       when rf = 'N' then concat('PI ', cast(pk % 1000 as {text})) else concat('PCV ', cast(pk % 1000 as {text})) end as text,
  case when pk % 19 = 0 then 'continuation_connection' when ls = 'O' then 'valve' else 'instrument_bubble' end kind,
  case when pk % 17 = 0 then 'diamond' when pk % 19 = 0 then 'hexagon' when ls = 'O' then 'bowtie valve' else 'circle' end symbol,
  case sk % 4 when 0 then 'ends on u-bend loop' when 1 then 'left of the u-bend' when 2 then 'PRIMARY SAMPLE PANEL' else '' end attached_to
from ({obs0}) o
"""

# Every third line of an order is seen a second time by the neighbouring tile, less sure and slightly off.
_ALL = """
select page, ok, pk, sk, ln, q, rf, ls, twin, conf_pct - 5 * twin conf_pct, x0 + 2 * twin x0, y0 + twin y0, x1 + 2 * twin x1, y1 + twin y1, text, kind, symbol, attached_to
from (select *, {each}(case when ln % 3 = 0 then {list01} else {list0} end) twin from ({base}) b) t
"""

# ord: a total order of readings, every column of the source packed into one number.
_ORD = "((((((ok % 200) * 1000000 + pk) * 100000 + sk) * 8 + ln) * 64 + q) * 2 + twin) * 6 + case rf when 'A' then 0 when 'N' then 1 else 2 end * 2 + case ls when 'O' then 0 else 1 end"

RELATIONS = {
    "obs": f"""
select page, {_ORD} ord, text, kind, symbol, attached_to, x0, y0, x1, y1, conf_pct, cast(conf_pct as double) / 100 confidence, pk, sk, ln, twin,
  concat('t', cast(10 + (x0 {{div}} 1063) + 5 * (y0 {{div}} 1063) as {{text}})) tile_id
from ({{all}}) a
""",
    "regions": f"""
select page, {_ORD} ord, x0 + pk % 3 x0, y0 + pk % 4 * 7 y0, x1 + pk % 3 x1, y1 + pk % 4 * 7 y1, cast(50 + pk % 50 as double) / 100 score, concat('t', cast(10 + (x0 {{div}} 1063) + 5 * (y0 {{div}} 1063) as {{text}})) tile_id
from ({{all}}) a where pk % 9 <> 0
""",
    "second": f"""
select page, {_ORD} ord, case when pk % 7 = 0 then concat(text, 'X') when pk % 5 = 0 then replace(text, ' ', '-') else text end as text, kind, symbol, attached_to,
  x0 + 3 x0, y0 + 2 y0, x1 + 3 x1, y1 + 2 y1, 30 + (pk * 11 + ln) % 70 conf_pct, cast(30 + (pk * 11 + ln) % 70 as double) / 100 confidence,
  concat('t', cast(10 + (x0 {{div}} 1063) + 5 * (y0 {{div}} 1063) as {{text}})) tile_id
from ({{all}}) a where {{seen}}
""",
    "pages_": "select distinct cast(l_orderkey {div} 200 as int) page, cast(900 + (l_orderkey {div} 200 * 137) % 6000 as int) width, cast(700 + (l_orderkey {div} 200 * 211) % 4000 as int) height from lineitem",
    "zones": """
with p as (select distinct cast(l_orderkey {div} 200 as int) page from lineitem)
select page, 0 no, 'notes' kind, 0 zx0, 0 zy0, 700 zx1, 500 zy1 from p
union all select page, 1, 'legend', 4000, 2500, 4900, 3200 from p
union all select page, 2, 'other', 2000, 1500, 2300, 1800 from p
""",
    "calls": """
select event_id, event_type layer, cast(null as {text}) role, concat('m', cast(event_id % 7 as {text})) model, case when event_id % 11 = 0 then 'error' else 'ok' end status,
  cast({floor}(value * 100) as double) latency, case when event_id % 3 = 0 then null else cast({floor}(value * 50) as double) end ttft, event_id % 5000 input_tokens, event_id % 900 output_tokens,
  case when event_id % 11 = 0 then concat('error ', cast(event_id % 4 as {text})) else null end error, cast(ts as timestamp) {at}
from events
""",
    "models": """
select concat('m', cast(i as {text})) model, concat('provider', cast(i % 3 as {text})) provider, case when i % 2 = 0 then 'flagship' else 'light' end tier,
  case when i = 4 then null else cast(i + 1 as double) end price_in, case when i = 4 then null else cast(5 * i + 3 as double) end price_out
from (select distinct event_id % 7 i from events) e
""",
    "runs": """
select cast(o_custkey % 50 as int) page, o_orderkey run_no, cast(o_orderdate as timestamp) run_at, case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 100 as double) / 100 end recall,
  o_orderkey % 30 matched, o_orderkey % 7 missed from orders
""",
    # One table per 20 parts; three readers, the second and third of whom misread some cells, and the third some shapes.
    "cells": """
select cast(p_partkey {div} 20 as int) table_index, r.reader_no, cast(p_partkey % 20 as int) row_no, c.col,
  case when (p_partkey * 7 + c.col * 3 + r.reader_no * 5) % 13 = 0 and r.reader_no > 1 then concat('x', cast(r.reader_no as {text}))
       when (p_partkey + c.col) % 6 = 0 and r.reader_no = 2 then concat(' ', case c.col when 0 then p_brand when 1 then p_type else cast(p_size as {text}) end, '  ')
       else case c.col when 0 then p_brand when 1 then p_type else cast(p_size as {text}) end end as cell
from part cross join (select 1 reader_no union all select 2 union all select 3) r cross join (select 0 col union all select 1 union all select 2) c
where not (r.reader_no = 3 and (p_partkey {div} 20) % 5 = 0 and p_partkey % 20 = 19)
""",
    "answer_key": """
select distinct page document_id, 'valves' category, case when pk % 8 = 0 then concat('V-', cast(pk % 1000 as {text})) else text end as value
  from ({base}) b where rf = 'A' and ls = 'O' and pk % 17 <> 0 and pk % 19 <> 0 and pk % 23 <> 0 and pk % 3 = 0
union all select distinct page, 'pressure_indicators', concat('PI', cast(pk % 1000 as {text})) from ({base}) b where rf = 'N' and pk % 5 = 0
union all select distinct page, 'filters', concat('F-', cast(pk % 60 as {text})) from ({base}) b where pk % 23 = 0
union all select distinct page, 'pid', concat('PID_1-SS-', cast(page as {text})) from ({base}) b where page % 4 <> 3
""",
}

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_WORDS = {"spark": {"div": "div", "floor": "floor", "text": "string", "at": "`at`", "each": "explode", "list01": "array(0, 1)", "list0": "array(0)", "page": "page", "seen": "coalesce(abs(sk % 6), 0) + 6 * twin between 1 and 5"}, "duckdb": {"div": "//", "floor": "floor", "text": "varchar", "at": '"at"', "each": "unnest", "list01": "[0, 1]", "list0": "[0]", "page": "cast(ok // 200 as int)", "seen": "twin = 0 and sk % 6 <> 0"}}


def sql(name: str, dialect: str = "duckdb") -> str:
    w = _WORDS[dialect]
    obs0 = (_OBS if dialect == "duckdb" else _OBS_BY_PAGE).format(**w)
    base = _BASE.format(obs0=obs0, **w)
    return RELATIONS[name].format(all=_ALL.format(base=base, **w), base=base, **w)


def with_relations(names: str, query: str) -> str:
    """DuckDB SQL: the named relations as CTEs, then the query, which may start with CTEs of its own (`with` left out)."""
    ctes = ",\n".join(f"{n} as materialized ({sql(n)})" for n in names.split())
    recursive = " recursive" if re.search(r"\bfold\b", query) else ""
    return f"with{recursive} {ctes}{',' if query.lstrip().startswith('+') else ''}\n{query.lstrip().lstrip('+')}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation in Spark; x0..y1 become the box `bbox`."""
    text = sql(name, "spark")
    if "repartition(page)" in text:
        pages_together(spark)
    used = [t for t in _TABLES if re.search(rf"\bfrom {t}\b", text)]
    for t in used:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    df = spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
    for names, box in ((("x0", "y0", "x1", "y1"), "bbox"), (("zx0", "zy0", "zx1", "zy1"), "bbox")):
        if set(names) <= set(df.columns):
            df = df.withColumn(box, F.struct(*[F.col(n).cast("int").alias(n.lstrip("z")) for n in names])).drop(*names)
    return df


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "obs").withColumns({"line_color": F.lit(None).cast("string"), "model": F.lit("first"), "sub_tile": F.lit(None).cast("int")})


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = frame(spark, sf_dir, "zones").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("no", "kind", "bbox"))).alias("z"))
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(c).alias("meaning")) for c in ("ss", "CS ")])
    return zones.select(
        "page", F.transform("z", lambda x: F.struct(x["kind"].alias("kind"), x["bbox"].alias("bbox"))).alias("suppress_regions"), codes.alias("system_prefixes"),
        F.concat(F.lit("PID-1-SS-"), F.col("page").cast("string")).alias("sheet_id"), F.lit("first").alias("model"),
    )


def table_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads of tables: page 0, rows by reader."""
    rows = frame(spark, sf_dir, "cells").groupBy("table_index", "reader_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("r"))
    reads = rows.groupBy("table_index", "reader_no").agg(F.array_sort(F.collect_list(F.struct("row_no", F.col("r.cell").alias("row")))).alias("rows"))
    return reads.select(
        F.lit(0).alias("page"), "table_index", "reader_no", F.concat(F.lit("r"), F.col("reader_no").cast("string")).alias("reader"), F.col("rows.row").alias("rows"),
        F.size("rows").alias("n_rows"), F.size(F.get("rows", F.lit(0))["row"]).alias("n_cols"), F.lit(1).alias("header_rows"),
        F.concat(F.lit("Table "), F.col("table_index").cast("string")).alias("title"),
        F.when(F.col("table_index") % 3 == 0, "revision_table").otherwise("data").alias("kind"), F.lit(1.0).alias("read_scale"),
    )


def rules():
    """A rule set that uses every mode on the proxy readings."""
    from drawlake.operators.rules import RuleSet

    return RuleSet(
        [
            {"category": "u_bend", "when": {"text": r"^PCV\s*\d", "kind": "instrument_bubble"}, "emit": "text",
             "verify": {"question": "Does the stem end on a loop?", "fallback_when": {"attached_to": "u-?bend|loop"}, "fallback_unless": {"attached_to": "(left|right) of the u-?bend"}}},
            {"category": "hexagons", "when": {"symbol": "hexagon"}, "unless": {"text": r"^\s*$"}, "emit": "text"},
            {"category": "codes", "when": {"symbol": "diamond"}, "emit": "split", "keep_legend_codes": True},
            {"category": "valves", "when": {"kind": "^valve$", "symbol": "valve|bowtie", "text": r"^V\d+\b"}, "emit": "capture", "pattern": r"^(V\d+)"},
            {"category": "pressure_indicators", "when": {"text": r"^PI\s*\d+"}, "emit": "capture", "pattern": r"^(PI\s*\d+)"},
            {"category": "prefixes", "when": {"kind": "instrument_bubble", "text": r"^[A-Z]{2,3}\s*\d"}, "emit": "capture", "pattern": r"^([A-Z]{2,3})\s*\d"},
            {"category": "filters", "when": {"text": r"^F-\d+$"}, "emit": "text", "min_conf": 0.5},
            {"category": "panels", "when": {"attached_to": "SAMPLE PANEL", "text": r"^F-\d+$"}, "emit": "template", "pattern_field": "attached_to", "pattern": r"((?:PRIMARY\s+)?SAMPLE\s+PANEL)", "template": "{name} {text}"},
            {"category": "coolant", "when": {"kind": "continuation_connection", "text": r"REACTOR\s+COOLANT"}, "emit": "connector_label", "strip": r"REACTOR\s+COOLANT"},
            {"category": "connectors", "when": {"kind": "continuation_connection"}, "emit": "connector_id"},
            {"category": "has_hexagon", "when": {"symbol": "hexagon"}, "emit": "const", "value": "yes"},
        ],
        {"strip": True, "collapse_whitespace": False, "join_tag_prefix": True, "uppercase": False}, ["notes", "legend", "title_block", "revision_table"], 0.35,
    )
