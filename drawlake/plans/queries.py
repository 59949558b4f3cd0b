"""The registered queries of the engine over the proxy relations, each beside its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.functions import geometry as G
from drawlake.functions import text as X
from drawlake.operators import assistant, benchmarks, cascade, review, scoring, spatial, stats, tables, verify
from drawlake.operators.resolve import Resolved, flagged, resolve, unclaimed_sample, unclassified
from drawlake.operators.rules import applied
from drawlake.plans.proxies import contexts, frame, observations, rules, table_reads, with_relations
from drawlake.sources.scratch import cut, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(relations: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_relations(relations, sql) if relations else sql
        return f

    return register


def flat(df: DataFrame, box: str = "bbox") -> list:
    return [F.col(f"{box}.{s}").alias(s) for s in ("x0", "y0", "x1", "y1")]


IOU = """(case when least({a}.x1,{b}.x1) > greatest({a}.x0,{b}.x0) and least({a}.y1,{b}.y1) > greatest({a}.y0,{b}.y0) then
  cast((least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0))*(least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0)) as double) /
  (({a}.x1-{a}.x0)*({a}.y1-{a}.y0)+({b}.x1-{b}.x0)*({b}.y1-{b}.y0)-(least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0))*(least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0))) else 0 end)"""
INSIDE = "(o.x0+o.x1 between 2*z.zx0 and 2*z.zx1 and o.y0+o.y1 between 2*z.zy0 and 2*z.zy1)"
IN_PROSE = f"exists (select 1 from zones z where z.page = o.page and z.kind in ('notes','legend') and {INSIDE})"
NORM = r"regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '^([A-Z]{1,4})\s+([0-9])', '\1\2')"
KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"

# kept: readings over the floor and outside of prose. unique_: the greedy seam dedupe, by recursion over the rank in a group.
KEPT = f"kept as materialized (select o.*, {NORM} norm_text from obs o where conf_pct >= 35 and not {IN_PROSE})"
UNIQUE = f"""{KEPT},
ranked as materialized (select *, row_number() over (partition by page, norm_text order by conf_pct desc, ord) rn, count(*) over (partition by page, norm_text) n from kept),
fold as (
  select page, norm_text, 1 rn, [struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, ord := ord)] acc from ranked where rn = 1
  union all
  select f.page, f.norm_text, f.rn + 1,
    case when len(list_filter(f.acc, lambda k: {IOU.format(a="k", b="r")} > 0.25)) > 0 then f.acc
         else list_append(f.acc, struct_pack(x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1, ord := r.ord)) end
  from fold f join ranked r on r.page = f.page and r.norm_text = f.norm_text and r.rn = f.rn + 1),
unique_ as materialized (
  select k.* from kept k join (select f.page, unnest(f.acc).ord ord from fold f join (select page, norm_text, max(n) n from ranked group by page, norm_text) m
    on m.page = f.page and m.norm_text = f.norm_text and m.n = f.rn) a on a.page = k.page and a.ord = k.ord)"""

_T = r"upper(trim(regexp_replace(text, '\s+', ' ', 'g')))"
CONNECTOR = rf"""(case when regexp_matches({_T}, '(^|[^A-Z0-9-])([A-Z])\s+([0-9]{{4,6}})\b') then concat(regexp_extract({_T}, '(^|[^A-Z0-9-])([A-Z])\s+([0-9]{{4,6}})\b', 2), regexp_extract({_T}, '(^|[^A-Z0-9-])([A-Z])\s+([0-9]{{4,6}})\b', 3))
  when regexp_matches({_T}, '\b([0-9]{{4,6}})\s+([A-Z])([^A-Z0-9]|$)') then concat(regexp_extract({_T}, '\b([0-9]{{4,6}})\s+([A-Z])([^A-Z0-9]|$)', 2), regexp_extract({_T}, '\b([0-9]{{4,6}})\s+([A-Z])([^A-Z0-9]|$)', 1))
  when regexp_matches({_T}, '\b[0-9]{{4,6}}\b') then regexp_extract({_T}, '\b([0-9]{{4,6}})\b', 1) end)"""
# On the proxy's labels: without the label, the grid reference, the number and its letter.
LABEL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(text), 'REACTOR\s+COOLANT', ' ', 'g'), '\(\s*[A-Z]{1,2}\s*-\s*[0-9]+\s*\)', ' ', 'g'), '\b[0-9]{4,6}\s+[A-Z]\b', ' ', 'g'), '\s+', ' ', 'g'))"


def emitted_sql(source: str) -> str:
    """rule, category, value rows of the proxy rule set over a relation of readings."""
    norm = lambda v: rf"regexp_replace(regexp_replace(trim({v}), '\s+', ' ', 'g'), '^([A-Z]{{1,4}})\s+([0-9])', '\1\2')"
    return rf"""
hits as (
  select 0 rule, 'u_bend' category, text raw, o.* from {source} o where regexp_matches(text, '^PCV\s*[0-9]') and kind = 'instrument_bubble' and regexp_matches(attached_to, 'u-?bend|loop') and not regexp_matches(attached_to, '(left|right) of the u-?bend')
  union all select 1, 'hexagons', text, o.* from {source} o where symbol = 'hexagon'
  union all select 2, 'codes', unnest(list_filter(string_split_regex(text, '[/|,\s]+'), lambda p: upper(trim(p)) in ('SS', 'CS'))), o.* from {source} o where symbol = 'diamond'
  union all select 3, 'valves', regexp_extract(text, '^(V[0-9]+)', 1), o.* from {source} o where kind = 'valve' and regexp_matches(symbol, 'valve|bowtie') and regexp_matches(text, '^V[0-9]+\b')
  union all select 4, 'pressure_indicators', regexp_extract(text, '^(PI\s*[0-9]+)', 1), o.* from {source} o where regexp_matches(text, '^PI\s*[0-9]+')
  union all select 5, 'prefixes', regexp_extract(text, '^([A-Z]{{2,3}})\s*[0-9]', 1), o.* from {source} o where kind = 'instrument_bubble' and regexp_matches(text, '^[A-Z]{{2,3}}\s*[0-9]')
  union all select 6, 'filters', text, o.* from {source} o where regexp_matches(text, '^F-[0-9]+$') and conf_pct >= 50
  union all select 7, 'panels', concat('PRIMARY SAMPLE PANEL ', text), o.* from {source} o where regexp_matches(text, '^F-[0-9]+$') and attached_to = 'PRIMARY SAMPLE PANEL'
  union all select 8, 'coolant', concat({CONNECTOR}, ' ', {LABEL}), o.* from {source} o where kind = 'continuation_connection' and regexp_matches(text, 'REACTOR\s+COOLANT')
  union all select 9, 'connectors', {CONNECTOR}, o.* from {source} o where kind = 'continuation_connection' and {CONNECTOR} is not null
  union all select 10, 'has_hexagon', 'yes', o.* from {source} o where symbol = 'hexagon'),
emitted as (select *, {norm("raw")} as value from hits where trim(raw) <> '')"""


def resolved(spark: SparkSession, sf_dir: str, keep: bool = False) -> Resolved:
    return resolve(observations(spark, sf_dir), contexts(spark, sf_dir), rules(), keep=keep)


# Geometry and filters -------------------------------------------------------------------------------------------------------


@query("pages_", """+ xs as (select page, width, height, unnest(list_distinct(list_concat(generate_series(0, greatest(width - 1250, 0), 1062), [greatest(width - 1250, 0)]))) x from pages_),
ys as (select page, unnest(list_distinct(list_concat(generate_series(0, greatest(height - 1250, 0), 1062), [greatest(height - 1250, 0)]))) y from pages_)
select xs.page, concat('t', lpad(cast(row_number() over (partition by xs.page order by y, x) - 1 as varchar), 2, '0')) tile_id, cast(x as int) x0, cast(y as int) y0,
  cast(least(x + 1250, width) as int) x1, cast(least(y + 1250, height) as int) y1 from xs join ys on xs.page = ys.page""")  # fmt: skip
def tile_grid(spark, sf_dir):
    grid = G.tile_grid(frame(spark, sf_dir, "pages_"))
    return grid.select("page", "tile_id", *flat(grid, "box"))


@query("obs", "select page, ord, cast(x0 as int) x0, greatest(0, (x0+x1)//2 - 450) cx0, greatest(0, (y0+y1)//2 - 450) cy0, least(4900, greatest(0, (x0+x1)//2 - 450) + 900) cx1, "
       "cast((x1-x0)*(y1-y0) as bigint) area, greatest(0, x0 - greatest(150, (x1-x0)//4)) px0, least(3200, y1 + greatest(150, (y1-y0)//4)) py1 from obs")  # fmt: skip
def box_windows(spark, sf_dir):
    b = F.col("bbox")
    w = G.crop_window(b, F.lit(4900), F.lit(3200))
    p = G.padded(b, F.lit(4900), F.lit(3200))
    return frame(spark, sf_dir, "obs").select("page", "ord", "bbox.x0", w["x0"].alias("cx0"), w["y0"].alias("cy0"), w["x1"].alias("cx1"), G.area(b).alias("area"), p["x0"].alias("px0"), p["y1"].alias("py1"))


@query("obs", f"select text, count(*) n, {NORM} norm, {KEY.format('text')} key_, length(text) <= 40 and regexp_matches(text, '[A-Za-z0-9]') taglike, "
       r"regexp_matches(text, '^[A-Za-z0-9][A-Za-z0-9\-/.''"" ]{1,11}$') and regexp_matches(text, '[A-Za-z]|[0-9]{2}') shaped, substr(sha1(text), 1, 8) hash, " + f"{CONNECTOR} connector from obs group by text")  # fmt: skip
def text_forms(spark, sf_dir):
    t = F.col("text")
    return frame(spark, sf_dir, "obs").groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(
        "text", "n", X.normalise(t).alias("norm"), X.key(t).alias("key_"), X.is_taglike(t).alias("taglike"), X.has_tag_shape(t).alias("shaped"), X.hash_id(t).alias("hash"), X.connector_id(t).alias("connector")
    )


@query("obs", "select page, ord from obs where conf_pct >= 35")
def confidence_floor(spark, sf_dir):
    return flagged(observations(spark, sf_dir), contexts(spark, sf_dir), rules()).where("not low").select("page", "ord")


@query("obs zones", f"select page, ord from obs o where conf_pct >= 35 and not {IN_PROSE}")
def zone_suppress(spark, sf_dir):
    return flagged(observations(spark, sf_dir), contexts(spark, sf_dir), rules()).where("not low and not suppressed").select("page", "ord")


# Resolve --------------------------------------------------------------------------------------------------------------------


@query("obs zones", f"+ {UNIQUE} select page, ord from unique_")
def seam_dedupe(spark, sf_dir):
    return resolved(spark, sf_dir).unique.select("page", "ord")


@query("obs", f"+ {emitted_sql('obs')} select page, ord, rule, category, value from emitted")
def rule_emissions(spark, sf_dir):
    codes = F.array(F.lit("SS"), F.lit("CS"))
    rows = frame(spark, sf_dir, "obs").select("page", "ord", F.explode(applied(rules(), codes)).alias("a"))
    return rows.select("page", "ord", "a.rule", "a.category", F.explode("a.values").alias("value"))


@query("obs zones", f"+ {UNIQUE}, {emitted_sql('unique_')} select distinct page, category, value from emitted union all select distinct page, 'pid', concat('PID-1-SS-', cast(page as varchar)) from zones")
def resolve_answers(spark, sf_dir):
    return resolved(spark, sf_dir).answers


@query("obs zones", f"+ {UNIQUE}, {emitted_sql('unique_')} select page, category, value, rule, ord, x0, y0, conf_pct from emitted qualify row_number() over (partition by page, category, value order by rule, conf_pct desc, ord) = 1")
def resolve_provenance(spark, sf_dir):
    p = resolved(spark, sf_dir).provenance
    return p.select("page", "category", "value", "rule", "ord", "bbox.x0", "bbox.y0", F.round(F.col("confidence") * 100).cast("int").alias("conf_pct"))


@query("obs zones", f"""+ {UNIQUE}, {emitted_sql('unique_')},
claimed as (select distinct page, ord from hits union select distinct page, ord from unique_ where symbol = 'diamond')
select o.page, o.n as input, o.low_confidence, o.n - o.low_confidence - k.n as suppressed, k.n - u.n as duplicates, u.n as resolved, u.n - coalesce(c.n, 0) as unclaimed
from (select page, count(*) n, count(*) filter (where conf_pct < 35) low_confidence from obs group by page) o
join (select page, count(*) n from kept group by page) k using (page) join (select page, count(*) n from unique_ group by page) u using (page)
left join (select page, count(*) n from claimed group by page) c using (page)""")  # fmt: skip
def audit_funnel(spark, sf_dir):
    return resolved(spark, sf_dir).audit


@query("obs zones", f"+ {UNIQUE}, {emitted_sql('unique_')} select u.page, u.ord, u.text, u.kind from unique_ u where u.symbol <> 'diamond' and not exists (select 1 from hits h where h.page = u.page and h.ord = u.ord)")
def unclaimed(spark, sf_dir):
    return resolved(spark, sf_dir).unclaimed.select("page", "ord", "text", "kind")


@query("obs zones", f"""+ {UNIQUE}, {emitted_sql('unique_')},
free as (select u.* from unique_ u where u.symbol <> 'diamond' and not exists (select 1 from hits h where h.page = u.page and h.ord = u.ord))
select page, text, kind, x0, y0 from free where kind not in ('annotation', 'line_label', 'other') qualify row_number() over (partition by page, upper(text) order by conf_pct desc, ord) = 1""")  # fmt: skip
def unclassified_tags(spark, sf_dir):
    return unclassified(resolved(spark, sf_dir).unclaimed).select("page", "text", "kind", "bbox.x0", "bbox.y0")


@query("obs zones", f"""+ {UNIQUE}, {emitted_sql('unique_')},
free as (select u.* from unique_ u where u.symbol <> 'diamond' and not exists (select 1 from hits h where h.page = u.page and h.ord = u.ord)),
one as (select * from free qualify row_number() over (partition by page, upper(trim(text)), kind order by ord) = 1)
select page, ord from one qualify row_number() over (partition by page order by ord) <= 150""")  # fmt: skip
def assistant_sample(spark, sf_dir):
    return unclaimed_sample(resolved(spark, sf_dir).unclaimed).select("page", "ord")


# Spatial --------------------------------------------------------------------------------------------------------------------

HAS_OBS = f"exists (select 1 from obs o where o.page = r.page and o.x1 > r.x0 and r.x1 > o.x0 and o.y1 > r.y0 and r.y1 > o.y0 and {IOU.format(a='r', b='o')} > 0.3)"
HAS_REGION = f"exists (select 1 from regions r where o.page = r.page and o.x1 > r.x0 and r.x1 > o.x0 and o.y1 > r.y0 and r.y1 > o.y0 and {IOU.format(a='r', b='o')} > 0.3)"


@query("obs regions", f"""select a.page, a.detector_regions, b.observations, a.matched, cast(a.matched as double) / a.detector_regions coverage, b.observations_without_detection from
(select page, count(*) detector_regions, count(*) filter (where {HAS_OBS}) matched from regions r group by page) a join
(select page, count(*) observations, count(*) filter (where not {HAS_REGION}) observations_without_detection from obs o group by page) b using (page)""")  # fmt: skip
def coverage(spark, sf_dir):
    return spatial.coverage(frame(spark, sf_dir, "regions"), frame(spark, sf_dir, "obs"))


@query("obs regions", f"select page, ord from regions r where not {HAS_OBS}")
def unmatched_regions(spark, sf_dir):
    return spatial.without_match(frame(spark, sf_dir, "regions"), frame(spark, sf_dir, "obs")).select("page", "ord")


@query("obs regions", "select page, ord from regions r where not exists (select 1 from obs o where o.page = r.page and (r.x0+r.x1 between 2*o.x0 and 2*o.x1 and r.y0+r.y1 between 2*o.y0 and 2*o.y1 or o.x0+o.x1 between 2*r.x0 and 2*r.x1 and o.y0+o.y1 between 2*r.y0 and 2*r.y1))")
def unread_regions(spark, sf_dir):
    return spatial.unread(frame(spark, sf_dir, "regions"), frame(spark, sf_dir, "obs")).select("page", "ord")


@query("obs regions", f"""select r.page, r.ord, o.ord obs_ord, {IOU.format(a='r', b='o')} iou from regions r join obs o on o.page = r.page and o.x1 > r.x0 and r.x1 > o.x0 and o.y1 > r.y0 and r.y1 > o.y0
where {IOU.format(a='r', b='o')} > 0.25 qualify row_number() over (partition by r.page, r.ord order by iou desc, o.ord) = 1""")  # fmt: skip
def best_overlap(spark, sf_dir):
    return spatial.best_overlap(frame(spark, sf_dir, "regions"), frame(spark, sf_dir, "obs"))


@query("regions", f"""+ e as (select a.page, a.ord, any_value(a.score) score, list(b.ord) preds from regions a join regions b on a.page = b.page and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)
  and (b.score > a.score or b.score = a.score and b.ord < a.ord) where {IOU.format(a='a', b='b')} > 0.4 group by a.page, a.ord),
r as materialized (select *, row_number() over (partition by page order by score desc, ord) rn, count(*) over (partition by page) n from e),
fold as (select distinct page, cast(0 as bigint) rn, cast([] as bigint[]) acc from r union all
  select f.page, f.rn + 1, case when len(list_filter(r.preds, lambda p: not list_contains(f.acc, p))) > 0 then list_append(f.acc, r.ord) else f.acc end from fold f join r on r.page = f.page and r.rn = f.rn + 1),
dropped as (select f.page, unnest(f.acc) ord from fold f join (select page, max(n) n from r group by page) m on m.page = f.page and m.n = f.rn)
select page, ord, score from regions g where not exists (select 1 from dropped d where d.page = g.page and d.ord = g.ord)""")  # fmt: skip
def nms_regions(spark, sf_dir):
    return spatial.suppress_overlaps(frame(spark, sf_dir, "regions")).select("page", "ord", "score")


@query("regions", """select page, count(*) regions, count(*) filter (where y1 - y0 < 40) small_regions, list_sort(list(cast(y1 - y0 as int)))[count(*) // 2 + 1] median_height from regions group by page""")
def region_sizes(spark, sf_dir):
    return benchmarks.region_sizes(frame(spark, sf_dir, "regions"))


# Two readers ----------------------------------------------------------------------------------------------------------------


def _compared(spark, sf_dir):
    first, second = cut(observations(spark, sf_dir)), cut(frame(spark, sf_dir, "second"))  # read twice
    names = ["page", "ord", "text", "kind", "symbol", "attached_to", "bbox", "confidence", "tile_id"]
    a = first.select(*names, F.lit("first").alias("model"))
    b = second.select(*names, F.lit("second").alias("model"))
    return cascade.compare(a, b)


def _rulings(items):
    """Rulings on two of three escalated disputes: one reading, one denial."""
    return items.where("escalate and gi % 3 < 2").select(
        "page", "gi", (F.col("gi") % 3 == 0).alias("present"), F.coalesce("claim_a", "claim_b").alias("text"), F.lit("").alias("kind"), F.lit("").alias("symbol"),
        F.lit("").alias("attached_to"), F.lit(0.95).alias("confidence"), F.lit("third").alias("model"),
    )


# matched: the greedy fold over readings of the first reader, each with its possible partners, best first.
MATCHED = f"""+ a_ as materialized (select * from obs),
pairs as (select a.page, a.ord a_ord, b.ord b_ord, {IOU.format(a="a", b="b")} iou from a_ a join second b on a.page = b.page and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)),
cand as materialized (select page, a_ord, list(b_ord order by iou desc, b_ord) bs, row_number() over (partition by page order by a_ord) rn, count(*) over (partition by page) n from pairs where iou >= 0.2 group by page, a_ord),
fold as (select distinct page, cast(0 as bigint) rn, cast([] as bigint[]) used, cast([] as bigint[]) takers from cand union all
  select f.page, f.rn + 1, case when len(list_filter(c.bs, lambda b: not list_contains(f.used, b))) > 0 then list_append(f.used, list_filter(c.bs, lambda b: not list_contains(f.used, b))[1]) else f.used end,
    case when len(list_filter(c.bs, lambda b: not list_contains(f.used, b))) > 0 then list_append(f.takers, c.a_ord) else f.takers end
  from fold f join cand c on c.page = f.page and c.rn = f.rn + 1),
matched as materialized (select f.page, unnest(f.takers) a_ord, unnest(f.used) b_ord from fold f join (select page, max(n) n from cand group by page) m on m.page = f.page and m.n = f.rn)"""
WORTH = f"(length(o.text) <= 40 and regexp_matches(o.text, '[A-Za-z0-9]') and not exists (select 1 from zones z where z.page = o.page and {INSIDE}))"


@query("obs second", MATCHED + " select page, a_ord, b_ord from matched")
def reader_matches(spark, sf_dir):
    first, second = observations(spark, sf_dir), frame(spark, sf_dir, "second")
    return spatial.greedy_match(first, second).select("page", "a_ord", "b_ord")


@query("obs second zones", MATCHED + f""",
worth_a as (select o.page, o.ord, {WORTH} w from a_ o), worth_b as (select o.page, o.ord, {WORTH} w from second o),
pairs_ as (select m.page, {KEY.format('a.text')} = {KEY.format('b.text')} same, wa.w or wb.w w, a.tile_id from matched m join a_ a on a.page = m.page and a.ord = m.a_ord join second b on b.page = m.page and b.ord = m.b_ord
  join worth_a wa on wa.page = m.page and wa.ord = m.a_ord join worth_b wb on wb.page = m.page and wb.ord = m.b_ord),
disputes as (select page, 'conflict' kind, w, tile_id from pairs_ where not same
  union all select a.page, 'solo_a', w.w, a.tile_id from a_ a join worth_a w on w.page = a.page and w.ord = a.ord where not exists (select 1 from matched m where m.page = a.page and m.a_ord = a.ord)
  union all select b.page, 'solo_b', w.w, b.tile_id from second b join worth_b w on w.page = b.page and w.ord = b.ord where not exists (select 1 from matched m where m.page = b.page and m.b_ord = b.ord)),
d as (select page, count(*) disputes, count(*) filter (where w) escalated, count(*) filter (where kind = 'conflict') conflicts, count(distinct tile_id) tiles from disputes group by page),
g as (select page, count(*) filter (where same) agreed from pairs_ group by page)
select page, agreed, disputes, escalated, conflicts, tiles, cast(agreed as double) / (agreed + disputes) agreement_rate from d join g using (page)""")  # fmt: skip
def compare_readers(spark, sf_dir):
    c = _compared(spark, sf_dir)
    return cascade.agreement(c, cascade.disputes(c, contexts(spark, sf_dir)))


DISPUTES = MATCHED + f""",
worth_a as (select o.page, o.ord, {WORTH} w from a_ o), worth_b as (select o.page, o.ord, {WORTH} w from second o),
pairs_ as (select m.page, a.ord, {KEY.format('a.text')} = {KEY.format('b.text')} same, wa.w or wb.w w, a.tile_id, a.text ta, b.text tb from matched m join a_ a on a.page = m.page and a.ord = m.a_ord join second b on b.page = m.page and b.ord = m.b_ord
  join worth_a wa on wa.page = m.page and wa.ord = m.a_ord join worth_b wb on wb.page = m.page and wb.ord = m.b_ord),
listed as (select page, 'conflict' kind, ord, w, tile_id, ta, tb from pairs_ where not same
  union all select a.page, 'solo_a', a.ord, w.w, a.tile_id, a.text, null from a_ a join worth_a w on w.page = a.page and w.ord = a.ord where not exists (select 1 from matched m where m.page = a.page and m.a_ord = a.ord)
  union all select b.page, 'solo_b', b.ord, w.w, b.tile_id, null, b.text from second b join worth_b w on w.page = b.page and w.ord = b.ord where not exists (select 1 from matched m where m.page = b.page and m.b_ord = b.ord)),
disputes as materialized (select *, row_number() over (partition by page order by kind, ord) - 1 gi from listed)"""


@query("obs second zones", DISPUTES + """, n as (select *, row_number() over (partition by page, tile_id order by gi) - 1 n from disputes where w)
select page, gi, kind, tile_id, n // 30 chunk, cast(n % 30 as int) id, ta claim_a, tb claim_b from n""")  # fmt: skip
def dispute_chunks(spark, sf_dir):
    names = ["page", "ord", "text", "bbox", "tile_id"]  # all that is asked of the readings
    both = cascade.compare(observations(spark, sf_dir).select(*names), frame(spark, sf_dir, "second").select(*names), keep=False)  # read once
    items = cascade.disputes(both, contexts(spark, sf_dir))
    return cascade.chunks(items).select("page", "gi", "kind", "tile_id", "chunk", "id", "claim_a", "claim_b")


@query("obs second zones", DISPUTES + " select distinct page, tile_id from disputes where coalesce(tile_id, '') <> ''")
def review_tiles(spark, sf_dir):
    """The tiles that hold a dispute."""
    return cascade.tiles_to_review(cascade.disputes(_compared(spark, sf_dir), contexts(spark, sf_dir)))


@query("obs second zones", DISPUTES + """, g as (select page, count(*) agreed from pairs_ where same group by page),
d as (select page, count(*) filter (where w and gi % 3 = 0) adjudicated, count(*) filter (where not w or gi % 3 = 2) kept_unsettled, count(*) filter (where w and gi % 3 = 1) dropped_as_absent from disputes group by page)
select page, agreed, adjudicated, kept_unsettled, dropped_as_absent from g join d using (page)""")  # fmt: skip
def cascade_merge(spark, sf_dir):
    c = _compared(spark, sf_dir)
    items = cascade.disputes(c, contexts(spark, sf_dir))
    rulings = _rulings(items)
    return cascade.merge_counts(cascade.merge(c, items, rulings), items, rulings)


# Tables ---------------------------------------------------------------------------------------------------------------------

VOTED = r"""+ shapes as (select table_index, reader_no, count(distinct row_no) n_rows, count(distinct col) n_cols from cells group by table_index, reader_no),
odd as (select a.table_index from shapes a join shapes b on a.table_index = b.table_index join shapes c on a.table_index = c.table_index where a.reader_no = 1 and b.reader_no = 2 and c.reader_no = 3
  and (a.n_rows <> b.n_rows) and b.n_rows = c.n_rows),
voters as (select s.table_index, s.reader_no from shapes s join shapes b on b.table_index = s.table_index and b.reader_no = 1 where s.n_rows = b.n_rows and s.n_cols = b.n_cols),
options as (select c.table_index, c.row_no, c.col, c.reader_no, c.cell, trim(regexp_replace(c.cell, '\s+', ' ', 'g')) norm from cells c join voters v on v.table_index = c.table_index and v.reader_no = c.reader_no),
counted as (select *, count(*) over (partition by table_index, row_no, col, norm) same from options),
won as (select table_index, row_no, col, coalesce(arg_min(cell, reader_no) filter (where same >= 2), arg_min(cell, reader_no)) as cell, max(same) >= 2 as agreed, count(distinct norm) = 1 and count(*) > 1 as unanimous, count(*) readers
  from counted group by table_index, row_no, col)"""


@query("cells", VOTED + " select table_index, cast(row_no as int) row_no, col, cell from won")
def table_vote(spark, sf_dir):
    voted = tables.vote(table_reads(spark, sf_dir))
    return voted.select("table_index", F.posexplode("rows").alias("row_no", "r")).select("table_index", "row_no", F.posexplode("r").alias("col", "cell"))


@query("cells", VOTED + " select table_index, count(*) filter (where not agreed and readers > 1) disputed, cast(count(*) filter (where unanimous) as double) / count(*) cell_agreement, max(readers) readers from won group by table_index")
def table_agreement(spark, sf_dir):
    return tables.vote(table_reads(spark, sf_dir)).select("table_index", F.size("disputed").cast("long").alias("disputed"), "cell_agreement", F.size("readers").cast("long").alias("readers"))


@query("cells", VOTED + """, lines as (select table_index, row_no, string_agg(cell, ',' order by col) line, '| ' || string_agg(cell, ' | ' order by col) || ' |' md from won group by table_index, row_no)
select table_index, string_agg(line || chr(13) || chr(10), '' order by row_no) csv,
  '### Table ' || table_index || case when table_index % 3 = 0 then ' *(revision table — drawing administration)*' else '' end || chr(10) || chr(10) ||
  max(md) filter (where row_no = first_row) || chr(10) || '| --- | --- | --- |' || chr(10) || coalesce(string_agg(md || chr(10), '' order by row_no) filter (where row_no > first_row), '') markdown
from (select *, min(row_no) over (partition by table_index) first_row from lines) l group by table_index""")  # fmt: skip
def table_texts(spark, sf_dir):
    from drawlake.sources.writers import table_texts as texts

    return texts(tables.vote(table_reads(spark, sf_dir))).select("table_index", "csv", "markdown")


@query("cells", r"""+ c as (select table_index, reader_no, row_no, col, upper(trim(regexp_replace(cell, '\s+', ' ', 'g'))) as cell from cells),
hits as (select g.table_index, r.reader_no, g.row_no g_no, r.row_no r_no, count(*) n from c g join c r on g.table_index = r.table_index and g.col = r.col and g.cell = r.cell
  where g.reader_no = 1 and r.reader_no > 1 and g.cell <> '' group by 1, 2, 3, 4),
cand as materialized (select table_index, reader_no, g_no, list(r_no order by n desc, r_no) rs, row_number() over (partition by table_index, reader_no order by g_no) k, count(*) over (partition by table_index, reader_no) m from hits group by 1, 2, 3),
fold as (select distinct table_index, reader_no, cast(0 as bigint) k, cast([] as int[]) used, cast([] as int[]) takers from cand union all
  select f.table_index, f.reader_no, f.k + 1, case when len(list_filter(c.rs, lambda r: not list_contains(f.used, r))) > 0 then list_append(f.used, list_filter(c.rs, lambda r: not list_contains(f.used, r))[1]) else f.used end,
    case when len(list_filter(c.rs, lambda r: not list_contains(f.used, r))) > 0 then list_append(f.takers, c.g_no) else f.takers end
  from fold f join cand c on c.table_index = f.table_index and c.reader_no = f.reader_no and c.k = f.k + 1),
pairs as (select f.table_index, f.reader_no, unnest(f.takers) g_no, unnest(f.used) r_no from fold f join (select table_index, reader_no, max(m) m from cand group by 1, 2) x on x.table_index = f.table_index and x.reader_no = f.reader_no and x.m = f.k),
firsts as (select table_index, min(row_no) first_row from c where reader_no = 1 group by 1),
cmp as (select n.table_index, n.reader_no, g.row_no = w.first_row header, g.cell g, r.cell r from (select distinct table_index, reader_no from c where reader_no > 1) n join c g on g.table_index = n.table_index and g.reader_no = 1
  join firsts w on w.table_index = n.table_index left join pairs p on p.table_index = n.table_index and p.reader_no = n.reader_no and p.g_no = g.row_no
  left join c r on r.table_index = n.table_index and r.reader_no = n.reader_no and r.row_no = p.r_no and r.col = g.col)
select 0 page, table_index, concat('r', cast(reader_no as varchar)) reader, count(*) filter (where not header) data_cells, count(*) filter (where not header and g = r) data_exact, count(*) filter (where header) header_cells,
  count(*) filter (where header and g = r) header_exact, count(*) filter (where r <> '' and r <> g and replace(r, 'Y', 'V') = replace(g, 'Y', 'V')) v_y_swaps from cmp group by table_index, reader_no""")  # fmt: skip
def row_alignment(spark, sf_dir):
    reads = table_reads(spark, sf_dir)
    gold = reads.where("reader_no = 1").select("page", "table_index", "rows", "header_rows")
    return benchmarks.align_rows(gold, reads.where("reader_no > 1").select("page", "table_index", "reader", "rows"))


# Scoring --------------------------------------------------------------------------------------------------------------------

SCORED = f"""+ {UNIQUE}, {emitted_sql('unique_')}, answers as (select distinct page, category, value from emitted union all select distinct page, 'pid', concat('PID-1-SS-', cast(page as varchar)) from zones),
keyed as (select distinct document_id page from answer_key where category = 'pid'),
expected as (select k.document_id page, k.category, k.value, {KEY.format('k.value')} kk from answer_key k join keyed on keyed.page = k.document_id),
got as (select a.page, a.category, a.value, {KEY.format('a.value')} kk from answers a join keyed using (page)),
e as (select page, category, count(*) expected, count(*) filter (where exists (select 1 from got g where g.page = x.page and g.category = x.category and g.kk = x.kk)) found,
  count(*) filter (where exists (select 1 from got g where g.page = x.page and g.category = x.category and g.value = x.value)) exact from expected x group by page, category),
g as (select page, category, count(*) got, count(*) filter (where not exists (select 1 from expected x where x.page = g.page and x.category = g.category and x.kk = g.kk)) extra from got g group by page, category),
scored as (select page, category, e.expected is not null in_key, coalesce(e.expected, 0) expected, coalesce(g.got, 0) got, coalesce(e.found, 0) found, coalesce(e.expected - e.found, 0) missed, coalesce(g.extra, 0) extra,
  coalesce(e.found - e.exact, 0) cleanup_only, cast(e.found as double) / e.expected recall from e full join g using (page, category))"""


def _scored(spark, sf_dir, answers=None):
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    pages = scoring.documents_of_sheets(contexts(spark, sf_dir), key)
    return scoring.score_categories(resolved(spark, sf_dir).answers if answers is None else answers, key, pages)


@query("obs zones answer_key", SCORED + " select * from scored")
def score_categories(spark, sf_dir):
    n = lambda c: F.size(c).cast("long").alias(c)
    return _scored(spark, sf_dir).select("page", "category", "in_key", n("expected"), n("got"), n("found"), n("missed"), n("extra"), n("cleanup_only"), "recall")


@query("obs zones answer_key", SCORED + """ select page, cast(sum(found) as bigint) matched, cast(sum(missed) as bigint) missed, cast(sum(extra) as bigint) extra, cast(sum(cleanup_only) as bigint) cleanup_only_matched,
cast(sum(found) - sum(cleanup_only) as bigint) exact_matched, cast(sum(found) as double) / (sum(found) + sum(missed)) recall, cast(sum(found) as double) / (sum(found) + sum(extra)) key_precision from scored where in_key group by page""")  # fmt: skip
def score_totals(spark, sf_dir):
    return scoring.totals(_scored(spark, sf_dir))


@query("obs zones answer_key", SCORED + " select page, category, value, cast(coalesce((select count(*) from expected x where x.page = g.page and x.category = g.category), 0) as int) expected_n from got g where not exists (select 1 from expected x where x.page = g.page and x.category = g.category and x.kk = g.kk)")
def extra_values(spark, sf_dir):
    return scoring.extra_values(_scored(spark, sf_dir))


# Review ---------------------------------------------------------------------------------------------------------------------


def _reviewed(spark, sf_dir) -> tuple[Resolved, DataFrame]:
    """What the rules make of the readings, and the readings, which every branch of the queue reads once more: from the lines,
    since a copy of them is many times the input."""
    o = observations(spark, sf_dir)
    needed = o.select("page", "ord", "text", "kind", "symbol", "attached_to", "bbox", "confidence", "tile_id")
    return resolve(needed, contexts(spark, sf_dir), rules(), keep=True, keep_unique=False), o


def _queue(spark, sf_dir, r: Resolved, o: DataFrame):
    null = F.lit(None).cast("string")
    # Some readings carry a ruling, as a merged reading of two would.
    source = F.when(F.col("pk") % 6 == 0, "adjudicated").otherwise("agreed")
    o = o.withColumns({"source": source, "dispute": F.when(F.col("pk") % 12 == 0, "conflict").otherwise("solo_a"), "claim_a": F.when(F.col("sk") % 2 == 0, F.col("text")), "claim_b": null})
    return review.queue(r.provenance, o, frame(spark, sf_dir, "regions"), contexts(spark, sf_dir), scoring.extra_values(_scored(spark, sf_dir, r.answers)))


def _sql_id(category: str, kind: str, bbox: str = "") -> str:
    at = f"cast(cast(round_even(({bbox}x0 + {bbox}x1) / 64.0, 0) as bigint) as varchar), ',', cast(cast(round_even(({bbox}y0 + {bbox}y1) / 64.0, 0) as bigint) as varchar)"
    valued = f"concat(cast(page as varchar), '|', {kind}, '|', coalesce({category}, ''), '|', {KEY.format('value')})"
    return f"substr(sha1(case when {KEY.format('value')} <> '' then {valued} else concat(cast(page as varchar), '|', {kind}, '|@', {at}) end), 1, 12)"


QUEUE = SCORED + rf""",
prov as (select page, category, value, rule, tile_id, x0, y0, x1, y1 from emitted qualify row_number() over (partition by page, category, value order by rule, conf_pct desc, ord) = 1),
last_ as (select * from obs qualify row_number() over (partition by page, x0, y0, x1, y1 order by ord desc) = 1),
traced as (select p.*, case when l.pk % 12 = 0 then 'contested' else 'solo' end kind, case when l.sk % 2 = 0 then l.text end claim_a from prov p
  join last_ l on l.page = p.page and l.x0 = p.x0 and l.y0 = p.y0 and l.x1 = p.x1 and l.y1 = p.y1 where l.pk % 6 = 0),
zoned as (select o.*, z.kind zone from obs o join zones z on z.page = o.page and {INSIDE} qualify row_number() over (partition by o.page, o.ord order by z.no) = 1),
items_ as (
  select page, kind, category, value, cast(null as varchar) zone, tile_id, rule, claim_a, case when kind = 'solo' then case when coalesce(claim_a, '') <> '' then 'model A' else 'model B' end end seen_by, cast(null as double) det_score, cast(null as int) expected_n, x0, y0, x1, y1 from traced
  union all select page, 'suppressed', null, trim(text), zone, tile_id, null, null, null, null, null, x0, y0, x1, y1 from zoned
    where regexp_matches(trim(text), '^[A-Za-z0-9][A-Za-z0-9\-/."'' ]{{1,11}}$') and regexp_matches(trim(text), '[A-Za-z]|[0-9]{{2}}')
  union all select page, 'unread', null, '', null, null, null, null, null, round_even(score, 3), null, x0, y0, x1, y1 from regions r where not exists (select 1 from obs o where o.page = r.page
    and (r.x0+r.x1 between 2*o.x0 and 2*o.x1 and r.y0+r.y1 between 2*o.y0 and 2*o.y1 or o.x0+o.x1 between 2*r.x0 and 2*r.x1 and o.y0+o.y1 between 2*r.y0 and 2*r.y1))
  union all select g.page, 'not_in_key', g.category, g.value, null, null, null, null, null, null, cast(coalesce((select count(*) from expected x where x.page = g.page and x.category = g.category), 0) as int), p.x0, p.y0, p.x1, p.y1
    from got g left join prov p on p.page = g.page and p.category = g.category and p.value = g.value
    where not exists (select 1 from expected x where x.page = g.page and x.category = g.category and x.kk = g.kk)),
items as materialized (select *, {_sql_id("category", "kind")} id, case kind when 'contested' then 0 when 'solo' then 1 when 'suppressed' then 2 when 'unread' then 3 else 4 end priority from items_),
decided as materialized (select *, strpos('0123456789abcdef', substr(id, 1, 1)) - 1 h from items where category is not null and substr(id, 1, 1) in ('0', '1', '2'))"""


@query("obs zones answer_key regions", QUEUE + " select page, id, kind, category, value, priority, zone, tile_id, rule, claim_a, seen_by, det_score, expected_n from items")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir, *_reviewed(spark, sf_dir)).select("page", "id", "kind", "category", "value", "priority", "zone", "tile_id", "rule", "claim_a", "seen_by", "det_score", "expected_n")


@query("obs", f"""select page, ord, substr(sha1(case when {KEY.format('text')} <> '' and pk % 4 <> 0 then concat(cast(page as varchar), '|', kind, '|', symbol, '|', {KEY.format('text')})
  else concat(cast(page as varchar), '|', kind, '|@', cast(cast(round_even((x0 + x1) / 64.0, 0) as bigint) as varchar), ',', cast(cast(round_even((y0 + y1) / 64.0, 0) as bigint) as varchar)) end), 1, 12) id from obs""")  # fmt: skip
def item_id(spark, sf_dir):
    value = F.when(F.col("pk") % 4 != 0, F.col("text")).otherwise("")
    return frame(spark, sf_dir, "obs").select("page", "ord", review.item_id(F.col("page"), F.col("kind"), value, F.col("bbox"), F.col("symbol")).alias("id"))


@query("obs zones", f"+ hit as (select o.*, z.kind zone, row_number() over (partition by o.page, o.ord order by z.no) n from obs o join zones z on z.page = o.page and {INSIDE}) select page, ord, zone from hit where n = 1")
def zone_of_reading(spark, sf_dir):
    o = frame(spark, sf_dir, "obs").join(contexts(spark, sf_dir).select("page", "suppress_regions"), "page")
    return o.withColumn("z", spatial.first_zone(F.col("suppress_regions"), F.col("bbox"))).where("z is not null").select("page", "ord", F.col("z.kind").alias("zone"))


def _decisions(items):
    """Decisions on the items of a category whose id starts with 0 (accept), 1 (reject) or 2 (correct)."""
    n = F.instr(F.lit("012"), F.substring("id", 1, 1)) - 1
    return items.where(F.col("category").isNotNull() & (n >= 0)).dropDuplicates(["page", "id"]).select(
        "page", "id", F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("correct")), (n + 1).cast("int")).alias("action"),
        F.when(n == 2, F.concat(F.lit("C"), F.col("value"))).alias("corrected"), F.lit(None).cast("string").alias("note"), F.lit("reviewer").alias("by"), F.lit("2024-01-01").cast("timestamp").alias("at"),
    )


def _decided(spark, sf_dir, r: Resolved, o: DataFrame):
    items = stored(_queue(spark, sf_dir, r, o).drop("decision"))
    return items.join(review.latest(_decisions(items)), ["page", "id"], "left")


@query("obs zones answer_key regions", QUEUE + """, n as (select i.page, i.kind, case when i.category is not null and substr(i.id, 1, 1) in ('0', '1', '2') then 1 else 0 end d from items i)
select page, kind, count(*) total, cast(sum(d) as bigint) decided, cast(count(*) - sum(d) as bigint) as open from n group by grouping sets ((page, kind), (page))""")  # fmt: skip
def review_summary(spark, sf_dir):
    return review.summary(_decided(spark, sf_dir, *_reviewed(spark, sf_dir)))


@query("obs zones answer_key regions", QUEUE + """, fix as (select page, category, value, h from decided d where h > 0 and exists (select 1 from answers a where a.page = d.page and a.category = d.category)
  qualify row_number() over (partition by page, category, value order by priority, id) = 1)
select distinct coalesce(a.page, f.page) page, coalesce(a.category, f.category) category, case when f.h = 2 then concat('C', f.value) else a.value end as value
from answers a full join fix f on f.page = a.page and f.category = a.category and f.value = a.value where coalesce(f.h, 0) <> 1""")  # fmt: skip
def apply_decisions(spark, sf_dir):
    r, o = _reviewed(spark, sf_dir)
    return review.decided_answers(r.answers, _decided(spark, sf_dir, r, o))


# Verify ---------------------------------------------------------------------------------------------------------------------


@query("obs", rf"""select page, 'u_bend' category, concat('u_bend|', {KEY.format('text')}) tag_key, ord, substr(sha1('Does the stem end on a loop?'), 1, 8) question_hash from obs
where regexp_matches(text, '^PCV\s*[0-9]') and kind = 'instrument_bubble' qualify row_number() over (partition by page, tag_key order by conf_pct desc, ord) = 1""")  # fmt: skip
def verify_candidates(spark, sf_dir):
    return verify.candidates(frame(spark, sf_dir, "obs"), rules()).select("page", "category", "tag_key", "ord", "question_hash")


def _verdicts(asked):
    return asked.where("ord div 6 % 3 < 2").select(
        "page", "category", "tag_key", F.when(F.expr("ord div 6 % 3 = 0"), "yes").otherwise("no").alias("answer"), F.when(F.expr("ord div 6 % 5 = 0"), "stale").otherwise(F.col("question_hash")).alias("question_hash")
    )


@query("obs", rf"""+ asked as (select page, concat('u_bend|', {KEY.format('text')}) tag_key, ord from obs
where regexp_matches(text, '^PCV\s*[0-9]') and kind = 'instrument_bubble' qualify row_number() over (partition by page, tag_key order by conf_pct desc, ord) = 1)
select page, tag_key from asked where ord // 6 % 3 = 2 or ord // 6 % 5 = 0""")  # fmt: skip
def verify_todo(spark, sf_dir):
    asked = verify.candidates(frame(spark, sf_dir, "obs"), rules())
    return verify.todo(asked, verify.current(_verdicts(asked), rules())).select("page", "tag_key")


@query("obs", rf"""+ hits as (select *, {KEY.format('text')} tag from obs where regexp_matches(text, '^PCV\s*[0-9]') and kind = 'instrument_bubble'),
led as (select *, first_value(ord) over (partition by page, tag order by conf_pct desc, ord) // 6 lead from hits)
select page, ord, case when lead % 3 < 2 and lead % 5 <> 0 then lead % 3 = 0
  else regexp_matches(attached_to, 'u-?bend|loop') and not regexp_matches(attached_to, '(left|right) of the u-?bend') end passes from led""")  # fmt: skip
def visual_verdict_fallback(spark, sf_dir):
    from drawlake.operators.resolve import verdict_maps
    from drawlake.operators.rules import all_match, matches

    o, rule = frame(spark, sf_dir, "obs"), rules().rules[0]
    maps = verdict_maps(verify.current(_verdicts(verify.candidates(o, rules())), rules())).withColumnRenamed("page", "v_page")
    hits = o.where(all_match(rule["when"])).join(maps, (F.col("page") == F.col("v_page")) & (X.key(F.col("text")) == F.col("tag")), "left")
    return hits.select("page", "ord", matches(rule, F.col("verdicts")).alias("passes"))


@query("obs", f"""+ c as (select page, ord c_ord, {CONNECTOR} cid, x0, y0, x1, y1 from obs where kind = 'continuation_connection'), v as (select page, ord, cast(20000 + pk % 20 as varchar) number, x0, y0, x1, y1 from obs where kind = 'valve')
select v.page, v.ord, c.c_ord, (abs(v.x0 + v.x1 - c.x0 - c.x1) + abs(v.y0 + v.y1 - c.y0 - c.y1)) / 2.0 d from v join c on c.page = v.page and c.cid = concat('J', v.number)
qualify row_number() over (partition by v.page, v.ord order by d, c_ord) = 1""")  # fmt: skip
def nearest_connector(spark, sf_dir):
    o = frame(spark, sf_dir, "obs")
    c = o.where("kind = 'continuation_connection'").select("page", F.col("ord").alias("c_ord"), X.connector_id(F.col("text")).alias("cid"), F.col("bbox").alias("other"))
    v = o.where("kind = 'valve'").select("page", "ord", "bbox", F.concat(F.lit("J"), (F.lit(20000) + F.col("pk") % 20).cast("string")).alias("cid"))
    near = v.join(c, ["page", "cid"]).withColumn("d", G.manhattan(F.col("bbox"), F.col("other")))
    return near.groupBy("page", "ord").agg(F.min(F.struct("d", "c_ord")).alias("m")).select("page", "ord", "m.c_ord", "m.d")


# Calls, runs and reports -----------------------------------------------------------------------------------------------------

PRICED = "+ priced as (select c.*, c.input_tokens / 1e6 * m.price_in + c.output_tokens / 1e6 * m.price_out as cost from calls c left join models m on m.model = c.model)"
LAYERS = """select layer, count(*) calls, count(*) filter (where status = 'error') errors, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(output_tokens) as bigint) output_tokens, round(sum(coalesce(cost, 0)), 6) as cost,
  count(*) filter (where cost is null and status <> 'error') unpriced_calls, avg(latency) avg_latency, avg(ttft) avg_ttft from priced group by layer"""


def _calls(spark, sf_dir):
    return stats.priced(frame(spark, sf_dir, "calls"), frame(spark, sf_dir, "models"))


@query("calls models", f"{PRICED} {LAYERS}")
def layer_stats(spark, sf_dir):
    return stats.layer_stats(_calls(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query("calls models", f"{PRICED}, layers as ({LAYERS}) select round(sum(round(cost, 4)), 4) total_cost, cast(sum(calls) as bigint) total_calls, cast(sum(unpriced_calls) as bigint) unpriced_calls from layers")
def total_cost(spark, sf_dir):
    return stats.total_cost(stats.layer_stats(_calls(spark, sf_dir)))


@query("calls models", f"{PRICED} select layer, model, case when count(cost) = count(*) then round(sum(cost), 6) end as cost, count(*) - count(cost) unpriced from priced group by layer, model")
def cost_null_poison(spark, sf_dir):
    return stats.cost_or_null(_calls(spark, sf_dir), ["layer", "model"]).withColumn("cost", F.round("cost", 6))


@query("calls", "+ f as (select layer, model, min(\"at\") t from calls group by layer, model) select layer, string_agg(model, ',' order by t, model) models from f group by layer")
def layer_models(spark, sf_dir):
    return stats.layer_models(frame(spark, sf_dir, "calls")).select("layer", F.array_join("models", ",").alias("models"))


@query("calls", "select model, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(output_tokens) as bigint) output_tokens, count(*) calls, count(*) filter (where status = 'error') errors, coalesce(string_agg(distinct error, ',' order by error), '') messages from calls group by model")
def usage_totals(spark, sf_dir):
    return stats.usage_totals(frame(spark, sf_dir, "calls"), ["model"]).withColumn("messages", F.array_join("messages", ","))


@query("calls", "select event_id, layer from calls order by \"at\" desc, event_id desc limit 40")
def newest_calls(spark, sf_dir):
    return stats.newest_calls(frame(spark, sf_dir, "calls"), ties=("event_id",)).select("event_id", "layer")


@query("calls models", f"{PRICED} {LAYERS}")
def stream_layer_stats(spark, sf_dir):
    """The calls as a stream of files, rolled up by a streaming query that runs until it has read all of them."""
    from drawlake.plans.layers import _stream_calls, _written
    from drawlake.streaming.calls import running_layer_stats

    running = running_layer_stats(stats.priced(_stream_calls(spark, sf_dir), frame(spark, sf_dir, "models")))
    return _written(spark, running, "complete").withColumn("cost", F.round("cost", 6))


def frame_text(name: str) -> str:
    from drawlake.plans.proxies import sql

    return sql(name, "spark").replace("from events", "from {events}")


@query("runs", "select page, run_no, last_value(recall ignore nulls) over w previous, recall - last_value(recall ignore nulls) over w delta from runs window w as (partition by page order by run_at, run_no rows between unbounded preceding and 1 preceding)")
def run_history_delta(spark, sf_dir):
    return stats.recall_history(frame(spark, sf_dir, "runs")).select("page", "run_no", "previous", "delta")


@query("runs", "select page, run_no, recall from runs qualify row_number() over (partition by page order by run_at desc, run_no desc) = 1")
def latest_run(spark, sf_dir):
    return stats.latest_runs(frame(spark, sf_dir, "runs")).select("page", "run_no", "recall")


@query("runs", "select cast(sum(matched) as bigint) matched, cast(sum(missed) as bigint) missed, cast(sum(matched) as double) / (sum(matched) + sum(missed)) recall from runs where recall is not null")
def run_report(spark, sf_dir):
    return stats.report(frame(spark, sf_dir, "runs"))


RESULTS = "select concat('c', cast(run_no % 5 as varchar)) config, page % 2 + 1 page, recall, matched, missed, matched exact, case when run_no % 97 = 0 then null else cast(run_no % 50 as double) end as cost, cast(run_no % 60 as double) as seconds, missed tiles_failed from runs"


@query("runs", f"+ r as ({RESULTS}) select config, max(recall) filter (where page = 1) recall_1, max(recall) filter (where page = 2) recall_2, cast(sum(matched) as bigint) matched, cast(sum(matched) + sum(missed) as bigint) total, cast(sum(exact) as bigint) exact, "
       "case when count(*) = count(cost) then sum(cost) end as cost, sum(seconds) as seconds, cast(sum(tiles_failed) as bigint) tiles_failed from r group by config")  # fmt: skip
def bench_pivot(spark, sf_dir):
    runs = frame(spark, sf_dir, "runs")
    results = runs.select(
        F.concat(F.lit("c"), (F.col("run_no") % 5).cast("string")).alias("config"), (F.col("page") % 2 + 1).alias("page"), "recall", "matched", "missed", F.col("matched").alias("exact"),
        F.when(F.col("run_no") % 97 != 0, (F.col("run_no") % 50).cast("double")).alias("cost"), (F.col("run_no") % 60).cast("double").alias("seconds"), F.col("missed").alias("tiles_failed"),
    )
    return benchmarks.pivot(results, [1, 2])


# Rule assistant --------------------------------------------------------------------------------------------------------------

NARROW = {"category": "valves", "when": {"kind": "^valve$", "text": r"^V[1-4]\d*\b"}, "emit": "capture", "pattern": r"^(V\d+)"}


@query("obs zones", f"""+ {UNIQUE}, b as (select distinct page, text as value from unique_ where kind = 'valve' and symbol = 'bowtie valve' and regexp_matches(text, '^V[0-9]+\\b')),
a as (select distinct page, text as value from unique_ where kind = 'valve' and regexp_matches(text, '^V[1-4][0-9]*\\b'))
select page, (select count(*) from a where a.page = p.page and not exists (select 1 from b where b.page = a.page and b.value = a.value)) adds,
  (select count(*) from b where b.page = p.page and not exists (select 1 from a where a.page = b.page and a.value = b.value)) removes from (select page from a union select page from b) p""")  # fmt: skip
def rule_preview_diff(spark, sf_dir):
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    p = assistant.preview(observations(spark, sf_dir), contexts(spark, sf_dir), rules(), "modify", 3, NARROW, key)
    return p.changes.select("page", F.size("adds").cast("long").alias("adds"), F.size("removes").cast("long").alias("removes"))


def _recall_sql(valves: str) -> str:
    return SCORED.lstrip("+").replace("kind = 'valve' and regexp_matches(symbol, 'valve|bowtie') and regexp_matches(text, '^V[0-9]+\\b')", valves) + " select page, cast(sum(found) as double) / (sum(found) + sum(missed)) recall from scored where in_key group by page"


@query("obs zones answer_key", f"""select b.page, b.page document_id, b.recall recall_before, a.recall recall_after from (with recursive {_recall_sql("kind = 'valve' and regexp_matches(symbol, 'valve|bowtie') and regexp_matches(text, '^V[0-9]+\\b')")}) b
join (with recursive {_recall_sql("kind = 'valve' and regexp_matches(text, '^V[1-4][0-9]*\\b')")}) a on a.page = b.page""")  # fmt: skip
def rule_preview_recall(spark, sf_dir):
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    return assistant.preview(observations(spark, sf_dir), contexts(spark, sf_dir), rules(), "modify", 3, NARROW, key).keyed


from drawlake.plans import details, layers  # noqa: E402, F401  (register their queries here)
