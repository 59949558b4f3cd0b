"""Registered queries over single expressions and small operators, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawlake.functions import geometry as G
from drawlake.functions import text as X
from drawlake.functions import values as V
from drawlake.operators import benchmarks, resolve, review, scoring, spatial, stats, tables, verify
from drawlake.plans.proxies import contexts, frame, observations, rules, table_reads
from drawlake.plans.queries import CONNECTOR, INSIDE, IOU, KEY, NORM, QUEUE, UNIQUE, _decided, _reviewed, emitted_sql, flat, query, resolved
from drawlake.sources import readers, writers


def _tile():
    """A tile that holds the box's corner."""
    x, y = F.col("bbox.x0") - F.col("bbox.x0") % 1062, F.col("bbox.y0") - F.col("bbox.y0") % 1062
    return F.struct(x.alias("x0"), y.alias("y0"), (x + 1250).alias("x1"), (y + 1250).alias("y1"))


@query("obs", """+ t as (select page, ord, x0, y0, x1, y1, x0 - x0 % 1062 tx, y0 - y0 % 1062 ty from obs),
u as (select *, cast(trunc((x0 - tx) / 1.25) as int) ux0, cast(trunc((y0 - ty) / 1.25) as int) uy0, cast(trunc((x1 - tx) / 1.25) as int) ux1, cast(trunc((y1 - ty) / 1.25) as int) uy1 from t)
select page, ord, ux0, uy0, ux1, uy1, cast(trunc(ux0 * 1.25) as int) + tx bx0, cast(trunc(uy0 * 1.25) as int) + ty by0, cast(trunc(ux1 * 1.25) as int) + tx bx1, cast(trunc(uy1 * 1.25) as int) + ty by1 from u""")  # fmt: skip
def tile_coordinates(spark, sf_dir):
    """Boxes in a reader's thousandths of a tile, and back on the page."""
    k = G.reader_scale(F.lit(True), F.lit(1250))
    units = frame(spark, sf_dir, "obs").withColumn("u", G.to_tile(F.col("bbox"), _tile(), k, k))
    back = units.withColumn("b", G.from_tile(F.col("u"), _tile(), k, k))
    return back.select("page", "ord", *[F.col(f"{p}.{s}").alias(f"{p}{s}") for p in ("u", "b") for s in ("x0", "y0", "x1", "y1")])


@query("pages_", """+ q as (select page, width w, height h, cast(trunc(width * 0.55) as int) pw, cast(trunc(height * 0.55) as int) ph from pages_)
select page, i sub_tile, case when i % 2 = 1 then w - pw else 0 end x0, case when i >= 2 then h - ph else 0 end y0, case when i % 2 = 1 then w else pw end x1, case when i >= 2 then h else ph end y1
from q cross join (select unnest([0, 1, 2, 3]) i) n""")  # fmt: skip
def quarter_split(spark, sf_dir):
    whole = frame(spark, sf_dir, "pages_").select("page", G.box(F.lit(0), F.lit(0), F.col("width"), F.col("height")).alias("b"))
    return whole.select("page", F.explode(G.quarters(F.col("b"))).alias("q")).select("page", "q.sub_tile", "q.box.x0", "q.box.y0", "q.box.x1", "q.box.y1")


@query("obs", "select page, ord, x0 + 5 x0, least(y0, y1 - 7) + 9 y0, x1 + 5 + 3 x1, y1 + 9 y1, cast(trunc(x0 / 0.5) as int) zx0, cast(trunc(y1 / 0.5) as int) zy1 from obs")
def polygon_boxes(spark, sf_dir):
    """Polygons of a tile on the page, their boxes, and boxes of a page read at half its size."""
    b = F.col("bbox")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(corner(b["x0"], b["y0"]), corner(b["x1"] + 3, b["y1"] - 7), corner(b["x0"] + 1, b["y1"]))
    out = frame(spark, sf_dir, "obs").withColumn("p", G.points_box(G.shift_points(points, F.lit(5), F.lit(9))))
    zone = G.rescale_zones(F.array(F.struct(F.lit("notes").alias("kind"), b.alias("bbox"))), F.lit(0.5))[0]["bbox"]
    return out.select("page", "ord", *flat(out, "p"), zone["x0"].alias("zx0"), zone["y1"].alias("zy1"))


@query("pages_", "select page, cast(floor(1000 * least(1.0, 2576.0 / greatest(width, height), sqrt(3000000.0 / (cast(width as double) * height)))) as bigint) thousandths, greatest(0, 10 - 60) wx0, least(width, 400 + 60) wx1 from pages_")
def fit_scale(spark, sf_dir):
    """The scale at which a page fits a reader's limits, and an inspector's window on it."""
    w = G.inspector_window(G.box(F.lit(10), F.lit(10), F.lit(400), F.lit(400)), F.col("width"), F.col("height"))
    return frame(spark, sf_dir, "pages_").select("page", F.floor(1000 * G.fit_scale(F.col("width"), F.col("height"))).alias("thousandths"), w["x0"].alias("wx0"), w["x1"].alias("wx1"))


@query("obs", "select page, ord, cast((x1 - x0) * (y1 - y0) as bigint) area from obs where 2000 between x0 - 30 and x1 + 30 and 1500 between y0 - 30 and y1 + 30 qualify row_number() over (partition by page order by area, ord) = 1")
def hit_test(spark, sf_dir):
    """The smallest reading near a point of each page."""
    hits = frame(spark, sf_dir, "obs").where(G.hit(F.col("bbox"), 2000, 1500, 30))
    return hits.groupBy("page").agg(F.min(F.struct(G.area(F.col("bbox")).alias("area"), "ord")).alias("m")).select("page", "m.ord", "m.area")


@query("obs", f"""select distinct kind, symbol, regexp_replace(concat(kind, '/', symbol, ' é_1.0'), '[^\\p{{L}}\\p{{N}}\\-.]', '-', 'g') slug, concat('page', '1', '_observations__', regexp_replace(symbol, '[^\\p{{L}}\\p{{N}}\\-.]', '-', 'g'), '_', substr(sha1(kind), 1, 8)) cache_key,
concat(kind, '|', {KEY.format('symbol')}) tag_key from obs""")  # fmt: skip
def slugs_and_keys(spark, sf_dir):
    kind, symbol = F.col("kind"), F.col("symbol")
    return frame(spark, sf_dir, "obs").select("kind", "symbol").distinct().select(
        "kind", "symbol", X.slug(F.concat(kind, F.lit("/"), symbol, F.lit(" é_1.0"))).alias("slug"),
        F.concat_ws("_", F.lit("page1"), F.concat(F.lit("observations__"), X.slug(symbol)), X.hash_id(kind)).alias("cache_key"), X.tag_key(kind, symbol).alias("tag_key"),
    )


@query("runs", "select distinct matched, missed, round_even(matched / 64.0 * 8, 0) half_even, cast(matched as double) / nullif(missed, 0) ratio, coalesce(printf('%.1f%%', 100.0 * matched / nullif(missed * 8, 0)), '—') percent, matched // 5 cell from runs")
def numbers(spark, sf_dir):
    m, n = F.col("matched"), F.col("missed")
    return frame(spark, sf_dir, "runs").select("matched", "missed").distinct().select(
        "matched", "missed", V.rounded(m / F.lit(64.0) * 8, 0).alias("half_even"), V.ratio(m, n).alias("ratio"), V.percent(F.try_divide(m.cast("double"), (n * 8).cast("double"))).alias("percent"), F.expr("matched div 5").alias("cell")
    )


@query("runs", "select run_no, strftime(run_at, '%Y-%m-%dT%H:%M:%S') iso, strftime(run_at, '%Y%m%d-%H%M%S') stamp, strftime(run_at, '%d %b %H:%M') short, cast(epoch_us(run_at) // 1000000 % 86400 as bigint) second_of_day from runs")
def stamps(spark, sf_dir):
    at = F.col("run_at")
    day = F.date_trunc("day", at)
    return frame(spark, sf_dir, "runs").select("run_no", V.iso_seconds(at).alias("iso"), V.run_stamp(at).alias("stamp"), V.short_stamp(at).alias("short"), V.elapsed_seconds(day, at, 0).cast("long").alias("second_of_day"))


@query("pages_ obs", "select p.page, p.width, p.height, exists (select 1 from obs o where o.page = p.page and o.pk % 400 = 0) cached, max(p.page) over () + 1 next_page from pages_ p")
def page_listing(spark, sf_dir):
    listed = readers.list_pages(frame(spark, sf_dir, "pages_"), frame(spark, sf_dir, "obs").where("pk % 400 = 0"))
    return listed.crossJoin(F.broadcast(readers.next_page(frame(spark, sf_dir, "pages_")).withColumnRenamed("page", "next_page")))


@query("obs", """+ i as (select page, max((x1 - x0) * (y1 - y0)) largest, max(pk) chars from obs group by page)
select page, case when largest / 2000.0 >= 0.9 or largest / 2000.0 >= 0.5 and chars % 3 = 0 then 'scan' else 'digital' end as method from i""")  # fmt: skip
def scan_method(spark, sf_dir):
    """Whether a page is a scan, by its largest image and its text."""
    images = frame(spark, sf_dir, "obs").groupBy("page").agg(F.max(G.area(F.col("bbox"))).cast("double").alias("image_area"), (F.max("pk") % 3).alias("text_chars"))
    return readers.page_method(images.withColumn("page_area", F.lit(2000.0)))


@query("obs zones", "+ t as (select page, ord, case when pk % 3 = 0 then 'revision_table' else 'data' end kind, x0, y0, x1, y1 from obs) "
       f"select o.page, o.ord, case when o.kind = 'data' and exists (select 1 from zones z where z.page = o.page and z.kind = 'legend' and {INSIDE}) then 'title_block' else o.kind end as kind from t o")  # fmt: skip
def admin_tables(spark, sf_dir):
    """Tables that lie in a zone of drawing administration."""
    t = frame(spark, sf_dir, "obs").select("page", "ord", F.when(F.col("pk") % 3 == 0, "revision_table").otherwise("data").alias("kind"), "bbox")
    return tables.relabel_admin(t, contexts(spark, sf_dir), ["legend"]).select("page", "ord", "kind")


@query("cells", """+ n as (select table_index, reader_no, count(distinct row_no) rows_, count(distinct col) cols_ from cells group by table_index, reader_no)
select a.table_index, b.reader_no, a.rows_ = b.rows_ and a.cols_ = b.cols_ same from n a join n b on a.table_index = b.table_index where a.reader_no = 1""")  # fmt: skip
def table_shapes(spark, sf_dir):
    reads = tables.with_shape(table_reads(spark, sf_dir))
    base = reads.where("reader_no = 1").select("table_index", F.struct("n_rows", "n_cols").alias("a"))
    return reads.join(base, "table_index").select("table_index", "reader_no", tables.same_shape(F.col("a"), F.struct("n_rows", "n_cols")).alias("same"))


@query("answer_key", "select document_id, category, count(*) n, cast(count(*) = 1 as int) single from answer_key group by document_id, category")
def scalar_or_list(spark, sf_dir):
    """A key whose categories hold a JSON string or a list, read as lists."""
    grouped = frame(spark, sf_dir, "answer_key").groupBy("document_id", "category").agg(F.collect_list("value").alias("v"))
    as_json = grouped.withColumn("j", F.when(F.size("v") == 1, F.regexp_replace(F.to_json(F.col("v")), r"^\[|\]$", "")).otherwise(F.to_json("v")))
    listed = as_json.withColumn("l", V.scalar_or_list(F.col("j")))
    return listed.select("document_id", "category", F.size("l").cast("long").alias("n"), (~F.col("j").startswith("[")).cast("int").alias("single"))


@query("zones answer_key obs", f"""select z.page, min(k.document_id) document_id from (select distinct page from zones) z join answer_key k on k.category = 'pid'
and {KEY.format('k.value')} = {KEY.format("concat('PID-1-SS-', cast(z.page as varchar))")} where exists (select 1 from obs o where o.page = z.page) group by z.page""")  # fmt: skip
def keyed_sheets(spark, sf_dir):
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    return readers.keyed_sheets(contexts(spark, sf_dir), key, frame(spark, sf_dir, "obs"))


@query("obs zones", f"""+ {UNIQUE}, {emitted_sql('unique_')}, a as (select distinct page, category, value from emitted union select distinct page, 'pid', concat('PID-1-SS-', cast(page as varchar)) from zones)
select page, string_agg(value, '|' order by value) filter (where category = 'filters') filters, count(distinct category) categories, concat('PID-1-SS-', cast(page as varchar)) document_id from a group by page""")  # fmt: skip
def answer_documents(spark, sf_dir):
    """One document of answers per page."""
    out = writers.answer_documents(resolved(spark, sf_dir).answers, contexts(spark, sf_dir))
    return out.select("page", F.array_join(F.try_element_at("answers", F.lit("filters")), "|").alias("filters"), F.size("answers").cast("long").alias("categories"), "document_id")


@query("runs", """+ a as (select page, run_no % 3 k, max(run_no) v from runs group by 1, 2), b as (select page, run_no % 2 k, max(run_no) v from runs group by 1, 2)
select page, k, v from b union all select page, k, v from a where not exists (select 1 from b where b.page = a.page and b.k = a.k)""")  # fmt: skip
def merged_results(spark, sf_dir):
    """Old results that new ones don't replace, and the new ones."""
    runs = frame(spark, sf_dir, "runs")
    kept = lambda n: runs.withColumn("k", F.col("run_no") % n).groupBy("page", "k").agg(F.max("run_no").alias("v"))
    return benchmarks.merged_results(kept(3), kept(2), ["page", "k"])


@query("models", "select provider, string_agg(distinct model, ',' order by model) configs, count(*) filter (where tier = 'light') light from models group by provider")
def models_by_provider(spark, sf_dir):
    models = frame(spark, sf_dir, "models")
    light = stats.by_tier(models, "light").groupBy("provider").agg(F.count(F.lit(1)).alias("light"))
    by = benchmarks.by_provider(models.select("model", F.col("model").alias("config")), models)
    return by.join(light, "provider", "left").select("provider", F.array_join("configs", ",").alias("configs"), F.coalesce("light", F.lit(0).cast("long")).alias("light"))


@query("zones", "select concat('m', cast(page % 4 as varchar)) model, count(*) filter (where page % 5 <> 0) as right_, count(*) pages from (select distinct page from zones) z group by 1")
def sheet_ids_right(spark, sf_dir):
    want = contexts(spark, sf_dir)
    read = want.withColumns({"model": F.concat(F.lit("m"), (F.col("page") % 4).cast("string")), "sheet_id": F.when(F.col("page") % 5 == 0, "wrong").otherwise(F.replace("sheet_id", F.lit("-"), F.lit("_")))})
    return benchmarks.sheet_ids_right(read, want).withColumnRenamed("right", "right_")


@query("regions", "select page, round_even(cast(count(*) as double) / greatest(1, count(*) filter (where score > 0.7)), 1) gain from regions group by page")
def tiling_gain(spark, sf_dir):
    r = frame(spark, sf_dir, "regions")
    return benchmarks.tiling_gain(r, r.where("score > 0.7"))


@query("calls models", "select c.model, c.layer, count(*) n, count(*) filter (where m.price_in is null) unpriced, round(sum(c.input_tokens / 1e6 * m.price_in + c.output_tokens / 1e6 * m.price_out), 6) as cost from calls c left join models m on m.model = c.model where c.status = 'ok' group by 1, 2")
def cached_costs(spark, sf_dir):
    calls = stats.priced(frame(spark, sf_dir, "calls").where("status = 'ok'"), frame(spark, sf_dir, "models"))
    return calls.groupBy("model", "layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.round(F.sum("cost"), 6).alias("cost"))


@query("obs", rf"""+ c as (select page, ord c_ord, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') k, x0, y0, x1, y1 from obs where kind = 'continuation_connection'),
v as (select distinct page, 'coolant' category, cast(20000 + pk % 20 as varchar) as value from obs where kind = 'continuation_connection')
select v.page, v.value, case when cast(v.value as int) % 3 = 0 then concat('K', v.value) else v.value end as renamed from v""")  # fmt: skip
def flag_letters(spark, sf_dir):
    """Bare connector numbers that get the letter read off the drawing."""
    rs = resolve.RuleSet([{"category": "coolant", "when": {"kind": "x"}, "read_flag_letter": True}])
    o = frame(spark, sf_dir, "obs")
    bare = o.where("kind = 'continuation_connection'").select("page", F.lit("coolant").alias("category"), (F.lit(20000) + F.col("pk") % 20).cast("string").alias("value"), "bbox", "ord")
    prov = verify.best_of(bare, ["page", "category", "value"], "ord").drop("ord")
    jobs = verify.flag_jobs(prov, o.withColumn("text", F.regexp_extract("text", r"(\d{5})", 1)), rs)
    flags = jobs.where(F.col("value").cast("int") % 3 == 0).select("page", "key", F.lit(" k").alias("letter"))
    named = verify.with_letters(prov.select("page", "category", "value"), jobs, flags)
    return named.select("page", F.regexp_replace("value", "^K", "").alias("value"), F.col("value").alias("renamed"))


@query("obs", """+ i as (select page, ord, text, case pk % 5 when 0 then 'solo' when 1 then 'contested' when 2 then 'unread' when 3 then 'suppressed' else 'not_in_key' end kind, symbol category from obs),
p as (select *, case kind when 'contested' then 0 when 'solo' then 1 when 'suppressed' then 2 when 'unread' then 3 else 4 end priority from i)
select page, ord, priority, coalesce(lag(ord) over w, ord) previous, coalesce(lead(ord) over w, ord) following from p window w as (partition by page order by priority, coalesce(category, ''), text, ord)""")  # fmt: skip
def review_order(spark, sf_dir):
    """The order of a queue, and each item's neighbours in it."""
    kinds = F.array(*[F.lit(k) for k in ("solo", "contested", "unread", "suppressed", "not_in_key")])
    items = frame(spark, sf_dir, "obs").select("page", F.col("ord").alias("id"), F.col("text").alias("value"), F.element_at(kinds, (F.col("pk") % 5 + 1).cast("int")).alias("kind"), F.col("symbol").alias("category"))
    place = F.array_position(F.array(*map(F.lit, review.PRIORITY)), F.col("kind")).cast("int") - 1
    near = review.neighbours(items.withColumn("priority", place))
    return near.select("page", F.col("id").alias("ord"), "priority", F.col("previous_id").alias("previous"), F.col("next_id").alias("following"))


@query("obs", f"+ c as (select *, {CONNECTOR} id from obs where kind = 'continuation_connection') select page, ord, id, strlen(id) n, substr(text, 1, 12) clipped from c")
def connector_ids(spark, sf_dir):
    c = frame(spark, sf_dir, "obs").where("kind = 'continuation_connection'").withColumn("id", X.connector_id(F.col("text")))
    return c.select("page", "ord", "id", F.length("id").cast("long").alias("n"), X.clipped(F.col("text"), 12).alias("clipped"))


@query("calls", "select event_id, coalesce(error like '%3%', false) limited, upper(substr(layer, 1, 1)) = upper(layer) one_letter from calls")
def error_classes(spark, sf_dir):
    calls = frame(spark, sf_dir, "calls")
    return calls.select("event_id", X.is_rate_limit(F.replace("error", F.lit("3"), F.lit("429"))).alias("limited"), X.is_one_letter(F.col("layer")).alias("one_letter"))


@query("regions", f"""select a.page, count(*) pairs, cast(sum(case when {IOU.format(a='a', b='b')} > 0.4 then 1 else 0 end) as bigint) heavy from regions a join regions b on a.page = b.page and a.ord < b.ord
and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0) group by a.page""")  # fmt: skip
def overlapping_pairs(spark, sf_dir):
    """All pairs of boxes of a page that overlap, by the grid join."""
    r = frame(spark, sf_dir, "regions")
    b = r.select("page", F.col("ord").alias("b_ord"), F.col("bbox").alias("other"))
    pairs = spatial.overlapping(r.select("page", "ord", "bbox"), b, (F.col("ord") < F.col("b_ord")) & (G.intersection(F.col("bbox"), F.col("other")) > 0))
    return pairs.groupBy("page").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(G.iou(F.col("bbox"), F.col("other")) > 0.4).alias("heavy"))


@query("obs zones answer_key", """select z.page, k.document_id is not null has_key from (select distinct page from zones) z left join (select document_id from answer_key where category = 'pid') k on k.document_id = z.page""")
def sheets_with_key(spark, sf_dir):
    key = frame(spark, sf_dir, "answer_key").select("document_id", "category", "value")
    found = scoring.documents_of_sheets(contexts(spark, sf_dir), key)
    return contexts(spark, sf_dir).select("page").join(found, "page", "left").select("page", F.col("document_id").isNotNull().alias("has_key"))


@query("obs zones", f"""+ {UNIQUE}, {emitted_sql('unique_')}, p as (select page, category, value, rule, tile_id from emitted qualify row_number() over (partition by page, category, value order by rule, conf_pct desc, ord) = 1)
select page, category, string_agg(value, '|' order by value) as values_, string_agg(cast(rule as varchar), '|' order by value) rules, string_agg(tile_id, '|' order by value) tiles from p group by page, category""")  # fmt: skip
def provenance_lists(spark, sf_dir):
    """Answers as sorted lists with the source of each value beside it."""
    p = resolved(spark, sf_dir).provenance
    entries = p.groupBy("page", "category").agg(F.array_sort(F.collect_list(F.struct("value", "rule", "tile_id", "confidence"))).alias("e"))
    joined = lambda c: F.array_join(F.col(f"e.{c}").cast("array<string>"), "|")
    return entries.select("page", "category", joined("value").alias("values_"), joined("rule").alias("rules"), joined("tile_id").alias("tiles"))


@query("obs zones answer_key regions", QUEUE + """, fix as (select page, category, value, h from decided d where h > 0 and exists (select 1 from answers a where a.page = d.page and a.category = d.category)
  qualify row_number() over (partition by page, category, value order by priority, id) = 1),
kept_ as (select distinct coalesce(a.page, f.page) page, coalesce(a.category, f.category) category, case when f.h = 2 then concat('C', f.value) else a.value end as value
  from answers a full join fix f on f.page = a.page and f.category = a.category and f.value = a.value where coalesce(f.h, 0) <> 1)
select k.page, string_agg(k.value, '|' order by k.value) filter (where k.category = 'filters') filters, count(distinct k.category) categories,
  (select count(*) from items i where i.page = k.page and not (i.category is not null and substr(i.id, 1, 1) in ('0', '1', '2'))) as open from kept_ k group by k.page""")  # fmt: skip
def review_export(spark, sf_dir):
    """Reviewed answers of each page, those of one category written out, and how many items are still open."""
    r, o = _reviewed(spark, sf_dir)
    out = review.export(r.answers, _decided(spark, sf_dir, r, o))
    return out.select("page", F.array_join(F.try_element_at("answers", F.lit("filters")), "|").alias("filters"), F.size("answers").cast("long").alias("categories"), "open")


@query("runs", "select page, run_no, row_number() over (partition by page order by run_at desc, run_no desc) newest from runs")
def run_order(spark, sf_dir):
    w = Window.partitionBy("page").orderBy(F.desc("run_at"), F.desc("run_no"))
    return frame(spark, sf_dir, "runs").select("page", "run_no", F.row_number().over(w).cast("long").alias("newest"))


@query("obs", "select page, ord from obs where conf_pct >= 90 and kind <> 'valve'")
def confident_readings(spark, sf_dir):
    """What a rule with a floor of its own takes."""
    from drawlake.operators.rules import matches

    return observations(spark, sf_dir).where(matches({"category": "sure", "min_conf": 0.9, "unless": {"kind": "^valve$"}})).select("page", "ord")
