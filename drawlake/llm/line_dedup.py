"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host when the pages of that host that contain it, over all pages of the host, exceed a ratio. Equal
texts of a host are one page, so that a line shared only by copies of one text is no boilerplate. Counting needs one row per
page and distinct line, summed per task before the shuffle, so a line that every page of a hot host repeats costs a row per
task. At most (mean lines of a page) / ratio lines of a host can pass, so each host's list is bounded whatever the host's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import cut, own_name

RATIO = 0.08  # share of a host's pages above which a line is boilerplate: more than lines reach that recur by chance
BROADCAST_BYTES = 8 << 20
SALTS = 16  # parts that a host's rows are dealt to where the lists are too many to broadcast


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, copies_once: bool = True) -> DataFrame:
    """One row per host that has boilerplate: host, lines array<string> (md5 of each trimmed line).

    Null texts are pages without lines; rows of a null host form one host. A line of a single page is none, whatever the ratio.
    """
    lines = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    hashed = F.array_distinct(F.transform(lines, lambda x: F.md5(x)))
    pages = df.select(F.col(f"`{host}`").alias("host"), F.md5(F.col(f"`{text}`")).alias("page"), hashed.alias("lines"))
    if copies_once:
        pages = pages.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    seen = pages.select("host", F.explode("lines").alias("line"))
    counted = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    totals = pages.groupBy(F.col("host").alias("total_host")).agg(F.count(F.lit(1)).alias("total"))
    frequent = counted.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).where(F.col("pages") > F.lit(ratio) * F.col("total"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_boilerplate(
    df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, copies_once: bool = True, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """df with boilerplate lines gone from `text`, plus n_lines and n_dropped (int).

    Lines compare without surrounding spaces. Blank lines count for nothing and stay. A line counts once per row however
    often it stands in it. The rows of a host with equal texts are one page, unless copies_once is False: then each row is.
    Null text stays null with both counts 0; an empty text is one blank line. Rows of a null host form one host. A page of
    boilerplate only becomes an empty text. An empty df gives an empty result. Other columns pass through, whatever their
    names; n_lines and n_dropped replace columns of those names.
    """
    sets = cut(boilerplate(df, host, text, ratio, copies_once))
    width = sets.agg(F.sum(F.size("lines") * 40 + 100)).first()[0] or 0
    keys, theirs, salt = own_name(df, "__lines"), own_name(df, "__host"), own_name(df, "__salt")
    small = sets.select(F.col("host").alias(theirs), F.col("lines").alias(keys))
    same = F.col(f"`{host}`").eqNullSafe(F.col(theirs))
    if width <= broadcast_bytes:
        joined = df.join(F.broadcast(small), same, "left")
    else:
        theirs_salt = own_name(df, "__their_salt")
        dealt = small.withColumn(theirs_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = df.withColumn(salt, F.pmod(F.xxhash64(f"`{text}`"), F.lit(SALTS)).cast("int"))
        joined = rows.join(dealt, same & (F.col(salt) == F.col(theirs_salt)), "left")
    split = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.when(F.col(keys).isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains(F.col(keys), F.md5(F.trim(x)))))
    was, both = own_name(df, "__was"), own_name(df, "__kept")
    names = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = joined.select(*[F.col(f"`{c}`") for c in names], split.alias(was), kept.alias(both))
    return rows.select(
        *[(F.array_join(both, "\n").alias(c) if c == text else F.col(f"`{c}`")) for c in names],
        F.greatest(F.size(was), F.lit(0)).alias("n_lines"),
        (F.greatest(F.size(was), F.lit(0)) - F.greatest(F.size(both), F.lit(0))).alias("n_dropped"),
    )


def sql(ratio: float = RATIO) -> str:
    """The query over `documents` in DuckDB's SQL; distinct texts of a host are its pages."""
    return f"""
with pages as (select distinct source, text from documents),
seen as (
  select source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) line
  from pages),
counted as (select source, line, count(*) pages from seen group by source, line having count(*) > 1),
totals as (select source, count(*) total from pages group by source),
sets as (
  select c.source, list(c.line) lines from counted c join totals t on c.source is not distinct from t.source
  where c.pages > cast({ratio} as double) * t.total group by c.source),
kept as (
  select d.doc_id, string_split(d.text, chr(10)) was,
    case when s.lines is null then string_split(d.text, chr(10))
         else list_filter(string_split(d.text, chr(10)), lambda x: not list_contains(s.lines, trim(x))) end now
  from documents d left join sets s on d.source is not distinct from s.source)
select doc_id, array_to_string(now, chr(10)) as text, cast(coalesce(len(was), 0) as int) as n_lines,
  cast(coalesce(len(was), 0) - coalesce(len(now), 0) as int) as n_dropped
from kept
"""
