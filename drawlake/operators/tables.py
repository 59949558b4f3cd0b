"""Tables read off pages by several readers: shapes, votes by cell, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions.text import squeeze
from drawlake.functions.values import fused_header, rectangular


def with_shape(reads: DataFrame) -> DataFrame:
    """reads with rectangular rows, n_rows and n_cols."""
    return reads.withColumn("rows", rectangular(F.col("rows"))).withColumn("n_rows", F.size("rows")).withColumn("n_cols", F.when(F.size("rows") > 0, F.size(F.get("rows", F.lit(0)))).otherwise(0))


def same_shape(a: Column, b: Column) -> Column:
    return (a["n_rows"] == b["n_rows"]) & (a["n_cols"] == b["n_cols"])


def vote(reads: DataFrame, order: str = "reader_no") -> DataFrame:
    """One row per (page, table_index): rows after the vote, disputed cells, readers that voted, cell_agreement, shape_mismatch.

    reads: page, table_index, reader, `order`, rows, n_rows, n_cols, header_rows, title, kind. Readers whose shape differs
    from the first do not vote. If the first of three is the odd one out, the agreeing two lead. A cell takes the first
    reading that two readers share, else the first reader's. Voters' tables are taken apart into cells; one shuffle on the
    table serves the vote and putting them together again.
    """
    fields = F.struct(order, "reader", "rows", "n_rows", "n_cols", "header_rows", "title", "kind")
    grouped = reads.groupBy("page", "table_index").agg(F.array_sort(F.collect_list(fields)).alias("reads"))
    at = lambda i: F.get("reads", F.lit(i))
    rotate = (F.size("reads") == 3) & ~same_shape(at(0), at(1)) & same_shape(at(1), at(2))
    led = grouped.withColumn("rotated", rotate).withColumn("reads", F.when(F.col("rotated"), F.concat(F.slice("reads", 2, 2), F.slice("reads", 1, 1))).otherwise(F.col("reads"))).withColumn("base", at(0))
    rest = F.slice("reads", 2, F.greatest(F.size("reads") - 1, F.lit(1)))
    led = led.withColumn("peers", F.filter(rest, lambda r: same_shape(r, F.col("base")))).withColumn("odd", F.filter(rest, lambda r: ~same_shape(r, F.col("base"))))
    table = ["page", "table_index"]
    about = led.select(*table, "base.title", "base.kind", "base.header_rows", F.concat(F.array("base.reader"), F.col("peers.reader")).alias("readers"), F.col("odd.reader").alias("shape_mismatch"), "rotated")
    voters = led.select(*table, F.posexplode(F.concat(F.array("base.rows"), F.col("peers.rows"))).alias("voter", "rows"))
    cells = voters.select(*table, "voter", F.posexplode("rows").alias("row", "r")).select(*table, "voter", "row", F.posexplode("r").alias("col", "cell"))
    cells = cells.withColumn("norm", squeeze(F.coalesce("cell", F.lit(""))))
    options = cells.groupBy(*table, "row", "col", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("voter", "cell")).alias("first"), F.collect_list(F.struct("voter", "cell")).alias("said"))
    won = options.groupBy(*table, "row", "col").agg(
        F.min(F.struct((F.col("n") < 2).alias("alone"), F.col("first.voter").alias("voter"), F.col("first.cell").alias("cell"))).alias("w"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.array_sort(F.flatten(F.collect_list("said")))["cell"].alias("readings"),
    )
    place = F.struct("row", "col", F.col("w.cell").alias("text"), "readings", (F.col("w.alone") & (F.col("n") > 1)).alias("disputed"), ((F.col("kinds") == 1) & (F.col("n") > 1)).alias("unanimous"))
    whole = won.groupBy(*table).agg(F.array_sort(F.collect_list(place)).alias("cells"), F.max("col").alias("last"))
    width = F.col("last") + 1
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / width).cast("int")), lambda i: F.slice("cells", i * width + 1, width)["text"])
    voted = about.join(whole, table, "left")
    none = F.array().cast("array<array<string>>")
    return voted.select(
        *table, "title", "kind", "header_rows", F.when(F.size("cells") > 0, rows).otherwise(none).alias("rows"),
        F.coalesce(F.transform(F.filter("cells", lambda c: c["disputed"]), lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["readings"].alias("readings"))), F.array()).alias("disputed"),
        "readers", F.try_divide(F.size(F.filter("cells", lambda c: c["unanimous"])), F.size("cells")).alias("cell_agreement"), "shape_mismatch", "rotated",
    )


def needs_third_read(voted: DataFrame) -> DataFrame:
    return voted.where((F.size("disputed") > 0) | (F.size("shape_mismatch") > 0))


def relabel_admin(tables: DataFrame, contexts: DataFrame, zone_kinds: list[str]) -> DataFrame:
    """A data table inside a zone of drawing administration becomes a title block."""
    from drawlake.operators.spatial import in_any_zone

    joined = tables.join(contexts.select("page", "suppress_regions"), "page", "left")
    inside = (F.col("kind") == "data") & in_any_zone(F.col("suppress_regions"), F.col("bbox"), zone_kinds)
    return joined.withColumn("kind", F.when(inside, F.lit("title_block")).otherwise(F.col("kind"))).drop("suppress_regions")


def data_only(tables: DataFrame) -> DataFrame:
    return tables.where(F.coalesce(F.col("kind"), F.lit("data")) == "data")


def table_counts(voted: DataFrame, reads: DataFrame) -> DataFrame:
    """page, disputed cells, reads below native size."""
    a = voted.groupBy("page").agg(F.sum(F.size("disputed")).cast("long").alias("disputed_cells"))
    return a.join(reads.groupBy("page").agg(F.count_if(F.col("read_scale") < 1).alias("shrunk")), "page", "full")


def csv_text(rows: Column) -> Column:
    """Cells quoted where they hold a comma, a quote or a line break; lines end in CR LF."""
    quoted = lambda c: F.when(F.rlike(c, F.lit('[,"\\r\\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda r: F.when((F.size(r) == 1) & (F.get(r, F.lit(0)) == ""), F.lit('""\r\n')).otherwise(F.concat(F.array_join(F.transform(r, quoted), ","), F.lit("\r\n")))
    return F.array_join(F.transform(rows, line), "")


def kind_note(kind: Column) -> Column:
    # Fixed value: the words of the published table files.
    return F.when(kind == "data", F.lit("")).otherwise(F.concat(F.lit(" *("), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" — drawing administration)*")))


def markdown_text(title: Column, kind: Column, rows: Column, header_rows: Column) -> Column:
    safe = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, safe), " | "), F.lit(" |"))
    head = fused_header(rows, header_rows)
    h = F.greatest(header_rows, F.lit(1))
    body = F.transform(F.slice(rows, h + 1, F.greatest(F.size(rows) - h, F.lit(0))), line)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.lit("---")), " | "), F.lit(" |"))
    top = F.concat(F.lit("### "), title, kind_note(kind), F.lit("\n\n"))
    return F.when(F.size(rows) == 0, F.concat(top, F.lit("(empty)\n"))).otherwise(F.concat(top, F.array_join(F.concat(F.array(line(head), rule), body), "\n"), F.lit("\n")))
