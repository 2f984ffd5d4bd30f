"""Layout recovery from decoded spans and cells.

cells: file, sheet, row, col, value (text as shown, see F21), kind ('text' or 'number').
Every window and list below is confined to one sheet or page of one file, which the
upload limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atril.functions import text as tx
from atril.operators import sheets
from atril.session import materialise

SHEET = ["file", "sheet"]
ROMAN_LABEL = "^[IVXLCDM]+$"


def _strip_bars(text: Column) -> Column:
    return F.regexp_replace(text, "^[ |]+|[ |]+$", "")


def spans_to_lines(spans: DataFrame, bucket: int = 6) -> DataFrame:
    """L1: spans(file, page, seq, x, y, text) to lines in reading order."""
    word = tx.strip(F.col("text"))
    kept = spans.withColumn("text", word).where(
        (F.col("text") != "") & ((F.length("text") > 1) | F.col("text").rlike("^\\p{L}$")))
    rows = kept.groupBy("file", "page", (F.bround(F.col("y") / bucket) * bucket).cast("int").alias("row_key")).agg(
        F.sort_array(F.collect_list(F.struct("x", "seq", "text"))).alias("w"))
    line = F.array_join(F.transform("w", lambda w: w["text"]), " ")
    out = rows.select("file", "page", "row_key", line.alias("line"))
    out = out.where((F.length("line") > 3) & (F.regexp_count("line", F.lit("\\p{L}")) >= 2))
    order = Window.partitionBy("file", "page").orderBy("row_key")
    return out.select("file", "page", F.row_number().over(order).alias("line_no"), "line")


def lines_to_text(lines: DataFrame) -> DataFrame:
    """L1: one text per file, pages separated by a blank line."""
    pages = lines.groupBy("file", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    pages = pages.select("file", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"))
    files = pages.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page", "t"))).alias("p"))
    return files.select("file", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def _row_lines(cells: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """Cells of a row as `cells` (dense from first to last column) and joined `line`."""
    rows = cells.where(F.col("value") != "").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"),
        first.alias("_a"), last.alias("_b"))
    dense = F.transform(F.sequence("_a", "_b"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return rows.withColumn("cells", dense).select(
        *keys, "cells", _strip_bars(F.array_join("cells", " | ")).alias("line"))


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """L2: pipe-joined rows; blank rows are gone."""
    return _row_lines(cells, [*SHEET, "row"], F.min("col"), F.max("col")).drop("cells")


def sheets_to_text(rows: DataFrame, sheet_order: str = "sheet") -> DataFrame:
    """L2: one text per file, every sheet under its marker line."""
    sheets = rows.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("r"))
    marked = F.concat(F.lit("=== HOJA: "), F.col("sheet"), F.lit(" ===\n\n"),
                      F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    files = sheets.select("file", F.col(sheet_order).alias("o"), marked.alias("t")).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("o", "t"))).alias("s"))
    return files.select("file", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"))


def _part_lines(parts: DataFrame) -> DataFrame:
    shown = F.filter(F.transform("cells", tx.strip), lambda c: c != "")
    return parts.withColumn("line", F.array_join(shown, " | ")).where(F.col("line") != "")


def slide_rows(parts: DataFrame) -> DataFrame:
    """L3: parts(file, slide, seq, cells) to one text per file with slide markers."""
    slides = _part_lines(parts).groupBy("file", "slide").agg(
        F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    marked = F.concat(F.lit("=== DIAPOSITIVA "), F.col("slide").cast("string"), F.lit(" ===\n\n"),
                      F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    files = slides.select("file", "slide", marked.alias("t")).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("slide", "t"))).alias("s"))
    return files.select("file", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"))


def paragraph_rows(parts: DataFrame) -> DataFrame:
    """L3: paragraphs and table rows of a word-processor file, separated by blank lines."""
    files = _part_lines(parts).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return files.select("file", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))


# ------------------------------------------------------------------ semester grids

def header_ranges(header_cells: DataFrame, max_col: DataFrame) -> DataFrame:
    """Each label's column range; the last one reaches the sheet's last column."""
    nxt = F.lead("col").over(Window.partitionBy(*SHEET).orderBy("col"))
    return header_cells.withColumn("_next", nxt).join(max_col, SHEET).select(
        *SHEET, F.col("value").alias("label"), F.col("col").alias("start_col"),
        F.coalesce(F.col("_next") - 1, F.col("max_col")).alias("end_col"), "header_row")


def detect_semester_grid(cells: DataFrame) -> DataFrame:
    """L4: ranges of the first row holding at least two Roman numerals."""
    roman = cells.where(F.col("value").rlike(ROMAN_LABEL))
    rows = roman.groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    first = rows.groupBy(*SHEET).agg(F.min("row").alias("header_row"))
    header = roman.join(first, SHEET).where(F.col("row") == F.col("header_row"))
    return header_ranges(header, cells.groupBy(*SHEET).agg(F.max("col").alias("max_col")))


def shape_semester_grid(shapes: DataFrame) -> DataFrame:
    """L4, drawn labels: shapes(file, sheet, from_col, to_col, label), zero-based columns."""
    label = tx.strip(F.col("label"))
    roman = shapes.withColumn("label", label).where(F.col("label").rlike(ROMAN_LABEL))
    enough = roman.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select(*SHEET)
    return roman.join(enough, SHEET, "left_semi").select(
        *SHEET, "label", (F.col("from_col") + 1).alias("start_col"), (F.col("to_col") + 1).alias("end_col"),
        F.lit(1).alias("header_row"))


def annotate_grid(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells of grid sheets with first_col (first semester column), header_row, footer_row
    (first total or graduation row, none = beyond every row) and is_total.

    The one shuffle of the cells, by sheet, and one window: the first row with a mark, and whether a total is among its marks.
    """
    head = ranges.groupBy(*SHEET).agg(F.min("start_col").alias("first_col"), F.min("header_row").alias("header_row"))
    label = F.when(F.col("col") < F.col("first_col"), F.upper("value"))
    total = F.coalesce(label.startswith("TOTAL"), F.lit(False))
    degree = F.coalesce(label.contains("REQUISITOS DE GRADO"), F.lit(False))
    mark = F.when(total | degree, F.struct("row", (~total).alias("other")))
    a = cells.join(head, SHEET).withColumn("_stop", F.min(mark).over(Window.partitionBy(*SHEET)))
    return a.withColumns({
        "footer_row": F.coalesce("_stop.row", F.lit(2147483647)),
        "is_total": F.coalesce(~F.col("_stop.other"), F.lit(False))}).drop("_stop")


def forward_fill_labels(annotated: DataFrame) -> DataFrame:
    """`category` per row: the last text seen in each left-margin column, in column
    order.  Numbers are never labels.  Input: `annotate_grid`."""
    scoped = annotated.where((F.col("row") >= F.col("header_row")) & (F.col("row") < F.col("footer_row")))
    is_label = (F.col("col") < F.col("first_col")) & (F.col("value") != "") & (F.col("kind") != "number")
    return sheets.fill_labels(scoped.groupBy(*SHEET).agg(
        F.collect_list(F.when(is_label, F.struct("row", "col", "value"))).alias("labels"), F.collect_set("row").alias("rows")))


def grid_sections(cells: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Course rows per semester block: (file, sheet, label, start_col, row, line, credit), in one walk per
    sheet; without `ranges` L4's are found in the same walk."""
    return sheets.sections(cells, ranges)


def semester_credits(sections: DataFrame) -> DataFrame:
    """Credits per semester block."""
    return sections.groupBy(*SHEET, "label", "start_col").agg(F.coalesce(F.sum("credit"), F.lit(0)).alias("credits"))


def section_texts(sections: DataFrame) -> DataFrame:
    """Marker line and body of every semester block, with its credit total."""
    g = sections.groupBy(*SHEET, "label", "start_col").agg(
        F.sort_array(F.collect_list(F.struct("row", "line"))).alias("l"),
        F.coalesce(F.sum("credit"), F.lit(0)).alias("credits"))
    ordinal = tx.roman_ordinal(F.col("label"))
    header = F.concat(F.lit("=== HOJA: "), F.col("sheet"), F.lit(" — SEMESTRE "), F.col("label"),
                      F.coalesce(F.concat(F.lit(" ("), ordinal, F.lit(" semestre)")), F.lit("")), F.lit(" ==="))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    total = F.when(F.col("credits") != 0, F.concat(F.lit("\nTotal créditos de este semestre: "), F.col("credits").cast("string")))
    return g.select(*SHEET, "start_col", header.alias("header"), F.concat(body, F.coalesce(total, F.lit(""))).alias("body"))


def column_islands(cells: DataFrame) -> DataFrame:
    """`island` per occupied column; a run of adjacent columns shares one."""
    occupied = cells.where(F.col("value") != "").select(*SHEET, "col").distinct()
    rank = F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("col"))
    return occupied.select(*SHEET, "col", (F.col("col") - rank).alias("island"))


def footer_blocks(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the side-by-side tables below the grid, one block per column island;
    blocks without any letter are dropped.  What stands below is written once: islands, spans and lines all read it."""
    below = materialise(annotate_grid(cells, ranges).where(
        (F.col("row") >= F.col("footer_row")) & ~((F.col("row") == F.col("footer_row")) & F.col("is_total"))), "below")
    placed = below.join(column_islands(below.select(*cells.columns)), [*SHEET, "col"])
    spans = placed.groupBy(*SHEET, "island").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    rows = _row_lines(placed.join(spans, [*SHEET, "island"]), [*SHEET, "island", "row"], F.first("lo"), F.first("hi"))
    worded = rows.where(F.col("line").rlike("\\p{L}")).select(*SHEET, "island").distinct()
    return rows.join(worded, [*SHEET, "island"], "left_semi").select(*SHEET, "island", "row", "line")


def section_carry(rows: DataFrame) -> DataFrame:
    """rows(doc, row_no, text) with the section and sub-header each belongs to."""
    marker = "^(=== HOJA: .+? ===|=== DIAPOSITIVA \\d+ ===)$"
    down = Window.partitionBy("doc").orderBy("row_no")
    r = rows.where(tx.strip(F.col("text")) != "").withColumn("_m", F.col("text").rlike(marker))
    r = r.withColumn("_s", F.count_if("_m").over(down)).withColumn(
        "section", F.last(F.when(F.col("_m"), F.col("text")), ignorenulls=True).over(down)).where(~F.col("_m"))
    within = Window.partitionBy("doc", "_s").orderBy("row_no")
    piped = F.col("text").contains("|")
    r = r.withColumn("is_subheader", ~piped & F.coalesce(F.lead(piped).over(within), F.lit(False)))
    sub = F.last(F.when(F.col("is_subheader"), F.col("text")), ignorenulls=True).over(within)
    return r.select("doc", "row_no", "text", "section", sub.alias("subheader"), "is_subheader")
