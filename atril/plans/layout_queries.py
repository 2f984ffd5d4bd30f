"""Registered layout queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from atril.operators import layout as L
from atril.plans.registry import query
from atril.session import materialise

C = F.col
RANGES = """roman AS (SELECT * FROM grid_cells WHERE regexp_full_match(value, '[IVXLCDM]+')),
    hr AS (SELECT file, sheet, min(row) AS header_row FROM (SELECT file, sheet, row FROM roman GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2),
    mc AS (SELECT file, sheet, max(col) AS max_col FROM grid_cells GROUP BY 1, 2),
    ranges AS (SELECT r.file, r.sheet, r.value AS label, r.col AS start_col, coalesce(lead(r.col) OVER (PARTITION BY r.file, r.sheet ORDER BY r.col) - 1, mc.max_col) AS end_col, hr.header_row
      FROM roman r JOIN hr ON hr.file = r.file AND hr.sheet = r.sheet AND hr.header_row = r.row JOIN mc ON mc.file = r.file AND mc.sheet = r.sheet),
    b AS (SELECT r.file, r.sheet, min(start_col) AS first_col, min(header_row) AS header_row FROM ranges r GROUP BY 1, 2),
    stop AS (SELECT c.file, c.sheet, min(row) AS footer_row, bool_or(starts_with(upper(value), 'TOTAL')) AS is_total FROM grid_cells c JOIN b USING (file, sheet) WHERE c.col < b.first_col
      AND (starts_with(upper(value), 'TOTAL') OR contains(upper(value), 'REQUISITOS DE GRADO')) GROUP BY 1, 2)"""
CATEGORY = RANGES + """, lab AS (SELECT c.file, c.sheet, c.row, c.col, c.value FROM grid_cells c JOIN b USING (file, sheet) JOIN stop USING (file, sheet)
      WHERE c.col < b.first_col AND c.value <> '' AND c.kind <> 'number' AND c.row >= b.header_row AND c.row < stop.footer_row),
    rws AS (SELECT DISTINCT c.file, c.sheet, c.row FROM grid_cells c JOIN b USING (file, sheet) JOIN stop USING (file, sheet) WHERE c.row >= b.header_row AND c.row < stop.footer_row),
    cat AS (SELECT file, sheet, row, string_agg(label, ' - ' ORDER BY col) AS category FROM (
      SELECT r.file, r.sheet, r.row, l.col, max_by(l.value, l.row) AS label FROM rws r JOIN lab l ON l.file = r.file AND l.sheet = r.sheet AND l.row <= r.row GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
SECTIONS = CATEGORY + """, taint AS (SELECT DISTINCT c.file, c.sheet, c.col FROM grid_cells c JOIN stop s USING (file, sheet)
      WHERE c.row < s.footer_row AND c.kind = 'number' AND try_cast(c.value AS DOUBLE) <> floor(try_cast(c.value AS DOUBLE))),
    ins AS (SELECT r.file, r.sheet, r.label, r.start_col, r.end_col, c.row, c.col, c.value FROM grid_cells c JOIN stop s USING (file, sheet)
      JOIN ranges r ON r.file = c.file AND r.sheet = c.sheet AND c.col BETWEEN r.start_col AND r.end_col
      WHERE c.row < s.footer_row AND c.value <> '' AND NOT EXISTS (SELECT 1 FROM taint t WHERE t.file = c.file AND t.col = c.col)),
    rr AS (SELECT file, sheet, label, start_col, end_col, row, list(value ORDER BY col) AS v, map_from_entries(list((col, value))) AS m FROM ins GROUP BY 1, 2, 3, 4, 5, 6),
    ln AS (SELECT *, trim(array_to_string(list_transform(range(start_col, end_col + 1), lambda c: coalesce(m[c], '')), ' | '), ' |') AS line FROM rr
           WHERE NOT (len(v) = 1 AND v[1] = label)),
    sec AS (SELECT l.file, l.sheet, l.label, l.start_col, l.row, CASE WHEN coalesce(cat.category, '') <> '' THEN cat.category || ' | ' || l.line ELSE l.line END AS line,
      CAST(trunc(try_cast(CASE WHEN list_contains(v, 'CR') AND list_position(v, 'CR') < len(v) THEN v[list_position(v, 'CR') + 1]
           WHEN len(v) >= 2 AND v[-2] IN ('T', 'TP', 'P') THEN v[-1]
           WHEN len(list_filter(v, lambda x: try_cast(x AS DOUBLE) IS NULL)) = 0 THEN v[-1] END AS DOUBLE)) AS BIGINT) AS credit
      FROM ln l LEFT JOIN cat ON cat.file = l.file AND cat.sheet = l.sheet AND cat.row = l.row)"""


def grid_cells(v):
    """The `grid_cells` view in one pass over the lines: every order is a sheet."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    g = v["lineitem"].withColumn("row", (F.row_number().over(order) + 1).cast("long"))
    row, text = C("row"), "text"

    def cell(col, value, kind, present=None):
        made = F.struct(F.lit(col).cast("long").alias("col"), value.alias("value"),
                        (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"))
        return made if present is None else F.when(present, made)

    s = lambda c: c.cast("string")
    cells = F.array(
        cell(1, F.concat(F.lit("AREA "), C("l_returnflag")), text, row % 2 == 0),
        cell(2, F.when(row == 3, "COMPONENTE").otherwise(s(row)), F.when(row == 3, "text").otherwise("number")),
        cell(3, F.concat(F.lit("C"), s(C("l_partkey"))), text, C("l_suppkey") % 3 != 0),
        cell(4, s(C("l_quantity").cast("long")), "number"),
        cell(5, F.when(C("l_suppkey") % 2 == 0, "T").otherwise(""), text),
        cell(6, s(C("l_suppkey") % 5 + 1), "number"),
        cell(7, F.when(C("l_discount") > 0.05, "CR").otherwise("HP"), text),
        cell(8, s(C("l_partkey") % 4), "number"),
        cell(9, F.when(row == 4, "0.5").otherwise("7"), "number"))
    body = g.select(C("l_orderkey").alias("file"), row, F.explode(cells).alias("c")).where(C("c").isNotNull()).select("file", "row", "c.*")

    def fixed(r, col, value, kind):
        return F.struct(F.lit(r).cast("long").alias("row"), F.lit(col).cast("long").alias("col"),
                        (value if not isinstance(value, str) else F.lit(value)).alias("value"), F.lit(kind).alias("kind"))

    frame = F.array(
        fixed(1, 3, "I", text), fixed(1, 7, "II", text),
        fixed(100, 2, F.when(C("file") % 2 == 0, "Total créditos").otherwise("Requisitos de grado"), text),
        fixed(100, 4, "12", "number"), fixed(101, 1, "Convenciones", text), fixed(101, 3, "Ética", text),
        fixed(102, 4, "Electiva", text), fixed(102, 8, "5", "number"))
    edges = v["lineitem"].select(C("l_orderkey").alias("file")).distinct().select("file", F.explode(frame).alias("c")).select("file", "c.*")
    return body.unionByName(edges).withColumn("sheet", F.lit("malla"))


def grid(v):
    cells = materialise(grid_cells(v), "grid")
    return cells, materialise(L.detect_semester_grid(cells), "ranges")


LINES = r"""k AS (SELECT * FROM page_spans WHERE trim(text) <> '' AND (length(trim(text)) > 1 OR regexp_full_match(trim(text), '\p{L}'))),
    r AS (SELECT file, page, CAST(round_even(y / 6.0, 0) * 6 AS BIGINT) AS rk, string_agg(trim(text), ' ' ORDER BY x, seq) AS line FROM k GROUP BY 1, 2, 3),
    f AS (SELECT * FROM r WHERE length(line) > 3 AND len(regexp_extract_all(line, '\p{L}')) >= 2)"""


@query("spans_to_lines", LINES + """
    SELECT file, page, CAST(row_number() OVER (PARTITION BY file, page ORDER BY rk) AS BIGINT) AS line_no, line FROM f""")
def _(v):
    return L.spans_to_lines(v["page_spans"]).withColumn("line_no", C("line_no").cast("long"))


@query("lines_to_text", LINES + """, p AS (SELECT file, page, string_agg(line, chr(10) ORDER BY rk) AS t FROM f GROUP BY 1, 2)
    SELECT file, string_agg(t, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY 1""")
def _(v):
    return L.lines_to_text(L.spans_to_lines(v["page_spans"]))


@query("shape_semester_grid", """shapes AS (SELECT l_orderkey AS file, 's' AS sheet, CAST(l_linenumber AS BIGINT) * 3 AS from_col, CAST(l_linenumber AS BIGINT) * 3 + 2 AS to_col,
      CASE l_linenumber % 4 WHEN 1 THEN ' I ' WHEN 2 THEN 'II' WHEN 3 THEN 'flecha' ELSE 'x' END AS label FROM lineitem),
    roman AS (SELECT *, trim(label) AS l FROM shapes WHERE regexp_full_match(trim(label), '[IVXLCDM]+'))
    SELECT file, sheet, l AS label, from_col + 1 AS start_col, to_col + 1 AS end_col, CAST(1 AS BIGINT) AS header_row FROM roman
    QUALIFY count(*) OVER (PARTITION BY file, sheet) >= 2""")
def _(v):
    at, which = C("l_linenumber").cast("long") * 3, C("l_linenumber") % 4
    label = F.when(which == 1, " I ").when(which == 2, "II").when(which == 3, "flecha").otherwise("x")
    shapes = v["lineitem"].select(C("l_orderkey").alias("file"), F.lit("s").alias("sheet"), at.alias("from_col"), (at + 2).alias("to_col"), label.alias("label"))
    return L.shape_semester_grid(shapes).withColumn("header_row", C("header_row").cast("long"))


def comma_cells(v):
    """Documents as sheets: a line is a row, its comma-separated parts are cells."""
    d = v["documents"].select(C("doc_id").alias("file"), C("lang").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("row", "l"))
    return d.select("file", "sheet", (C("row") + 1).alias("row"), F.posexplode(F.split("l", ",")).alias("col", "value")).select(
        "file", "sheet", "row", (C("col") + 1).alias("col"), F.trim("value").alias("value"), F.lit("text").alias("kind"))


COMMA = """lines AS (SELECT doc_id AS file, lang AS sheet, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) + 1 AS row FROM documents),
    cc AS (SELECT file, sheet, row, unnest(string_split(l, ',')) AS raw, unnest(range(len(string_split(l, ',')))) + 1 AS col FROM lines)"""


@query("cells_to_rows", COMMA + """ SELECT file, sheet, row, trim(string_agg(trim(raw), ' | ' ORDER BY col), ' |') AS line FROM cc
    GROUP BY 1, 2, 3 HAVING bool_or(trim(raw) <> '')""")
def _(v):
    return L.cells_to_rows(comma_cells(v)).withColumn("row", C("row").cast("long"))


@query("sheets_to_text", COMMA + """, r AS (SELECT file, sheet, row, trim(string_agg(trim(raw), ' | ' ORDER BY col), ' |') AS line FROM cc
    GROUP BY 1, 2, 3 HAVING bool_or(trim(raw) <> ''))
    SELECT file, '=== HOJA: ' || any_value(sheet) || ' ===' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY row) AS text FROM r GROUP BY 1""")
def _(v):
    return L.sheets_to_text(L.cells_to_rows(comma_cells(v)))


PARTS = """parts AS (SELECT l_orderkey AS file, CAST(l_linenumber // 3 AS BIGINT) AS slide, l_partkey * 100000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS seq,
    [' ' || l_returnflag || ' ', '', CASE WHEN l_linestatus = 'O' THEN l_partkey || '' ELSE '  ' END] AS cells FROM lineitem),
    pl AS (SELECT file, slide, seq, array_to_string(list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> ''), ' | ') AS line FROM parts)"""


def parts(v):
    return v["lineitem"].select(
        C("l_orderkey").alias("file"), F.floor(C("l_linenumber") / 3).alias("slide"),
        (C("l_partkey") * 100000000 + C("l_suppkey") * 1000 + C("l_quantity").cast("long")).alias("seq"),
        F.array(F.concat(F.lit(" "), C("l_returnflag"), F.lit(" ")), F.lit(""),
                F.when(C("l_linestatus") == "O", C("l_partkey").cast("string")).otherwise("  ")).alias("cells"))


@query("slide_rows", PARTS + """, s AS (SELECT file, slide, '=== DIAPOSITIVA ' || slide || ' ===' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY seq, line) AS t
    FROM pl WHERE line <> '' GROUP BY 1, 2) SELECT file, string_agg(t, chr(10) || chr(10) ORDER BY slide) AS text FROM s GROUP BY 1""")
def _(v):
    return L.slide_rows(parts(v))


@query("paragraph_rows", PARTS + " SELECT file, string_agg(line, chr(10) || chr(10) ORDER BY seq, line) AS text FROM pl WHERE line <> '' GROUP BY 1")
def _(v):
    return L.paragraph_rows(parts(v))


@query("detect_semester_grid", RANGES + " SELECT * FROM ranges")
def _(v):
    return grid(v)[1]


@query("header_ranges", """SELECT l_orderkey AS file, 's' AS sheet, 'L' || col AS label, col AS start_col, coalesce(lead(col) OVER (PARTITION BY l_orderkey ORDER BY col) - 1, 30000) AS end_col, CAST(1 AS BIGINT) AS header_row
    FROM (SELECT DISTINCT l_orderkey, l_partkey AS col FROM lineitem)""")
def _(v):
    h = v["lineitem"].select(C("l_orderkey").alias("file"), F.lit("s").alias("sheet"), C("l_partkey").alias("col")).distinct()
    h = h.withColumns({"value": F.concat(F.lit("L"), C("col").cast("string")), "header_row": F.lit(1).cast("long")})
    return L.header_ranges(h, h.select("file", "sheet").distinct().withColumn("max_col", F.lit(30000).cast("long")))


@query("forward_fill_labels", CATEGORY + " SELECT file, sheet, row, category FROM cat")
def _(v):
    cells, ranges = grid(v)
    return L.forward_fill_labels(L.annotate_grid(cells, ranges))


@query("grid_sections", SECTIONS + " SELECT * FROM sec")
def _(v):
    return L.grid_sections(grid_cells(v))


@query("semester_credits", SECTIONS + " SELECT file, sheet, label, start_col, CAST(coalesce(sum(credit), 0) AS BIGINT) AS credits FROM sec GROUP BY 1, 2, 3, 4")
def _(v):
    return L.semester_credits(L.grid_sections(grid_cells(v)))


@query("section_texts", SECTIONS + """ SELECT file, sheet, start_col, '=== HOJA: ' || sheet || ' — SEMESTRE ' || label || CASE label WHEN 'I' THEN ' (primer semestre)' ELSE ' (segundo semestre)' END || ' ===' AS header,
    string_agg(line, chr(10) ORDER BY row) || CASE WHEN coalesce(sum(credit), 0) <> 0 THEN chr(10) || 'Total créditos de este semestre: ' || CAST(sum(credit) AS BIGINT) ELSE '' END AS body
    FROM sec GROUP BY file, sheet, start_col, label""")
def _(v):
    return L.section_texts(L.grid_sections(grid_cells(v)))


@query("column_islands", """SELECT file, sheet, col, col - dense_rank() OVER (PARTITION BY file, sheet ORDER BY col) AS island
    FROM (SELECT DISTINCT file, sheet, col FROM grid_cells WHERE value <> '')""")
def _(v):
    return L.column_islands(grid_cells(v)).withColumn("island", C("island").cast("long"))


@query("footer_blocks", RANGES + """, below AS (SELECT c.* FROM grid_cells c JOIN stop s USING (file, sheet) WHERE c.row >= s.footer_row AND NOT (s.is_total AND c.row = s.footer_row) AND c.value <> ''),
    isl AS (SELECT file, sheet, col, col - dense_rank() OVER (PARTITION BY file, sheet ORDER BY col) AS island FROM (SELECT DISTINCT file, sheet, col FROM below)),
    sp AS (SELECT file, sheet, island, min(col) AS lo, max(col) AS hi FROM isl GROUP BY 1, 2, 3),
    rw AS (SELECT b.file, b.sheet, i.island, b.row, map_from_entries(list((b.col, b.value))) AS m FROM below b JOIN isl i ON i.file = b.file AND i.sheet = b.sheet AND i.col = b.col GROUP BY 1, 2, 3, 4),
    ln AS (SELECT rw.file, rw.sheet, rw.island, rw.row, trim(array_to_string(list_transform(range(lo, hi + 1), lambda c: coalesce(m[c], '')), ' | '), ' |') AS line
      FROM rw JOIN sp ON sp.file = rw.file AND sp.sheet = rw.sheet AND sp.island = rw.island)
    SELECT * FROM ln WHERE (file, island) IN (SELECT file, island FROM ln WHERE regexp_matches(line, '\\p{L}'))""".replace("\\\\p", "\\p"))
def _(v):
    return L.footer_blocks(*grid(v)).withColumn("island", C("island").cast("long"))


SECTION_ROWS = """base AS (SELECT doc_id AS doc, string_split('=== HOJA: ' || source || ' ===' || chr(10) || 'SEMESTRE I' || chr(10) || 'a | b' || chr(10) || text || chr(10)
      || '=== DIAPOSITIVA 2 ===' || chr(10) || text, chr(10)) AS ls FROM documents),
    rr AS (SELECT doc, unnest(ls) AS text, unnest(range(len(ls))) AS row_no FROM base)"""


@query("section_carry", SECTION_ROWS + r""", m AS (SELECT *, regexp_matches(text, '^(=== HOJA: .+? ===|=== DIAPOSITIVA \d+ ===)$') AS mk FROM rr WHERE regexp_matches(text, '\S')),
    s AS (SELECT *, count(*) FILTER (WHERE mk) OVER (PARTITION BY doc ORDER BY row_no) AS s, last_value(CASE WHEN mk THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY row_no) AS section FROM m),
    h AS (SELECT *, NOT contains(text, '|') AND coalesce(lead(contains(text, '|')) OVER (PARTITION BY doc, s ORDER BY row_no), false) AS is_subheader FROM s WHERE NOT mk)
    SELECT doc, row_no, text, section, last_value(CASE WHEN is_subheader THEN text END IGNORE NULLS) OVER (PARTITION BY doc, s ORDER BY row_no) AS subheader, is_subheader FROM h""")
def _(v):
    body = F.concat(F.lit("=== HOJA: "), C("source"), F.lit(" ===\nSEMESTRE I\na | b\n"), C("text"), F.lit("\n=== DIAPOSITIVA 2 ===\n"), C("text"))
    rows = v["documents"].select(C("doc_id").alias("doc"), F.posexplode(F.split(body, "\n")).alias("row_no", "text"))
    return L.section_carry(rows).withColumn("row_no", C("row_no").cast("long"))
