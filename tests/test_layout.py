from atril.operators import layout as L

CELLS = "file string, sheet string, row int, col int, value string, kind string"


def cells(spark, rows):
    return spark.createDataFrame(
        [("f", "s", r, c, str(v), "number" if isinstance(v, (int, float)) else "text") for r, c, v in rows], CELLS)


def grid(spark):
    rows = [(1, 3, "I"), (1, 7, "II"), (2, 2, "COMPONENTE BÁSICO"), (2, 3, "MAT1"), (2, 4, "Cálculo"), (3, 3, 4), (3, 4, 8), (3, 5, "T"), (3, 6, 4),
            (2, 7, "MAT2"), (3, 7, 2), (3, 8, "T"), (3, 9, 2), (5, 2, "COMPONENTE PROFESIONAL"), (5, 3, "Redes"), (6, 3, 3), (6, 5, 3), (4, 9, 0.5),
            (8, 2, "TOTAL"), (8, 3, 15), (9, 1, "T: teórica"), (9, 4, 7), (10, 1, "P: práctica")]
    return cells(spark, rows)


def test_rows_keep_merged_headers(spark):
    c = cells(spark, [(1, 1, "SEMESTRE I"), (2, 1, "a"), (2, 3, "b"), (3, 2, "")])
    assert [(r.row, r.line) for r in L.cells_to_rows(c).orderBy("row").collect()] == [(1, "SEMESTRE I"), (2, "a |  | b")]
    assert L.sheets_to_text(L.cells_to_rows(c)).first().text == "=== HOJA: s ===\n\nSEMESTRE I\na |  | b"


def test_grid(spark):
    c = grid(spark)
    ranges = L.detect_semester_grid(c)
    assert sorted((r.label, r.start_col, r.end_col) for r in ranges.collect()) == [("I", 3, 6), ("II", 7, 9)]
    sections = L.grid_sections(c, ranges)
    assert sorted(L.grid_sections(c).collect()) == sorted(sections.collect())  # the same ranges found in the same walk
    lines = {(r.label, r.row): (r.line, r.credit) for r in sections.collect()}
    assert lines == {
        ("I", 2): ("COMPONENTE BÁSICO | MAT1 | Cálculo", None), ("I", 3): ("COMPONENTE BÁSICO | 4 | 8 | T | 4", 4),
        ("I", 5): ("COMPONENTE PROFESIONAL | Redes", None), ("I", 6): ("COMPONENTE PROFESIONAL | 3 |  | 3", 3),
        ("II", 2): ("COMPONENTE BÁSICO | MAT2", None), ("II", 3): ("COMPONENTE BÁSICO | 2 | T", None)}
    assert {r.label: r.credits for r in L.semester_credits(sections).collect()} == {"I": 7, "II": 0}
    text = {r.start_col: (r.header, r.body) for r in L.section_texts(sections).collect()}
    assert text[3][0] == "=== HOJA: s — SEMESTRE I (primer semestre) ===" and text[3][1].endswith("Total créditos de este semestre: 7")
    footer = sorted((r.island, r.row, r.line) for r in L.footer_blocks(c, ranges).collect())
    assert [f[1:] for f in footer] == [(9, "T: teórica"), (10, "P: práctica")]


def test_label_value_credit(spark):
    c = cells(spark, [(1, 3, "I"), (1, 10, "II"), (2, 3, "HP"), (2, 4, 3), (2, 5, "TP"), (2, 6, 2), (2, 7, "CR"), (2, 8, 3), (2, 9, 9)])
    assert L.grid_sections(c, L.detect_semester_grid(c)).first().credit == 3


def test_sheets_of_any_shape(spark):
    """No grid, one label only, drawn labels, empty values, a footer before the header, an empty table."""
    assert L.grid_sections(cells(spark, [])).count() == 0
    assert L.grid_sections(cells(spark, [(1, 1, "I"), (2, 1, "x")])).count() == 0
    c = cells(spark, [(1, 1, "a"), (1, 2, ""), (2, 2, "MAT"), (2, 3, 1.5), (3, 3, 4), (2, 5, "FIS"), (3, 1, "Total"), (3, 5, "QUI")])
    ranges = spark.createDataFrame([("f", "s", "I", 2, 3, 1), ("f", "s", "II", 4, 6, 1), ("g", "s", "I", 1, 2, 1)], "file string, sheet string, label string, start_col int, end_col int, header_row int")
    got = sorted((r.label, r.start_col, r.row, r.line, r.credit) for r in L.grid_sections(c, ranges).collect())
    assert got == [("I", 2, 2, "a | MAT", None), ("II", 4, 2, "a | FIS", None)]
    early = cells(spark, [(1, 1, "TOTAL"), (2, 2, "I"), (2, 3, "II"), (3, 2, "x")])
    assert L.grid_sections(early).count() == 0


def test_blocks_of_whole_sheets():
    """Sheets are never cut, whatever the batches; a sheet larger than a block is one."""
    import pyarrow as pa

    from atril.operators import sheets

    at = [f for f, n in ((None, 3), ("a", 20), ("b", 1), ("c", 2), ("d", 6)) for _ in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(["s"] * len(at)), pa.array(range(len(at)))], ["file", "sheet", "n"])
    for width in (1, 3, 7, 100):
        got = [b.to_pydict() for b in sheets.whole_sheets((rows.slice(i, width) for i in range(0, len(at), width)), 5)]
        assert [n for b in got for n in b["n"]] == list(range(len(at)))
        seen = [f for b in got for f in dict.fromkeys(b["file"])]
        assert seen == [None, "a", "b", "c", "d"]


def test_sheets_like_a_walk_over_rows(spark):
    """Equal to a plain reading of each sheet: odd margins, repeated places, gaps, marks, numbers of any form, ranges that overlap."""
    import random
    from itertools import groupby

    rng, values = random.Random(11), ["", "", "I", "II", "IX", "CR", "T", "TP", "P", "a", " b |", "|", "Ñu", "TOTAL x", "Requisitos de Grado", "3", "4.0", "0.5", "nan", "Infinity", "1e30", " 7 ", "2d"]
    weight = [1 if v[:1] in "TR" and len(v) > 2 else 4 for v in values]

    def number(v):
        shown = v.strip().removesuffix("d") if v.strip()[:1].isdigit() else v.strip()
        try:
            return float(shown) if shown not in ("", "I") else None
        except ValueError:
            return None

    def read(cells, ranges):
        cells = sorted(cells, key=lambda c: c[:2])
        if ranges is None:
            ranges = []
            for row, of in groupby(cells, key=lambda c: c[0]):
                found = [(c, v) for _, c, v, _ in of if v and set(v) <= set("IVXLCDM")]
                if len(found) >= 2:
                    ends = [c - 1 for c, _ in found[1:]] + [max(c[1] for c in cells)]
                    ranges = [(v, c, e, row) for (c, v), e in zip(found, ends)]
                    break
        if not ranges:
            return
        first, header = min(r[1] for r in ranges), min(r[3] for r in ranges)
        footer = min((r for r, c, v, _ in cells if c < first and (v.upper().startswith("TOTAL") or "REQUISITOS DE GRADO" in v.upper())), default=10**9)
        body = [c for c in cells if c[0] < footer]
        broken = {c for _, c, v, k in body if k == "number" and number(v) is not None and number(v) % 1 != 0} if body else set()
        margin = {}
        for row, of in groupby(body, key=lambda c: c[0]):
            shown = [c for c in of if c[2] != ""]
            if row >= header:
                margin.update((c, v) for _, c, v, k in shown if c < first and k != "number")
            category = " - ".join(margin[c] for c in sorted(margin)) if row >= header else ""
            for label, lo, hi, _ in ranges:
                inside = [(c, v) for _, c, v, _ in shown if lo <= c <= hi and c not in broken]
                if not inside or [v for _, v in inside] == [label]:
                    continue
                line = " | ".join(dict(inside).get(c, "") for c in range(lo, hi + 1)).strip(" |")
                said, numbers = [v for _, v in inside], [number(v) for _, v in inside]
                mark, credit = said.index("CR") if "CR" in said else len(said), None
                if mark + 1 < len(said):
                    credit = numbers[mark + 1]
                elif (len(said) > 1 and said[-2] in ("T", "TP", "P")) or None not in numbers:
                    credit = numbers[-1]
                yield label, lo, row, f"{category} | {line}" if category else line, int(credit) if credit is not None and abs(credit) < 2.0**63 else None

    made, given = [], []
    for f in range(60):
        given += [(f"f{f}", "s", rng.choice(["I", "II"]), lo, lo + rng.randint(-1, 6), rng.randint(1, 3)) for lo in rng.sample(range(2, 8), rng.randint(0, 3))]
        for row in range(1, rng.randint(2, 12)):
            made += [(f"f{f}", "s", row, c, rng.choices(values, weight)[0], rng.choice(["text", "number"])) for c in sorted(rng.sample(range(1, 12), rng.randint(1, 8)))]
    table = spark.createDataFrame(made, CELLS)
    drawn = spark.createDataFrame(given, "file string, sheet string, label string, start_col int, end_col int, header_row int")
    for ranges in (None, drawn):
        want = [(f, *x) for f, of in groupby(made, key=lambda c: c[0]) for x in read(
            [c[2:] for c in of], None if ranges is None else [(g[2], *g[3:]) for g in sorted(given, key=lambda g: (g[5], g[3])) if g[0] == f])]
        got = [(r.file, r.label, r.start_col, r.row, r.line, r.credit) for r in L.grid_sections(table, ranges).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 100


def test_labels_are_filled_down(spark):
    """By column, numbers and empty values never, until the footer; the cells are brought together once."""
    c = cells(spark, [(1, 3, "I"), (1, 4, "II"), (2, 3, "x"), (3, 1, "A"), (3, 4, "y"), (4, 2, "b"), (5, 1, ""), (5, 2, 7), (6, 1, "C"), (6, 2, "d"), (7, 3, "z"), (8, 1, "Requisitos de grado"), (8, 2, "TOTAL"), (9, 1, "later")])
    both = c.unionByName(c.where("row < 8").selectExpr("'g' AS file", "sheet", "row", "col", "value", "kind"))
    annotated = L.annotate_grid(both, L.detect_semester_grid(both))
    assert {(r.file, r.footer_row, r.is_total) for r in annotated.collect()} == {("f", 8, True), ("g", 2147483647, False)}
    got = sorted((r.file, r.row, r.category) for r in L.forward_fill_labels(annotated).collect())
    assert got == [(f, r, x) for f in "fg" for r, x in ((3, "A"), (4, "A - b"), (5, "A - b"), (6, "C - d"), (7, "C - d"))]
    ranged = L.detect_semester_grid(both)._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    plan = L.forward_fill_labels(annotated)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= ranged + 1


def test_one_exchange_of_the_cells(spark):
    plan = L.grid_sections(grid(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


def test_shapes(spark):
    s = spark.createDataFrame([("f", "s", 2, 5, " I "), ("f", "s", 6, 9, "II"), ("f", "s", 1, 1, "flecha"), ("g", "s", 2, 5, "I")],
                              "file string, sheet string, from_col int, to_col int, label string")
    assert sorted((r.file, r.label, r.start_col, r.end_col) for r in L.shape_semester_grid(s).collect()) == [("f", "I", 3, 6), ("f", "II", 7, 10)]


def test_spans(spark):
    s = spark.createDataFrame([("f", 1, 0, 50.0, 100.0, "mundo"), ("f", 1, 1, 10.0, 102.0, "Hola"), ("f", 1, 2, 5.0, 300.0, "•"), ("f", 1, 3, 0.0, 400.0, "12 a"),
                               ("f", 2, 0, 0.0, 3.0, "Otra página")], "file string, page int, seq int, x double, y double, text string")
    lines = L.spans_to_lines(s)
    assert L.lines_to_text(lines).first().text == "Hola mundo\n\nOtra página"


def test_parts(spark):
    p = spark.createDataFrame([("f", 1, 1, ["Título"]), ("f", 1, 2, ["a", " ", "b"]), ("f", 1, 3, ["", ""]), ("f", 2, 1, ["x"])], "file string, slide int, seq int, cells array<string>")
    assert L.slide_rows(p).first().text == "=== DIAPOSITIVA 1 ===\n\nTítulo\na | b\n\n=== DIAPOSITIVA 2 ===\n\nx"
    assert L.paragraph_rows(p.where("slide = 1")).first().text == "Título\n\na | b"
