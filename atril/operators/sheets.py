"""Semester grids in one ordered pass over the sheets.

A sheet's cells are brought together once, in row and column order.  Whole sheets are then read some ten thousand
cells at a time, as arrays: label ranges, footer, columns that hold fractions, categories, lines and credits of all
sheets of a block come from a few array operations.  A sheet is bounded by the upload limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHEET = ["file", "sheet"]
ROMAN = "^[IVXLCDM]+$"
# Marks that decide what a row says.
TOTAL, DEGREE, CREDIT, TYPE_MARKS = "TOTAL", "REQUISITOS DE GRADO", "CR", ("T", "TP", "P")
#: Cells read together; a larger sheet is read alone.
BLOCK = 50_000
FAR = np.iinfo(np.int64).max


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def codes_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def least(places: np.ndarray, values: np.ndarray, n: int, otherwise: int) -> np.ndarray:
    out = np.full(n, FAR)
    np.minimum.at(out, places, values)
    return np.where(out == FAR, otherwise, out)


def filled(sheet: np.ndarray, row: np.ndarray, col: np.ndarray, values: list[str]) -> tuple[np.ndarray, list[str]]:
    """Labels sorted by sheet, row and column: which are the last of their row, and the category that holds from there on."""
    last = np.append(changes(sheet, row)[1:], True)[: len(sheet)]
    made, at, margin = [], None, {}
    for of, place, value, done in zip(sheet.tolist(), col.tolist(), values, last.tolist(), strict=True):
        if of != at:
            at, margin = of, {}
        margin[place] = value
        if done:
            made.append(" - ".join(margin[c] for c in sorted(margin)))
    return last, made


class Block:
    """Cells of whole sheets, sorted by sheet, row and column; `codes` are their values in `words`."""

    def __init__(self, block: pa.RecordBatch, given: bool):
        names = [codes_of(block[k])[0] for k in SHEET]
        sheet = np.cumsum(changes(*names)) - 1
        self.codes, self.words = codes_of(block["value"])
        self.sheet, self.n_sheets = sheet, int(sheet[-1]) + 1
        self.row, self.col = (block[k].to_numpy(zero_copy_only=True).astype(np.int64) for k in ("row", "col"))
        self.is_number = block["is_number"].to_numpy(zero_copy_only=False)
        self.valid = block["number"].is_valid().to_numpy(zero_copy_only=False)
        self.number = block["number"].fill_null(0.0).to_numpy(zero_copy_only=False)
        self.is_cell = block["part"].to_numpy(zero_copy_only=False) != 0
        # Label ranges, sheet by sheet: places of the labels and last columns.
        self.label, self.end = self._given() if given else self._detected()
        of = self.sheet[self.label]
        self.first_col = least(of, self.col[self.label], self.n_sheets, -FAR)
        self.header_row = least(of, self.row[self.label], self.n_sheets, FAR)
        self.margin = self.is_cell & (self.col < self.first_col[sheet])

    def _given(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(~self.is_cell)
        return at, self.number[at].astype(np.int64)

    def _detected(self) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the first row with two Roman numerals; the last range reaches the sheet's last column."""
        at = np.flatnonzero(self.flag(pc.match_substring_regex(self.words, ROMAN))[self.codes])
        if not len(at):
            return at, at
        group = np.cumsum(changes(self.sheet[at], self.row[at])) - 1
        enough = np.flatnonzero(np.bincount(group) >= 2)
        of_group = self.sheet[at][np.flatnonzero(changes(group))]
        first = enough[np.unique(of_group[enough], return_index=True)[1]]
        at = at[np.isin(group, first)]
        if not len(at):
            return at, at
        last_col = np.full(self.n_sheets, -FAR)
        np.maximum.at(last_col, self.sheet, self.col)
        end = last_col[self.sheet[at]]
        same = self.sheet[at][1:] == self.sheet[at][:-1]
        end[:-1] = np.where(same, self.col[at][1:] - 1, end[:-1])
        return at, end

    @staticmethod
    def flag(found: pa.Array) -> np.ndarray:
        return found.fill_null(False).to_numpy(zero_copy_only=False)

    def is_one_of(self, *values: str) -> np.ndarray:
        return self.flag(pc.is_in(self.words, value_set=pa.array(values, self.words.type)))[self.codes]

    def footer_row(self) -> np.ndarray:
        """Per sheet: first row whose left margin has a total or the graduation requirements."""
        at = np.flatnonzero(self.margin)
        said, place = np.unique(self.codes[at], return_inverse=True)
        shown = [w.upper() for w in self.words.take(pa.array(said)).to_pylist()]
        ends = np.array([w.startswith(TOTAL) or DEGREE in w for w in shown], bool)
        at = at[ends[place]] if len(at) else at
        return least(self.sheet[at], self.row[at], self.n_sheets, FAR)

    def categories(self, shown: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Places of the cells behind which a category holds, until the next or the end of the sheet, and the categories."""
        at = np.flatnonzero(shown & self.margin & ~self.is_number & (self.row >= self.header_row[self.sheet]))
        values = self.words.take(pa.array(self.codes[at])).to_pylist()
        last, made = filled(self.sheet[at], self.row[at], self.col[at], values)
        return at[last], pa.array([*made, ""], pa.string())

    def sections(self) -> Iterator[tuple]:
        """(places of a cell of the row, places of the label, lines, credits) of the course rows, one range of every sheet at a time."""
        body = self.is_cell & (self.row < self.footer_row()[self.sheet])
        column = self.sheet * (int(self.col.max()) - int(self.col.min()) + 1) + self.col - self.col.min()
        with np.errstate(invalid="ignore"):
            fractions = np.unique(column[body & self.is_number & self.valid & (self.number % 1 != 0)])
        shown = body & ~self.is_one_of("")
        height = int(self.row.max()) - int(self.row.min()) + 1
        place = self.sheet * height + self.row - self.row.min()
        since, category = self.categories(shown)
        is_mark, is_type = self.is_one_of(CREDIT), self.is_one_of(*TYPE_MARKS)
        of = self.sheet[self.label]
        begins = np.flatnonzero(changes(of))
        rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
        left = np.flatnonzero(shown & ~np.isin(column, fractions))
        for k in range(int(rank.max(initial=-1)) + 1):
            mine = np.flatnonzero(rank == k)
            label, hi = np.full(self.n_sheets, -1), np.full(self.n_sheets, -FAR)
            label[of[mine]], hi[of[mine]] = self.label[mine], self.end[mine]
            left = left[label[self.sheet[left]] >= 0]
            named = label[self.sheet[left]]
            at = left[(self.col[left] >= self.col[named]) & (self.col[left] <= hi[self.sheet[left]])]
            begin = changes(self.sheet[at], self.row[at])
            group = np.cumsum(begin) - 1
            size = np.bincount(group)
            first = at[begin]
            alone = (size == 1) & (self.codes[first] == self.codes[label[self.sheet[first]]])
            at, first, size = at[~alone[group]], first[~alone], size[~alone]
            if not len(at):
                continue
            begin = np.cumsum(size) - size
            lines = self.lines(at, begin)
            behind = np.searchsorted(place[since], place[first], side="right") - 1
            known = (behind >= 0) & (self.sheet[since[np.maximum(behind, 0)]] == self.sheet[first]) if len(since) else np.zeros(len(first), bool)
            above = category.take(pa.array(np.where(known, behind, len(since))))
            lines = pc.if_else(pa.array(known), pc.binary_join_element_wise(above, lines, " | "), lines)
            yield first, label[self.sheet[first]], lines, self.credits(at, begin, size, is_mark, is_type)

    def lines(self, at: np.ndarray, begin: np.ndarray) -> pa.Array:
        """Cells of a row from its first to its last column; of several in one place the last counts."""
        starts = np.zeros(len(at), bool)
        starts[begin] = True
        covered = np.append(~starts[1:] & (self.col[at][1:] == self.col[at][:-1]), False)
        if covered.any():
            group = (np.cumsum(starts) - 1)[~covered]
            at = at[~covered]
            starts = changes(group)
        gap = np.where(starts, 0, np.diff(self.col[at], prepend=0))
        wide, which = np.unique(gap, return_inverse=True)
        between = pa.array([" | " * int(g) for g in wide], pa.string()).take(pa.array(which))
        pieces = pc.binary_join_element_wise(between, self.words.take(pa.array(self.codes[at])).cast(pa.string()), "")
        ends = np.append(np.flatnonzero(starts), len(at)).astype(np.int32)
        return pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), ""), characters=" |")

    def credits(self, at: np.ndarray, begin: np.ndarray, size: np.ndarray, is_mark: np.ndarray, is_type: np.ndarray) -> pa.Array:
        """The credit a row states: behind its mark, behind a type mark, or last of nothing but numbers."""
        end = begin + size
        mark = np.minimum.reduceat(np.where(is_mark[at], np.arange(len(at)), len(at)), begin)
        marked = mark + 1 < end
        typed = (size > 1) & is_type[at[np.maximum(end - 2, 0)]]
        stated = at[np.where(marked, np.minimum(mark + 1, len(at) - 1), end - 1)]
        says = marked | typed | np.logical_and.reduceat(self.valid[at], begin)
        with np.errstate(invalid="ignore"):
            fits = says & self.valid[stated] & (np.abs(self.number[stated]) < 2.0**63)
        return pa.array(np.trunc(np.where(fits, self.number[stated], 0.0)).astype(np.int64), mask=~fits)


def whole_sheets(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again in batches that end where a sheet ends, of `size` rows or one larger sheet."""

    def name(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch[k][i].as_py() for k in SHEET)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= size and name(held[0], 0) != name(batch, -1):
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(changes(*(codes_of(block[k])[0] for k in SHEET)))[-1])
            yield block.slice(0, cut)
            held = [block.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fill_labels(per_sheet: DataFrame) -> DataFrame:
    """(file, sheet, row, category) from one row per sheet with its `rows` and `labels` (row, col, value); rows above the first label are left out."""
    kinds = {f.name: f.dataType for f in per_sheet.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in SHEET), T.StructField("row", kinds["rows"].elementType), T.StructField("category", T.StringType())])
    arrow = to_arrow_schema(schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = batch["rows"].flatten(), batch["labels"].flatten()
            if not len(labels):
                continue
            every = np.arange(batch.num_rows)
            of = np.repeat(every, pc.list_value_length(batch["rows"]).to_numpy(zero_copy_only=False))
            sheet = np.repeat(every, pc.list_value_length(batch["labels"]).to_numpy(zero_copy_only=False))
            place = rows.to_numpy(zero_copy_only=False).astype(np.int64)
            row, col = (labels.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("row", "col"))
            order = np.lexsort((col, row, sheet))
            sheet, row = sheet[order], row[order]
            last, made = filled(sheet, row, col[order], labels.field("value").take(pa.array(order)).to_pylist())
            since, least_row = sheet[last], int(place.min())
            height = int(place.max()) - least_row + 1
            behind = np.searchsorted(since * height + row[last] - least_row, of * height + place - least_row, side="right") - 1
            known = (behind >= 0) & (since[np.maximum(behind, 0)] == of)
            at = pa.array(of[known])
            columns = [*(batch[k].take(at) for k in SHEET), pa.array(place[known]), pa.array(made, pa.string()).take(pa.array(behind[known]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return per_sheet.where(F.size("labels") > 0).mapInArrow(fill, schema)


def stated_number(value: Column) -> Column:
    """`value` as a double, if it is one.  A failed cast costs far more than a look at the first character that could begin a number."""
    return F.when(value.rlike("^[\\x00-\\x20]*[+-]?[0-9.nNiI]"), value.try_cast("double"))


def sections(cells: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Course rows per semester block: (file, sheet, label, start_col, row, line, credit).

    Without `ranges` (file, sheet, label, start_col, end_col, header_row) those of L4 are found in the same walk.
    The cells go through one exchange, by sheet; a sheet's ranges travel as rows before its cells.  Cells without a row or column are left out.
    """
    spark, kinds = cells.sparkSession, {f.name: f.dataType for f in cells.schema}
    rows = cells.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select(
        *SHEET, F.lit(1).alias("part"), "row", "col", F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce(F.col("kind") == "number", F.lit(False)).alias("is_number"), stated_number(F.col("value")).alias("number"))
    if ranges is not None:
        rows = rows.unionByName(ranges.select(
            *SHEET, F.lit(0).alias("part"), F.col("header_row").cast(kinds["row"]).alias("row"), F.col("start_col").cast(kinds["col"]).alias("col"),
            F.col("label").alias("value"), F.lit(False).alias("is_number"), F.col("end_col").cast("double").alias("number")))
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in SHEET), T.StructField("label", T.StringType()), T.StructField("start_col", kinds["col"]),
                           T.StructField("row", kinds["row"]), T.StructField("line", T.StringType()), T.StructField("credit", T.LongType())])
    arrow, given = to_arrow_schema(schema), ranges is not None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_sheets(batches):
            block = Block(rows, given)
            for at, label, lines, credit in block.sections():
                at, label = pa.array(at), pa.array(label)
                made = [*(rows[k].take(at) for k in SHEET), rows["value"].take(label), rows["col"].take(label), rows["row"].take(at), lines, credit]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    # As many tasks as the session shuffles to: the walk is work for processors, so small inputs are not gathered in few tasks.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *SHEET)
    return dealt.sortWithinPartitions(*SHEET, "part", "row", "col").mapInArrow(walk, schema)
