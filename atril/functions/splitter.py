"""Document splitters: prose by separators, tabular text by rows.

Both work on one document at a time (bounded by the upload limit) inside an Arrow
function; Spark spreads documents over tasks and no shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from atril import settings as S

# Separators from coarse to fine, and the section marker lines.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", " "]
SECTION_LINE = re.compile(r"^(=== HOJA: .+? ===|=== DIAPOSITIVA \d+ ===)$", re.MULTILINE)

Span = tuple[int, int]


def prose_spans(text: str, limit: int, overlap: int) -> list[Span]:
    """Spans of `text`, each a chunk.

    Every chunk, its overlap included, is one contiguous stretch, so the splitter
    only moves two offsets over the text and copies nothing.
    """
    out: list[Span] = []
    finest = len(SEPARATORS) - 1

    def windows(lo: int, hi: int) -> None:
        out.extend((at, min(at + limit, hi)) for at in range(lo, hi, limit - overlap))

    def walk(lo: int, hi: int, level: int) -> None:
        sep = next((s for s in SEPARATORS[level:] if text.find(s, lo, hi) >= 0), SEPARATORS[finest])
        open_at = open_to = at = lo
        while True:
            hit = text.find(sep, at, hi)
            end = hi if hit < 0 else hit
            begin = open_at if open_to > open_at else at
            if end - begin <= limit:
                open_at, open_to = begin, end
            elif open_to > open_at:
                out.append((open_at, open_to))
                reuse = 0 < overlap < open_to - open_at
                open_at, open_to = (open_to - overlap if reuse else at), end
            else:
                windows(at, end) if level == finest else walk(at, end, level + 1)
                open_at = open_to = end
            if hit < 0:
                break
            at = hit + len(sep)
        if text[open_at:open_to].strip():
            out.append((open_at, open_to))

    if len(text) > limit:
        walk(0, len(text), 0)
    elif text.strip():
        out.append((0, len(text)))
    return out


def split_prose(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(position among all pieces, content) of the non-blank pieces."""
    spans = prose_spans(text, size * S.CHARS_PER_TOKEN, overlap * S.CHARS_PER_TOKEN)
    pieces = ((i, text[a:b].strip()) for i, (a, b) in enumerate(spans))
    return [(i, p) for i, p in pieces if p]


def _sections(text: str) -> Iterator[tuple[str, list[str]]]:
    """(marker line or '', non-blank rows) per section."""
    marks = [(m.group(1), m.start(), m.end()) for m in SECTION_LINE.finditer(text)]
    edges = [("", 0, 0), *marks, ("", len(text), len(text))]
    for (marker, _, body), (_, until, _) in zip(edges, edges[1:]):
        rows = [r for r in text[body:until].split("\n") if r.strip()]
        if rows:
            yield marker, rows


def _groups(rows: list[str]) -> Iterator[tuple[str | None, list[str]]]:
    """Rows under each sub-header; rows before the first one have label None.

    A sub-header is a row without a pipe directly before a row with one.
    """
    label, members = None, []
    for row, following in zip(rows, [*rows[1:], ""]):
        if "|" not in row and "|" in following:
            yield label, members
            label, members = row, []
        else:
            members.append(row)
    yield label, members


def _packed(rows: list[str], room: int, overlap: int) -> Iterator[list[str]]:
    """Whole rows packed to at most `room` characters, trailing rows repeated as overlap."""
    batch, used = [], 0
    for row in rows:
        cost = len(row) + 1
        if batch and used + cost > room:
            yield batch
            used, first = 0, len(batch)
            while first and used + len(batch[first - 1]) + 1 <= overlap:
                first -= 1
                used += len(batch[first]) + 1
            batch = batch[first:]
        batch.append(row)
        used += cost
    if batch:
        yield batch


def split_rows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Chunks of whole rows, each under its section marker and sub-header."""
    limit, tail = size * S.CHARS_PER_TOKEN, overlap * S.CHARS_PER_TOKEN
    out: list[str] = []
    for marker, rows in _sections(text):
        for label, members in _groups(rows):
            prefix = "".join(f"{line}\n" for line in (marker, label) if line)
            if members:
                out += [prefix + "\n".join(b) for b in _packed(members, limit - len(prefix), tail)]
            elif label is not None:
                out.append(prefix.rstrip())
    return list(enumerate(c for c in out if c.strip()))


PIECES = T.ArrayType(T.StructType([
    T.StructField("raw_index", T.IntegerType()), T.StructField("content", T.StringType())]))


#: Characters of the texts whose results a Python worker holds at once.
SLICE_CHARS = 2_000_000


def slices(batches: Iterator[pd.Series], limit: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """The texts of Arrow batches in stretches of at most `limit` characters, or one text: a batch has a fixed number of
    rows, whatever their length, and the results of all of them are several times its size."""
    for texts in batches:
        start = used = 0
        for at, text in enumerate(texts):
            n = len(text) if isinstance(text, str) else 0
            if at > start and used + n > limit:
                yield texts.iloc[start:at]
                start, used = at, 0
            used += n
        yield texts.iloc[start:]


def splitter(kind: str, size: int, overlap: int):
    """Arrow function text -> array of pieces; a document that fails gives NULL."""
    cut = split_rows if kind == "rows" else split_prose

    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return None if text is None else [{"raw_index": i, "content": c} for i, c in cut(text, size, overlap)]
            except Exception:
                return None

        for texts in slices(batches):
            yield texts.map(one)

    return pieces


@udtf(returnType="chunk_index int, content string, token_count int")
class ChunkText:
    """SQL form: SELECT * FROM chunk_text(text, size, overlap)."""

    def eval(self, text: str, size: int, overlap: int):
        for n, (_, content) in enumerate(split_prose(text or "", size, overlap)):
            yield n, content, len(content) // S.CHARS_PER_TOKEN


def register_chunk_text(spark) -> None:
    spark.udtf.register("chunk_text", ChunkText)
