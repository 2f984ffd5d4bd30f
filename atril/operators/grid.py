"""Blocked matrix product of question vectors and chunk vectors.

Questions are dealt by hash to blocks of bounded rows; chunks are packed batch by batch where they are scanned.
A cell of the grid is one block of questions and one pack of chunks, formed by an equi-join on the block's number, so
any number of questions takes one job with one scan of the chunks.  Within a task a block keeps its
k best rows from cell to cell; only those leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from atril import settings as S

#: Chunks packed together, cells the grid has at least beyond the broadcast bound, and blocks a task keeps at once.
PACK_ROWS = 2048
CELLS = 1024
HELD_BLOCKS = 64


def unit_rows(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors with `size` entries; a zero vector stays zero."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    if len(at) < len(lengths):
        vectors = vectors.take(pa.array(at))
    m = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), size)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    length[length == 0] = np.inf
    return at, m / length[:, None]


def numbered(values: pa.Array) -> tuple[dict, np.ndarray]:
    """(number of each value, number per row; -2 for null)."""
    coded = values.dictionary_encode()
    codes = pc.fill_null(coded.indices, -2).to_numpy(zero_copy_only=False)
    return {v: i for i, v in enumerate(coded.dictionary.to_pylist())}, codes


class _Asked:
    """The questions of a block whose vectors have one length, grouped by the filters they set."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, filters: list[pa.Array]):
        self.ids, self.matrix = ids, matrix
        self.groups: dict[tuple, list[int]] = {}
        for q, wanted in enumerate(zip(*(f.to_pylist() for f in filters), strict=True)):
            self.groups.setdefault(wanted, []).append(q)

    def scores(self, vectors: np.ndarray, filters: list[tuple[dict, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, -inf where a filter excludes the chunk; number of admitted chunks per question).

        `filters`: per field the numbers of its values and the number each chunk has.
        """
        out = np.round(self.matrix @ vectors.T, 8)
        admitted = np.full(len(self.matrix), len(vectors), dtype=np.int64)
        for wanted, at in self.groups.items():
            given = [codes == number.get(w, -1) for (number, codes), w in zip(filters, wanted, strict=True) if w is not None]
            if given:
                mask = np.logical_and.reduce(given)
                out[np.ix_(at, np.flatnonzero(~mask))] = -np.inf
                admitted[at] = mask.sum()
        return out, admitted


class _Best:
    """Running k best (score down, id up) of every question of a block."""

    def __init__(self, asked: _Asked, k: int, floor: float):
        self.asked, self.k = asked, k
        self.floor = np.full(len(asked.matrix), floor)
        self.rows, self.score, self.id = np.empty(0, np.int64), np.empty(0), None

    def offer(self, ids: np.ndarray, vectors: np.ndarray, filters: list[tuple[dict, np.ndarray]]) -> None:
        scores, _ = self.asked.scores(vectors, filters)
        if scores.shape[1] > self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero(scores >= self.floor[:, None])
        if not len(q):
            return
        rows, score = np.concatenate([self.rows, q]), np.concatenate([self.score, scores[q, c]])
        found = ids[c] if self.id is None else np.concatenate([self.id, ids[c]])
        order = np.lexsort((found, -score, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        self.rows, self.score, self.id = rows[kept], score[order][kept], found[order][kept]
        full = rank[kept] == self.k - 1
        at = self.rows[full]
        self.floor[at] = np.maximum(self.floor[at], self.score[full])

    def columns(self) -> list:
        return [] if self.id is None else [self.asked.ids.take(pa.array(self.rows)), self.id, self.score]


class _Summary:
    """Admitted chunks and best cosine of every question of a block."""

    def __init__(self, asked: _Asked):
        self.asked = asked
        self.n, self.best = np.zeros(len(asked.matrix), np.int64), np.full(len(asked.matrix), -np.inf)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, filters: list[tuple[dict, np.ndarray]]) -> None:
        scores, admitted = self.asked.scores(vectors, filters)
        self.n += admitted
        self.best = np.maximum(self.best, scores.max(axis=1))

    def columns(self) -> list:
        seen = np.flatnonzero(self.n)
        return [self.asked.ids.take(pa.array(seen)), self.n[seen], self.best[seen]] if len(seen) else []


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PACK_ROWS):
            part = batch.slice(start, PACK_ROWS)
            ends = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays([c])) for c in part.columns], names=batch.schema.names)


def _cells(queries: DataFrame, chunks: DataFrame, filters: list[str]) -> DataFrame:
    """One row per cell: `block`, the questions `asked` and the packed columns of the chunks."""
    measured = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("query_embedding") + 64), F.lit(0)).alias("b")).first()
    blocks = max(1, math.ceil(measured.n / S.QUERY_BLOCK_ROWS), math.ceil(measured.b / S.QUERY_BLOCK_BYTES))
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(
        F.collect_list(F.struct("query_id", "query_embedding", *filters)).alias("asked")
    )
    fields = [c for c in chunks.schema]
    packs = chunks.mapInArrow(_packed, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if measured.b <= S.QUERY_BLOCK_BYTES:  # all questions together are one small table: the packs stay where they are
        return packs.withColumn("block", numbers(blocks)).join(F.broadcast(asked), "block")
    # Beyond: every block is dealt to several cells.  A whole partition of chunks belongs to one of them, so a task that is
    # run again sends the same chunks to the same cells.
    salts = max(1, math.ceil(CELLS / blocks))
    return (
        packs.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withColumn("block", numbers(blocks))
        .join(asked.withColumn("salt", numbers(salts)), ["block", "salt"]).drop("salt")
    )


def blocked_product(queries: DataFrame, chunks: DataFrame, filters: list[str], k: int | None, floor: float = -2.0) -> DataFrame:
    """Partial results per task: (query_id, chunk_id, raw) of the k best, or with `k` None (query_id, n, best).

    `queries`: query_id, query_embedding and the columns of `filters` (null: no restriction); `chunks`: chunk_id, embedding
    and those columns.  Rows with a null vector take no part; vectors of another length than the question's are
    not compared with it.
    """
    source = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", *filters)
    cells = _cells(queries.where(F.col("query_embedding").isNotNull()), source, filters)
    found = ([source.schema["chunk_id"], T.StructField("raw", T.DoubleType())] if k is not None
             else [T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())])
    schema = T.StructType([queries.schema["query_id"], *found])
    arrow = to_arrow_schema(schema)

    def states(asked: pa.StructArray) -> dict[int, _Best | _Summary]:
        vectors, out = asked.field("query_embedding"), {}
        for size in pc.unique(pc.list_value_length(vectors)).to_pylist():
            at, matrix = unit_rows(vectors, size)
            places = pa.array(at)
            part = _Asked(asked.field("query_id").take(places), matrix, [asked.field(f).take(places) for f in filters])
            out[size] = _Summary(part) if k is None else _Best(part, k, floor)
        return out

    def out(state: dict) -> Iterator[pa.RecordBatch]:
        for part in state.values():
            if columns := part.columns():
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row, block in enumerate(column["block"].to_pylist()):
                if block not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield from out(held.pop(next(iter(held))))
                    held[block] = states(column["asked"][row].values)
                ids, vectors = column["chunk_id"][row].values, column["embedding"][row].values
                values = [numbered(column[f][row].values) for f in filters]
                for size, state in held[block].items():
                    at, matrix = unit_rows(vectors, size)
                    if len(at):
                        own = ids.to_numpy(zero_copy_only=False)[at]
                        state.offer(own.astype(str) if own.dtype == object else own, matrix, [(number, codes[at]) for number, codes in values])
        for state in held.values():
            yield from out(state)

    return cells.select("block", "asked", "chunk_id", "embedding", *filters).mapInArrow(run, schema)
