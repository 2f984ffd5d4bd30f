"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from atril.session import materialise, ship_package

__all__ = ["Sieve", "arrow_map", "arrow_tally", "components", "corpus_text", "extended", "held_out", "hold_batches", "materialise", "put_back", "set_aside", "table", "words"]

#: Bytes of an Arrow batch on its way to Python.  A task holds it outside the heap of its executor and once more in its worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by `BATCH_BYTES`; a bound that the session has set stays.

    Spark cuts batches by rows (10 000) and only then by bytes; that many whole texts of two tasks, kept by two allocators, are a
    good part of a small executor.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)


def corpus_text(docs: DataFrame, *keep: str) -> DataFrame:
    """`doc_id`, the columns of `keep` and the text, with null texts as empty ones."""
    return docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(modulus: int, remainder: int) -> Column:
    """True where crc32 of the decimal doc_id leaves `remainder`; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8 (`bytes` methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def extended(df: DataFrame, more: str = "") -> StructType:
    """Schema of `df` with the fields of a schema string behind it; names of any spelling stay as they are."""
    return StructType([*df.schema.fields, *(StructType.fromDDL(more).fields if more else ())])


def set_aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, DataFrame]:
    """`df` with its columns of these names under names that no column has, and a rowless frame of its own columns
    for `put_back`."""
    own = "_" * (1 + max(map(len, df.columns), default=0))
    return df.withColumnsRenamed({c: f"{own}{c}" for c in df.columns if c in names}), df.limit(0)


def put_back(df: DataFrame, before: DataFrame, names: set[str]) -> DataFrame:
    """The columns `before` had, in its order; those set aside under their own names again."""
    own = "_" * (1 + max(map(len, before.columns), default=0))
    return df.select(*(F.col(f"`{own}{c}`").alias(c) if c in names else F.col(f"`{c}`") for c in before.columns))


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType, step: int = 1024) -> DataFrame:
    """Apply `rows` (columns in, columns out, as lists or Arrow arrays) to the Arrow batches of `df`, at most `step` rows at once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                out = rows(batch.slice(start, step).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def arrow_tally(df: DataFrame, add: Callable[[dict[str, list], dict], None], schema: str, limit: int = 500_000) -> DataFrame:
    """(key, amount) rows: `add` tallies a batch into a dict, which is given out when it holds `limit` keys and at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def out(tally: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip((tally.keys(), tally.values()), target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                add(batch.slice(start, 1024).to_pydict(), tally)
                if len(tally) > limit:
                    yield out(tally)
                    tally = {}
        if tally:
            yield out(tally)

    return df.mapInArrow(run, schema)


#: Bits of a `Sieve`: 16 MB, whatever the number of values.
SIEVE_BITS = 27


class Sieve:
    """A Bloom filter of fixed size over evenly spread longs, sent to all tasks.

    It lets through every value it was built from and few others; when there are too many values for its size
    it lets everything through, which costs a larger shuffle and never a row.
    """

    def __init__(self, values: DataFrame, value: str):
        import numpy as np

        mask, chunk = (1 << SIEVE_BITS) - 1, 16

        def pack(rows: pa.Table) -> pa.Table:
            bits = np.zeros(1 << chunk, np.uint8)
            bits[rows["at"].to_numpy() & ((1 << chunk) - 1)] = 1
            return pa.table({"chunk": [rows["chunk"][0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        at = values.select((F.col(value).bitwiseAND(mask)).alias("at")).distinct().withColumn("chunk", F.shiftright("at", chunk))
        packed = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
        for r in at.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect():
            packed[r.chunk << (chunk - 3) : (r.chunk + 1) << (chunk - 3)] = np.frombuffer(r.bits, np.uint8)
        self.bits = values.sparkSession.sparkContext.broadcast(packed)

    def __call__(self, values):
        """Boolean array: which of the int64 array may be among the values."""
        at = values & ((1 << SIEVE_BITS) - 1)
        return (self.bits.value[at >> 3] >> (at & 7)) & 1 == 1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (`node`, `component`), the component being its smallest node.

    Alternates large-star and small-star steps; every step is a map-side combined minimum per node and a
    join AQE can split, and is written to the shared folder, so a node with very many links is no hot spot
    and a lost executor costs one step.  Nodes without links do not appear.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("m", F.col("v").alias("w")).where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
