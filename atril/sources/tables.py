"""Table source and sinks."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atril.session import materialise


def scan_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """S4."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("doc_bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))


def _now() -> int:
    """Number of a write: later writes of this process have larger ones."""
    return time.time_ns()


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Append the chunks of newly ingested documents, partitioned by document bucket.

    Rows are rebalanced: a bucket, or one document's chunks, beyond the advisory partition
    size is split over as many tasks and files as its size asks for, and small ones share a task.
    """
    rows = _bucketed(chunks, buckets).withColumn("written", F.lit(_now()))
    rows.hint("rebalance", "doc_bucket").write.mode("append").partitionBy("doc_bucket").parquet(f"{path}/chunks")


def delete_documents(ids: DataFrame, path: str) -> None:
    """S9 on the stored table: chunks of these documents written so far are gone for every reader from now on.

    Only the ids are written, to a list beside the chunks (one small file for a few documents); `compact` removes
    the chunks from the files.  Deleting a document that is not there, or twice, changes nothing.
    """
    gone = ids.select("document_id").where("document_id IS NOT NULL").distinct().withColumn("deleted", F.lit(_now()))
    gone.hint("rebalance").write.mode("append").parquet(f"{path}/deleted")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored chunks with `dead`, whether their document was deleted after they were written."""
    chunks = spark.read.parquet(f"{path}/chunks")
    try:
        listed = spark.read.parquet(f"{path}/deleted")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return chunks.withColumn("dead", F.lit(False))  # nothing was deleted yet
    gone = listed.groupBy("document_id").agg(F.max("deleted").alias("deleted"))
    return chunks.join(gone, "document_id", "left").withColumn("dead", F.coalesce(F.col("deleted") > F.col("written"), F.lit(False))).drop("deleted")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the table without those of deleted documents (merge on read: the list of deleted ids is narrow,
    and the planner broadcasts it while it is small)."""
    return _stored(spark, path).where("NOT dead").drop("dead", "written", "doc_bucket")


def replace_documents(path: str, fresh: DataFrame, buckets: int = 64) -> None:
    """S9, re-ingested: the documents of `fresh` have the chunks of `fresh` only."""
    delete_documents(fresh, path)
    write_chunks(fresh, path, buckets)


def compact(spark: SparkSession, path: str, dead_share: float = 0.2) -> int:
    """Rewrite the buckets of which more than `dead_share` of the rows are dead, and return their number.

    Readers see the same rows before and after.  The living rows are stored aside first, so a job that is lost half-way
    can be started again.  A bucket without living rows keeps its files; they stay hidden by the list of deletions.
    """
    stored = _stored(spark, path)
    counts = stored.groupBy("doc_bucket").agg(F.avg(F.col("dead").cast("int")).alias("share"))
    touched = [r.doc_bucket for r in counts.where(F.col("share") > dead_share).collect()]  # at most as many numbers as buckets
    if not touched:
        return 0
    living = materialise(stored.where(F.col("doc_bucket").isin(touched) & ~F.col("dead")).drop("dead"), "living")
    living.hint("rebalance", "doc_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "doc_bucket").parquet(f"{path}/chunks")
    return len(touched)


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with total_chunks and completed / failed."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return documents.join(n, "document_id", "left").withColumns({
        "total_chunks": F.coalesce("total_chunks", F.lit(0)),
        "ingestion_status": F.when(F.col("error").isNull(), "completed").otherwise("failed"),
    })


def write_eval_results(cases: DataFrame, path: str, fmt: str = "json") -> None:
    """Nested result rows of a run."""
    cases.write.mode("overwrite").format(fmt).save(path)
