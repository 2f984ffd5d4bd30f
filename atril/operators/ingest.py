"""Ingestion: splitting, summary checks, embedding, the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atril import settings as S
from atril.functions import text as tx
from atril.functions.splitter import splitter
from atril.functions.unicode import let
from atril.functions.vector import hashed_embedder
from atril.operators.rows import content_hash_duplicates
from atril.session import materialise
from atril.sources.files import csv_rows_text, decode_text

TABULAR_TYPES = ["xlsx", "xls", "csv", "pptx"]
SUMMARY_TYPES = ["pdf", "docx"]
SEMESTER_LINE = "(?iu)^(SEMESTRE\\s+\\d+)\\s*:\\s*(.+)$"


def _explode_pieces(docs: DataFrame, pieces: Column) -> DataFrame:
    out = docs.select("document_id", F.posexplode(pieces).alias("chunk_index", "p"))
    return out.select(
        "document_id", "chunk_index", F.col("p.content").alias("content"),
        tx.token_count(F.col("p.content")).alias("token_count"),
        F.create_map(F.lit("chunk_index"), F.col("p.raw_index").cast("string")).alias("metadata"))


def chunk_prose(docs: DataFrame, size: int = S.CHUNK_SIZE_TOKENS, overlap: int = S.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """C4: docs(document_id, text) to chunks."""
    return _explode_pieces(docs, splitter("prose", size, overlap)("text"))


def chunk_rows(docs: DataFrame, size: int = S.CHUNK_SIZE_TOKENS, overlap: int = S.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """C5."""
    return _explode_pieces(docs, splitter("rows", size, overlap)("text"))


def validate_summary(docs: DataFrame) -> DataFrame:
    """docs(document_id, text, summary); `summary` keeps only courses whose words the
    text backs.  Works inside each row on the document's word set; nothing is shuffled."""
    lines = F.transform(
        F.split("summary", "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"), tx.strip)
    formed = F.filter(lines, lambda ln: ln.rlike(SEMESTER_LINE))

    def backed(course: Column, known: Column) -> Column:
        words = F.filter(tx.alnum_words(course), lambda w: F.length(w) >= 4)
        hits = lambda ws: F.size(F.filter(ws, lambda w: F.array_contains(known, w)))
        return let(words, lambda ws: (F.size(ws) > 0) & (hits(ws) >= F.ceil(F.size(ws) / 2)))

    def check(line: Column, known: Column) -> Column:
        courses = F.transform(F.split(F.regexp_extract(line, SEMESTER_LINE, 2), ","), tx.strip)
        kept = F.filter(courses, lambda c: (c != "") & backed(c, known))
        return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(
            F.regexp_extract(line, SEMESTER_LINE, 1), F.lit(": "), F.array_join(k, ", "))))

    def judge(x: Column) -> Column:
        checked = F.array_join(F.array_compact(F.transform(x["formed"], lambda ln: check(ln, x["known"]))), "\n")
        return F.when(F.size(x["formed"]) == 0, "").when(F.size(x["known"]) < 20, F.col("summary")).otherwise(checked)

    known = F.array_distinct(tx.alnum_words(F.col("text")))
    both = F.when(F.col("summary").isNotNull(), F.struct(known.alias("known"), formed.alias("formed")))
    return docs.withColumn("summary", F.when(F.col("summary").isNotNull(), let(both, judge)))


def build_document_text(docs: DataFrame) -> DataFrame:
    """Prepend a non-empty validated `summary` to the text of pdf and docx documents."""
    framed = F.concat(
        F.lit(S.SUMMARY_OPEN + "\n"), F.col("summary"), F.lit("\n" + S.SUMMARY_CLOSE + "\n\n"), F.col("text"))
    wants = F.col("file_type").isin(*SUMMARY_TYPES) & (F.coalesce("summary", F.lit("")) != "")
    return docs.withColumn("text", F.when(wants, framed).otherwise(F.col("text")))


def routed_pieces(size: int, overlap: int) -> Column:
    """Rows splitter for tabular types, prose splitter otherwise, in one pass; the
    splitter a document does not need receives NULL."""
    tabular = F.col("file_type").isin(*TABULAR_TYPES)
    return F.coalesce(
        splitter("rows", size, overlap)(F.when(tabular, F.col("text"))),
        splitter("prose", size, overlap)(F.when(~tabular, F.col("text"))))


def embed_texts(
    df: DataFrame, column: str = "content", embed_fn: Callable = hashed_embedder, model: str = "hashed-64",
    out: str = "embedding", batch: int = S.EMBED_BATCH,
) -> DataFrame:
    """Vectors for `column`, each distinct (model, text) embedded once.

    Distinct texts come from a map-side combined aggregate, so a text that many rows share leaves each task once.  Vectors
    come back by a left join on the texts' hashes, unique on the vectors' side, whose hot hashes AQE splits
    on the rows' side.  Rows without a text have no vector.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embedded(texts: pd.Series) -> pd.Series:
        made: list = []
        for at in range(0, len(texts), batch):
            made += list(embed_fn(list(texts.iloc[at: at + batch])))
        return pd.Series(made)

    keyed = df.withColumn("_key", tx.content_hash(F.concat_ws("\u0001", F.lit(model), F.col(column))))
    unique = keyed.where(F.col(column).isNotNull()).groupBy("_key").agg(F.any_value(column).alias("_text"))
    vectors = unique.select("_key", embedded("_text").alias(out))
    return keyed.join(vectors, "_key", "left").withColumn(out, F.when(F.col(column).isNotNull(), F.col(out))).drop("_key")


def ingest_documents(
    files: DataFrame, known_documents: DataFrame | None = None, embed_fn: Callable = hashed_embedder,
    size: int = S.CHUNK_SIZE_TOKENS, overlap: int = S.CHUNK_OVERLAP_TOKENS, model: str = "hashed-64",
) -> tuple[DataFrame, DataFrame]:
    """files(file_name, content BINARY, optional decoded STRING and summary STRING) to
    (documents, chunks).

    Binary office formats arrive with their decoded text in `decoded`.  The document id is
    derived from the bytes, so a rerun gives the same rows.  A document that cannot be read
    or split is reported as failed and does not disturb the others.  Every row of `files` gives
    one document row: of rows with equal bytes the first by name is ingested and the others are
    duplicates, whatever their names; content left out by `scan_files` (its `length` is over the
    limit) is too large; other rows without content are unreadable.
    """
    f = files
    for extra, kind in (("decoded", "string"), ("summary", "string"), ("length", "long")):
        if extra not in f.columns:
            f = f.withColumn(extra, F.lit(None).cast(kind))
    # File names repeat, so a row is told apart by a number that is written down before it is used.
    f = materialise(f.withColumn("_row", F.monotonically_increasing_id()), "uploads")
    kind = F.coalesce(tx.file_type(F.col("file_name")), F.lit("txt"))
    f = f.withColumns({
        "file_type": kind,
        "content_hash": tx.content_hash(F.coalesce(F.col("content"), F.col("decoded").cast("binary"))),
        "too_large": F.coalesce(F.col("length"), F.length("content"), F.lit(0)) > S.MAX_UPLOAD_BYTES,
    }).withColumn("upload_id", F.struct("file_name", "_row"))
    empty = f.where(~F.col("too_large") & F.col("content_hash").isNull())
    small = f.where(~F.col("too_large") & F.col("content_hash").isNotNull())
    if known_documents is None:
        known_documents = small.select("content_hash", F.lit("failed").alias("ingestion_status")).limit(0)
    fresh, duplicate = content_hash_duplicates(small, known_documents)

    raw = decode_text(F.col("content"))
    text = F.coalesce(
        F.col("decoded"),
        F.when(F.col("file_type") == "txt", raw),
        F.when(F.col("file_type") == "csv", csv_rows_text(F.when(F.col("file_type") == "csv", raw))))
    read = fresh.withColumn("document_id", F.col("content_hash")).withColumn("text", tx.clean_text(text))
    read = materialise(read.drop("content", "upload_id", "_row", "too_large"), "texts")  # each text is decoded once
    summed = build_document_text(validate_summary(read))
    split = summed.withColumn("pieces", routed_pieces(size, overlap)).select(
        "document_id", "file_name", "file_type", "content_hash", F.col("text").isNull().alias("unread"), "pieces")
    split = materialise(split, "pieces")  # read, cleaned and split once for both results
    error = F.when(F.col("unread"), "unreadable").when(F.col("pieces").isNull(), "unsplittable")

    done = split.select(
        "document_id", "file_name", "file_type", "content_hash",
        F.when(error.isNull(), "completed").otherwise("failed").alias("ingestion_status"),
        F.coalesce(F.size("pieces"), F.lit(0)).alias("total_chunks"), error.alias("error"))

    def rejected(df: DataFrame, status: str, reason: str) -> DataFrame:
        return df.select(
            F.coalesce("content_hash", tx.content_hash(F.col("file_name"))).alias("document_id"), "file_name", "file_type", "content_hash",
            F.lit(status).alias("ingestion_status"), F.lit(0).alias("total_chunks"), F.lit(reason).alias("error"))

    documents = done.unionByName(rejected(duplicate, "duplicate", "same content already ingested")).unionByName(
        rejected(f.where("too_large"), "failed", "too large")).unionByName(rejected(empty, "failed", "unreadable"))
    chunks = embed_texts(_explode_pieces(split, F.col("pieces")), "content", embed_fn, model)
    return documents, chunks
