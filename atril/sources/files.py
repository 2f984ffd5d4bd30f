"""File sources."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atril import settings as S
from atril.functions.splitter import slices
from atril.operators import scale


#: Folders that written files are dealt to: enough to be listed by tasks, few enough to be made quickly.
FOLDERS = 256


def write_files(texts: DataFrame, path: str) -> None:
    """One file `doc_id=<id>.txt` for every doc_id of texts(doc_id, text), each text ending in a line break; rows of one id
    are lines of one file.

    Tasks write through pyarrow's file systems to the shared folder. A partitioned write would make a folder for each id and
    have the driver rename all of them one after the other.  Texts are written where they are read; only those whose id may
    occur again are brought together before.
    """
    uri = path if "://" in path or path.startswith("/") else f"/{path}"
    store, root = fs.FileSystem.from_uri(uri)
    for folder in range(FOLDERS):
        store.create_dir(f"{root}/{folder}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        at, out = None, None
        for batch in batches:
            for doc_id, folder, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or doc_id != at:
                    if out is not None:
                        out.close()
                    at, out = doc_id, store.open_output_stream(f"{root}/{folder}/doc_id={doc_id}.txt")
                out.write((text or "").encode("utf-8", "surrogatepass") + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64())})

    def written(rows: DataFrame) -> None:
        rows.mapInArrow(write, "doc_id long").write.format("noop").mode("overwrite").save()

    folder = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)).alias("folder")
    dealt = texts.select(F.col("doc_id").cast("long").alias("doc_id"), folder, "text")
    again = dealt.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    written(scale.surely_not_in(dealt, "doc_id", again))
    written(scale.maybe_in(dealt, "doc_id", again).repartition("folder").sortWithinPartitions("folder", "doc_id"))


def decode_text(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8 (a leading BOM is dropped), else Latin-1."""
    utf8 = content.cast("string")
    return F.when(
        F.is_valid_utf8(utf8), F.regexp_replace(utf8, "\\A\\x{FEFF}", "")
    ).otherwise(F.decode(content, "ISO-8859-1"))


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith("_") and "=" not in name and not (folder and name.startswith(("_metadata", "_common_metadata")))
            or name.startswith(".") or name.endswith("._COPYING_"))


def _reached(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str, str] | None:
    """The store of a folder, its path there and its name as Spark writes it; None for what only Spark's readers open:
    patterns, single files and stores unknown to pyarrow."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(folder)
    uri = where.toUri()
    try:
        if uri.getScheme() == "file":
            store, root = fs.LocalFileSystem(), uri.getPath()
        else:
            store, root = fs.FileSystem.from_uri(uri.toString())
        if store.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, ImportError, NotImplementedError):
        return None
    return store, root.rstrip("/"), where.toString().rstrip("/")


#: Bytes of files that a task holds at once, besides one file.
HELD_BYTES = 4 * 1024 * 1024


def scan_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content bytes, length); files over the upload limit carry no content.

    Folders are listed by tasks, two levels of them one after the other and deeper ones where they are met, and the files dealt
    out by their names: the driver knows of no file.  What pyarrow can't reach is listed by Spark's reader, on the driver.
    """
    reached = _reached(spark, path)
    if reached is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        df = reader.load(path)
        return df.select("path", "length", F.when(F.col("length") <= S.MAX_UPLOAD_BYTES, F.col("content")).alias("content"))

    store, root, shown = reached
    wanted = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern() if pattern else ".*", re.DOTALL)
    held, limit = HELD_BYTES, S.MAX_UPLOAD_BYTES

    def entries(folder: str) -> Iterator[tuple[str, int | None]]:
        """What stands in a folder; a length for files, none for folders.  Empty files are passed over, as Spark's readers do."""
        for info in store.get_file_info(fs.FileSelector(folder)):
            name = info.base_name
            if info.type == fs.FileType.Directory and not _hidden(name, True):
                yield info.path, None
            elif info.type == fs.FileType.File and info.size and not _hidden(name, False) and wanted.fullmatch(name):
                yield info.path, info.size

    def one_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = entries(name) if length is None else iter([(name, length)])
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64()), strict=True)], ["name", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "length", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                open_ = [iter([row])]
                while open_:
                    if (entry := next(open_[-1], None)) is None:
                        open_.pop()
                        continue
                    name, length = entry
                    if length is None:
                        open_.append(entries(name))
                        continue
                    content = None
                    if length <= limit:
                        with store.open_input_stream(name) as f:
                            content = f.read()
                    rows.append((shown + name[len(root):], length, content))
                    size += len(content or b"")
                    if size >= held or len(rows) >= 1000:
                        yield made()
                        rows, size = [], 0
        yield made()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(0, 1, 1, 1).select(F.lit(root or "/").alias("name"), F.lit(None).cast("long").alias("length"))
    for _ in range(2):
        top = top.mapInArrow(one_level, "name string, length long").repartition(tasks, "name")
    return top.mapInArrow(read, "path string, length long, content binary")


def scan_text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """(path, text)."""
    return scan_files(spark, path, pattern).select("path", decode_text(F.col("content")).alias("text"))


@F.pandas_udf(T.StringType())
def csv_rows_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CSV text to pipe-joined rows; rows without a non-empty cell are dropped.  Text that is no
    readable CSV (an unclosed quote, a NUL) is returned as it is."""

    def one(text):
        if text is None:
            return None
        try:
            rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text, newline=""))]
        except csv.Error:
            return text
        return "\n".join(" | ".join(row).strip(" |") for row in rows if any(row))

    for texts in slices(batches):
        yield texts.map(one)


def scan_csv_rows(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, text)."""
    return scan_files(spark, path, pattern).select("path", csv_rows_text(decode_text(F.col("content"))).alias("text"))
