import datetime as dt
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from atril.functions.sentences import Assembler, split_sentences
from atril.operators import ingest as I
from atril.sources import files, tables
from atril.streaming import jobs as J


def test_files(spark):
    d = Path(tempfile.mkdtemp())
    (d / "a.txt").write_bytes("﻿año".encode("utf-8"))
    (d / "b.md").write_bytes("año".encode("latin-1"))
    (d / "c.csv").write_bytes('SEMESTRE I,,\n,,\n"x, y",2 ,\n'.encode("latin-1"))
    got = {Path(r.path).name: r.text for r in files.scan_text_files(spark, str(d)).collect()}
    assert got == {"a.txt": "año", "b.md": "año"}
    assert files.scan_csv_rows(spark, str(d)).first().text == "SEMESTRE I\nx, y | 2"


def test_chunk_table(spark):
    """Deletions hide what was written before them, cost one small file, and compaction changes no reader's rows."""
    path = tempfile.mkdtemp() + "/table"
    docs = spark.createDataFrame([(f"d{i}", "texto " * 20) for i in range(40)], "document_id string, text string")
    tables.write_chunks(I.chunk_prose(docs, 10, 2), path, 4)
    rows = lambda: sorted((r.document_id, r.content) for r in tables.read_chunks(spark, path).collect())
    first, files = rows(), sorted(Path(path, "chunks").rglob("*.parquet"))
    assert tables.compact(spark, path) == 0
    tables.delete_documents(docs.where(F.col("document_id").isin("d1", "d2")), path)
    assert rows() == [r for r in first if r[0] not in ("d1", "d2")]
    assert sorted(Path(path, "chunks").rglob("*.parquet")) == files and len(list(Path(path, "deleted").rglob("part-*.parquet"))) == 1
    tables.replace_documents(path, I.chunk_prose(docs.where("document_id = 'd3'"), 1000, 2), 4)
    tables.delete_documents(docs.where("document_id IN ('d1', 'none')"), path)
    tables.write_chunks(I.chunk_prose(docs.where("document_id = 'd2'"), 1000, 2), path, 4)
    now = rows()
    n = {d: sum(r[0] == d for r in now) for d in ("d1", "d2", "d3", "d4")}
    assert n == {"d1": 0, "d2": 1, "d3": 1, "d4": n["d4"]} and n["d4"] > 1 and len({d for d, _ in now}) == 39
    assert tables.compact(spark, path, 0.99) == 0
    assert tables.compact(spark, path, 0.01) > 0 and rows() == now
    assert tables.compact(spark, path, 0.01) == 0 and rows() == now
    tables.delete_documents(docs, path)
    assert rows() == [] and tables.compact(spark, path) > 0 and rows() == []


def test_sentences():
    assert split_sentences("El Dr. Pérez llega hoy. Vale 3.5 créditos en total! Fin") == [
        "El Dr. Pérez llega hoy.", "Vale 3.5 créditos en total!", "Fin"]
    assert split_sentences("Sí. No. Claro que sí.\nOtra línea") == ["Sí. No. Claro que sí.", "Otra línea"]
    a = Assembler()
    out = []
    for delta in ["<think>", "nada. ", "de esto", "</think>Hola ", "a todos", " ustedes. Y"]:
        out += a.feed(delta)
    assert out == ["Hola a todos ustedes."] and a.flush() == ["Y"]


def _stream(spark, df, parts):
    path = tempfile.mkdtemp()
    for i, p in enumerate(parts):
        df.where(p).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sentence_state_across_batches(spark):
    rows = [(m, i, d, i == 3) for m in (1, 2) for i, d in enumerate(["Hola a todos", " los presentes.", " Bien", " hecho"])]
    df = spark.createDataFrame(rows, "message_id long, seq int, delta string, done boolean")
    out = J.run_to_table(J.stream_sentences(_stream(spark, df, ["seq = 0", "seq IN (1, 2)", "seq = 3"])), "s")
    got = sorted((r.message_id, r.n, r.sentence) for r in out.collect())
    assert got == [(m, n, s) for m in (1, 2) for n, s in enumerate(["Hola a todos los presentes.", "Bien hecho"])]


def test_sentence_tokens_out_of_order(spark):
    """Tokens that come batches before their turn, twice, or after the one that ends the message."""
    words = ["Hola a todos", " los presentes.", " Bien", " hecho, ", "digo 3", ".5 veces. ", "Y el Dr. Gil", " también vino!", " Fin"]
    rows = [(m, i, d, i == len(words) - 1, (i * 5 + m) % 4) for m in range(6) for i, d in enumerate(words)]
    rows += [(m, 0, words[0], False, 3) for m in range(6)]
    df = spark.createDataFrame(rows, "message_id long, seq long, delta string, done boolean, batch int")
    out = J.run_to_table(J.stream_sentences(_stream(spark, df, [f"batch = {b}" for b in range(4)])), "s")
    want = Assembler()
    whole = [s for w in words for s in want.feed(w)] + want.flush()
    assert sorted((r.message_id, r.n, r.sentence) for r in out.collect()) == [(m, n, s) for m in range(6) for n, s in enumerate(whole)]


def test_token_usage_of_each_request(spark):
    """Equal to the batch rule over several micro-batches, with a provider that holds most rows."""
    from atril.operators import rows as R

    t = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 5 else f"p{i % 3}", t + dt.timedelta(milliseconds=997 * (i // 2) + (60_000 if i % 97 == 0 else 0)), 400 * (i % 11), 100, i // 150) for i in range(600)]
    df = spark.createDataFrame(rows, "request_id long, provider string, ts timestamp, prompt_chars long, max_tokens long, b int")
    stream = _stream(spark, df.withColumn("tokens", (F.col("prompt_chars") / 4 + F.col("max_tokens")).cast("long")), [f"b = {b}" for b in range(4)])
    got = {r.request_id: (r.used, r.over) for r in J.run_to_table(J.stream_token_usage(stream, delay_s=120), "u").collect()}
    want = {r.request_id: (r.used, r.over) for r in R.rolling_token_usage(df).collect()}
    assert len(got) > 300 and got == {i: want[i] for i in got}
    newest = max(r[2] for r in rows)
    assert set(got) == {r[0] for r in rows if r[2].replace(second=0, microsecond=0) + dt.timedelta(seconds=60) <= newest - dt.timedelta(seconds=120)}


def test_repeats_and_expiry(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, k, t + dt.timedelta(minutes=m), b) for i, (k, m, b) in enumerate([("a", 0, 0), ("a", 10, 1), ("b", 20, 1), ("a", 90, 2), ("c", 300, 3)])]
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp, b int")
    parts = [f"b = {b}" for b in range(4)]
    assert sorted(r.request_id for r in J.run_to_table(J.stream_repeat_suppress(_stream(spark, df, parts)), "r").collect()) == [0, 2, 3, 4]
    conv = df.select(F.col("request_id").alias("conversation_id"), F.lit(None).cast("int").alias("user_id"), F.col("ts").alias("created_at"), "b")
    gone = J.run_to_table(J.stream_session_expiry(_stream(spark, conv, parts)), "e").collect()
    assert sorted(r.conversation_id for r in gone) == [0, 1, 2, 3]
    assert {r.conversation_id: r.expired_at for r in gone}[0] == t + dt.timedelta(hours=2)


def test_expiry_of_late_guests(spark):
    """Guests more than the TTL behind an earlier batch are reported too, once each, with other users and null times left out."""
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(i, u, None if m is None else t + dt.timedelta(minutes=m), b) for i, (u, m, b) in enumerate([
        (None, 0, 0), (None, 300, 0), (None, -600, 1), (None, 10, 1), (None, 170, 1), (None, 290, 1), (5, -600, 1), (None, None, 1), (None, -900, 2), (None, 301, 2)])]
    conv = spark.createDataFrame(rows, "conversation_id long, user_id int, created_at timestamp, b int")
    gone = J.run_to_table(J.stream_session_expiry(_stream(spark, conv, [f"b = {b}" for b in range(3)])), "late").collect()
    assert sorted((r.conversation_id, r.expired_at) for r in gone) == [(i, rows[i][2] + dt.timedelta(hours=2)) for i in (0, 2, 3, 4, 8)]


def test_files_are_written_into_few_folders(spark):
    """A file for every id, not a folder; rows of one id are lines of its file, a null text is an empty line."""
    rows = [(i, f"línea {i}\nfin") for i in range(600)] + [(7, "otra"), (7, "otra"), (601, None)]
    path = tempfile.mkdtemp() + "/files"
    files.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    assert len(list(Path(path).iterdir())) <= files.FOLDERS
    got = {int(Path(r.path).stem.removeprefix("doc_id=")): r.text for r in files.scan_text_files(spark, path).collect()}
    assert sorted(got.pop(7).splitlines()) == ["fin", "línea 7", "otra", "otra"]
    assert got == {i: f"línea {i}\nfin\n" for i in range(600) if i != 7} | {601: "\n"}


def test_files_are_listed_by_tasks(spark):
    """The files of Spark's own reader, at any depth and under odd names, without a list of them on the driver."""
    d = Path(tempfile.mkdtemp()) / "a b%20ñ"
    for name in ("x.txt", "y.md", ".h.txt", "_h.txt", "_k=1.txt", "a/b/c/d/deep.txt", "a/_no/x.txt", "p=1/_q=2/x.md", "s/ü x%.txt", "empty.txt"):
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(b"" if name == "empty.txt" else name.encode())
    (d / "no").mkdir()
    for pattern in (None, "*.{txt,md}", "?.md", "[xz].*"):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern or "*").load(str(d))
        found = files.scan_files(spark, f"file://{d}" if pattern else str(d), pattern)
        assert found.inputFiles() == []
        assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in own.select("path", "length", "content").collect())
    assert files.scan_files(spark, f"{d}/*").count() == 6 and files.scan_files(spark, f"{d}/y.md").first().length == 4


def test_csv_files_of_many_folders(spark):
    """A row for every file of a tree, dealt out by tasks; a file over the limit has no text."""
    d = Path(tempfile.mkdtemp())
    for i in range(300):
        (d / str(i % 7) / "in" / str(i % 3)).mkdir(parents=True, exist_ok=True)
        (d / str(i % 7) / "in" / str(i % 3) / f"{i}.csv").write_text(f"a, {i},\n,,\n")
    with open(d / "large.csv", "wb") as f:
        f.truncate(files.S.MAX_UPLOAD_BYTES + 1)
    df = files.scan_csv_rows(spark, str(d))
    assert df.inputFiles() == []
    got = {Path(r.path).stem: r.text for r in df.collect()}
    assert got.pop("large") is None and got == {str(i): f"a | {i}" for i in range(300)}


def test_keys_of_a_stream_share_groups(spark, monkeypatch):
    """The number of states and Python calls is that of the groups, not of the keys; results are those of every key alone."""
    monkeypatch.setattr(J, "STATE_GROUPS", 3)
    t = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 11 == 0 else f"k{i % 40}", t + dt.timedelta(minutes=(i * 7) % 200 + 60 * (i // 100)), i // 100) for i in range(300)]
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp, b int")
    parts = [f"b = {b}" for b in range(3)]
    states = []

    def run(stream, name):
        path = tempfile.mkdtemp()
        started = J.start_append(stream, f"{path}/data", f"{path}/checkpoint")
        started.awaitTermination()
        states.extend(s["numRowsTotal"] for p in started.recentProgress for s in p["stateOperators"])
        return spark.read.schema(stream.schema).parquet(f"{path}/data").collect()

    last, want = {}, []
    for b in range(3):
        for i, k, at, _ in sorted((r for r in rows if r[3] == b), key=lambda r: (r[2], r[0])):
            if k not in last or at - last[k] > dt.timedelta(minutes=30):
                last[k] = at
                want.append(i)
    assert sorted(r.request_id for r in run(J.stream_repeat_suppress(_stream(spark, df, parts), delay="5 hours"), "r")) == sorted(want)
    conv = df.select(F.col("request_id").alias("conversation_id"), F.lit(None).cast("int").alias("user_id"), F.col("ts").alias("created_at"), "b")
    newest = max(r[2] for r in rows)
    gone = run(J.stream_session_expiry(_stream(spark, conv, parts)), "e")
    assert sorted(r.conversation_id for r in gone) == sorted(r[0] for r in rows if r[2] + dt.timedelta(hours=2, seconds=1) <= newest)
    tokens = spark.createDataFrame([(m, n, f"Frase {n} de prueba. ", n == 3, (m + n) % 2) for m in range(50) for n in range(4)],
                                   "message_id long, seq long, delta string, done boolean, batch int")
    said = run(J.stream_sentences(_stream(spark, tokens, ["batch = 0", "batch = 1"])), "s")
    assert sorted(tuple(r) for r in said) == [(m, n, f"Frase {n} de prueba.") for m in range(50) for n in range(4)]
    assert states and max(states) <= 3


def test_parts_of_a_stream_are_written_by_many_tasks(spark):
    """One micro-batch for every part, whatever the number of its files."""
    df = spark.range(400).repartition(4)
    path, seen = tempfile.mkdtemp(), []

    def start(stream):
        return stream.writeStream.foreachBatch(lambda batch, n: seen.append((n, sorted(r.id for r in batch.collect())))).option(
            "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    J.run_in_parts(df, F.col("id") % 3, 3, f"{path}/rows", start)
    assert seen == [(k, list(range(k, 400, 3))) for k in range(3)]
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) > 3


def test_stream_ingest_skips_known_content(spark):
    df = spark.createDataFrame([("a.txt", b"uno", 0), ("b.txt", b"uno", 1), ("c.txt", b"dos", 1)], "file_name string, content binary, b int")
    path = tempfile.mkdtemp() + "/out"
    J.stream_ingest(_stream(spark, df, ["b = 0", "b = 1"]), path).awaitTermination()
    got = {r.file_name: r.ingestion_status for r in spark.read.parquet(f"{path}/documents").collect()}
    assert got == {"a.txt": "completed", "b.txt": "duplicate", "c.txt": "completed"}
    assert spark.read.parquet(f"{path}/chunks").count() == 2


def test_every_upload_is_accounted_for(spark):
    from atril.operators.ingest import ingest_documents

    bad_csv = b'a,"b\n' + b"x" * 140_000
    rows = [
        ("a.txt", b"uno", None), ("x.txt", b"uno", None), ("x.txt", b"dos", None), ("x.txt", b"dos", None),
        ("bad.csv", bad_csv, None), ("good.csv", b"h,k\n1,2\n", None), ("big.txt", None, 60 * 1024 * 1024), ("gone.txt", None, None),
    ]
    files = spark.createDataFrame(rows, "file_name string, content binary, length long")
    documents, chunks = ingest_documents(files)
    got = sorted((r.file_name, r.ingestion_status, r.error) for r in documents.collect())
    same = "same content already ingested"
    assert got == [
        ("a.txt", "completed", None), ("bad.csv", "completed", None), ("big.txt", "failed", "too large"), ("gone.txt", "failed", "unreadable"),
        ("good.csv", "completed", None), ("x.txt", "completed", None), ("x.txt", "duplicate", same), ("x.txt", "duplicate", same),
    ]
    assert chunks.where("file_name = 'x.txt'").count() == 1 if "file_name" in chunks.columns else chunks.count() >= 4


def test_no_shared_folder_is_an_error():
    from atril.session import checkpoint_dir

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    import pytest

    assert checkpoint_dir(Session(**{"spark.checkpoint.dir": "s3://b/c", "spark.master": "yarn"})) == "s3://b/c"
    assert checkpoint_dir(Session(**{"spark.master": "local[2]"}))
    for master in ("yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            checkpoint_dir(Session(**{"spark.master": master}))
