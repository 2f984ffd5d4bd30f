import random

from hypothesis import given, settings
from hypothesis import strategies as st

from atril.functions.splitter import prose_spans, split_prose, split_rows
from atril.operators import ingest as I


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccccccccc", " ", "  ", ". ", "\n", "\n\n", "\n\n\n", "x" * 25]), max_size=60),
       st.integers(5, 30), st.integers(0, 4))
def test_prose_invariants(parts, limit, overlap):
    text = "".join(parts)
    spans = prose_spans(text, limit, overlap)
    covered = {i for a, b in spans for i in range(a, b)}
    assert {i for i, c in enumerate(text) if not c.isspace() and c != "."} <= covered
    assert all(a <= c and b <= d for (a, b), (c, d) in zip(spans, spans[1:]))
    assert len(text) > limit or len(spans) <= 1


def test_prose_golden():
    def cut(text, limit, overlap):
        return [text[a:b] for a, b in prose_spans(text, limit, overlap)]

    assert cut("aa bb cc dd", 5, 0) == ["aa bb", "cc dd"]
    assert cut("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"]
    assert cut("abcdefghij", 4, 1) == ["abcd", "defg", "ghij", "j"]
    assert cut("uno. dos. tres", 8, 0) == ["uno. dos", "tres"]


def test_prose_basics():
    assert split_prose("corto", 100, 20) == [(0, "corto")]
    assert split_prose("   \n ", 100, 20) == []
    pieces = split_prose("Una frase de prueba. " * 200, 50, 15)
    assert len(pieces) > 5 and all(p for _, p in pieces)
    assert pieces[1][1][:10] in pieces[0][1]


def test_rows_keep_header_and_rows_whole():
    rows = [f"C{i} | materia {i} | {i % 4}" for i in range(60)]
    chunks = [c for _, c in split_rows("=== HOJA: Plan ===\n" + "\n".join(rows), 30, 5)]
    assert len(chunks) > 1 and all(c.startswith("=== HOJA: Plan ===\n") for c in chunks)
    for c in chunks:
        assert all(line in rows for line in c.split("\n")[1:])
    assert {line for c in chunks for line in c.split("\n")[1:]} == set(rows)


def test_rows_sections_and_subheaders():
    text = "=== HOJA: A ===\nSEMESTRE I\na | 1\nb | 2\nSEMESTRE II\nc | 3\n=== DIAPOSITIVA 2 ===\nsuelto"
    assert [c for _, c in split_rows(text, 100, 10)] == [
        "=== HOJA: A ===\nSEMESTRE I\na | 1\nb | 2", "=== HOJA: A ===\nSEMESTRE II\nc | 3", "=== DIAPOSITIVA 2 ===\nsuelto"]


def test_rows_flat_list_and_empty_subheader():
    flat = "\n".join(f"Electiva {i}" for i in range(25))
    assert len(split_rows("=== HOJA: E ===\n" + flat, 200, 10)) == 1
    assert [c for _, c in split_rows("antes\n=== HOJA: A ===\nx | y\nT1\nz | w", 100, 10)] == [
        "antes", "=== HOJA: A ===\nx | y", "=== HOJA: A ===\nT1\nz | w"]


def test_rows_overlap_repeats_neighbour():
    chunks = [c.split("\n") for _, c in split_rows("\n".join(f"r{i:02d} | v" for i in range(40)), 20, 5)]
    assert all(b[0] in a for a, b in zip(chunks, chunks[1:]))


def test_chunks_and_udtf(spark):
    from atril.functions.splitter import register_chunk_text

    docs = spark.createDataFrame([("d", "uno dos. " * 100), ("e", " "), ("f", None)], "document_id string, text string")
    rows = I.chunk_prose(docs, 50, 10).orderBy("chunk_index").collect()
    assert {r.document_id for r in rows} == {"d"} and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.token_count == len(r.content) // 4 for r in rows)
    register_chunk_text(spark)
    assert spark.sql("SELECT count(*) FROM chunk_text('hola', 10, 2)").first()[0] == 1


def test_summary_validation(spark):
    words = " ".join(random.Random(1).sample([f"palabra{i}" for i in range(60)], 40))
    raw = "Cálculo Diferencial y Física Mecánica " + words
    docs = spark.createDataFrame([
        ("a", raw, "SEMESTRE 1: Calculo diferencial, Arte Marciano\nruido\nSEMESTRE 2: Fisica Mecanica"),
        ("b", raw, "SEMESTRE 1: Hechizos Arcanos"), ("c", "poco texto", "SEMESTRE 1: Lo Que Sea"), ("d", raw, "charla")],
        "document_id string, text string, summary string")
    got = {r.document_id: r.summary for r in I.validate_summary(docs).collect()}
    assert got == {"a": "SEMESTRE 1: Calculo diferencial\nSEMESTRE 2: Fisica Mecanica", "b": "", "c": "SEMESTRE 1: Lo Que Sea", "d": ""}


def test_embed_once_and_hot_text(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, "caliente" if i % 3 == 0 else f"texto {i}") for i in range(900)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {r.id: r.embedding for r in I.embed_texts(df, embed_fn=embed).collect()}
    assert len(got) == 901 and got[900] is None and got[0] == [8.0, 1.0] and got[1] == [7.0, 1.0]
    assert seen.value == 601


def test_ingest(spark):
    files = spark.createDataFrame([
        ("a.txt", "Hola  mundo".encode(), None), ("b.txt", "Hola  mundo".encode(), None), ("c.csv", "x,y\n,\n1,2\n".encode(), None),
        ("d.pdf", b"%PDF", None), ("e.docx", b"PK", "texto leído"), ("f.txt", "año".encode("latin-1"), None)],
        "file_name string, content binary, decoded string")
    docs, chunks = I.ingest_documents(files)
    status = {r.file_name: r.ingestion_status for r in docs.collect()}
    assert status == {"a.txt": "completed", "b.txt": "duplicate", "c.csv": "completed", "d.pdf": "failed", "e.docx": "completed", "f.txt": "completed"}
    assert sorted(r.content for r in chunks.collect()) == ["Hola mundo", "año", "texto leído", "x | y\n1 | 2"]


def test_results_of_long_texts_are_held_in_slices():
    """A worker's memory is that of a stretch of the batch, not of all its rows; every row comes back, in order."""
    import pandas as pd

    from atril.functions import splitter as sp

    texts = pd.Series(["fila | a\n" * (60_000 if i % 3 else 1) if i % 7 else None for i in range(30)])
    made = list(sp.splitter("rows", 100, 10).func(iter([texts, texts.iloc[:0]])))
    assert len(made) > 4 and all(len(m) == 1 or sum(len(t) for t in texts[m.index] if t is not None) <= sp.SLICE_CHARS for m in made if len(m))
    whole = pd.concat(made)
    assert whole.index.tolist() == list(range(30))
    assert [None if p is None else [x["content"] for x in p] for p in whole] == [None if t is None else [c for _, c in sp.split_rows(t, 100, 10)] for t in texts]
