"""Registered ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.functions.vector import norm
from atril.functions.splitter import register_chunk_text
from atril.operators import ingest as I
from atril.operators.analytics import chunk_stats
from atril.plans.registry import query
from atril.plans.text_queries import fold_sql, strip_sql
from atril.session import scratch_path
from atril.sources import files, tables

C = F.col


@query("decode_text", "SELECT doc_id, text AS decoded FROM documents")
def _(v):
    """The decoding step over every document: UTF-8 with a BOM, plain UTF-8 and, where
    Latin-1 can hold the text and its bytes are not valid UTF-8, Latin-1."""
    latin = F.encode(C("text"), "ISO-8859-1")
    fits = C("text").rlike("\\A[\\x{0}-\\x{FF}]*\\z")
    data = (F.when(C("doc_id") % 3 == 0, F.encode(F.concat(F.lit("\ufeff"), C("text")), "UTF-8"))
            .when((C("doc_id") % 3 == 1) & fits, latin).otherwise(F.encode("text", "UTF-8")))
    return v["documents"].select("doc_id", files.decode_text(data).alias("decoded"))


def as_files(v, text):
    """Folder with one text file for every document, each ending in a line break."""
    path = scratch_path(v.spark, "files")
    files.write_files(v["documents"].select("doc_id", text.alias("text")), path)
    return path


def doc_of(df, column):
    return df.select(F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id"), column)


@query("scan_text_files", "SELECT doc_id, text || chr(10) AS decoded FROM documents")
def _(v):
    """Every document written to a file of its own, a third of them with a BOM, and read back."""
    path = as_files(v, F.when(C("doc_id") % 3 == 0, F.concat(F.lit("\ufeff"), C("text"))).otherwise(C("text")))
    return doc_of(files.scan_text_files(v.spark, path, "*.txt"), C("text").alias("decoded"))


CSV_SQL = r"""list_filter(list_transform(string_split(replace(text, ' | ', ' , '), chr(10)),
      lambda l: trim(array_to_string(list_transform(string_split(l, ','), lambda c: trim(c)), ' | '), ' |')), lambda l: l <> '')"""


@query("scan_csv_rows", f"SELECT doc_id, array_to_string({CSV_SQL}, chr(10)) AS rows_text FROM documents")
def _(v):
    """Every document as a comma-separated file."""
    path = as_files(v, F.replace(C("text"), F.lit(" | "), F.lit(" , ")))
    return doc_of(files.scan_csv_rows(v.spark, path, "*.txt"), C("text").alias("rows_text"))


def prose(v):
    return v["documents"].select(C("doc_id").alias("document_id"), "text")


@query("chunk_prose")
def _(v):
    return I.chunk_prose(prose(v)).withColumn("metadata", C("metadata")["chunk_index"])


@query("chunk_prose_stats", """SELECT doc_id AS document_id, true AS all_substrings, true AS consecutive, true AS covers_start
    FROM documents WHERE regexp_matches(text, '\\S')""")
def _(v):
    """Invariants of the splitter on every document: each chunk occurs in its document, the
    chunks are numbered without gaps, and the first one begins where the text begins."""
    d = prose(v).withColumn("stripped", F.regexp_replace("text", "(?U)\\A\\s+", ""))
    c = I.chunk_prose(prose(v)).join(d, "document_id")
    at = F.instr(C("text"), C("content"))
    return c.withColumn("at", at).groupBy("document_id").agg(
        F.bool_and(C("at") > 0).alias("all_substrings"),
        (F.max("chunk_index") + 1 == F.countDistinct("chunk_index")).alias("consecutive"),
        F.bool_or((C("chunk_index") == 0) & F.startswith(C("stripped"), C("content"))).alias("covers_start"))


@query("chunk_prose_short", f"""SELECT doc_id AS document_id, CAST(0 AS BIGINT) AS chunk_index, {strip_sql('text')} AS content,
    CAST(length({strip_sql('text')}) // 4 AS BIGINT) AS token_count FROM documents WHERE length(text) <= 2048 AND regexp_matches(text, '\\S')""")
def _(v):
    """Documents within the limit stay whole; the splitter runs over all documents."""
    d = prose(v).select("document_id", F.length("text").alias("n"))
    c = I.chunk_prose(prose(v)).join(d, "document_id").where(C("n") <= 2048)
    return c.select("document_id", C("chunk_index").cast("long").alias("chunk_index"), "content", C("token_count").cast("long").alias("token_count"))


def tabular(v):
    return v["documents"].select(C("doc_id").alias("document_id"), F.concat(
        F.lit("=== HOJA: "), C("source"), F.lit(" ===\nSEMESTRE I\na | b\n"), C("text"),
        F.lit("\n=== DIAPOSITIVA 2 ===\n"), C("text")).alias("text"))


@query("chunk_rows")
def _(v):
    return I.chunk_rows(tabular(v)).withColumn("metadata", C("metadata")["chunk_index"])


@query("chunk_rows_uniform", """SELECT l_orderkey AS document_id, string_agg(r, chr(10) ORDER BY l_linenumber, r) AS content FROM
    (SELECT l_orderkey, l_linenumber, l_partkey || ' | ' || l_returnflag AS r FROM lineitem) GROUP BY 1""")
def _(v):
    """Orders as little sheets: rows that fit one chunk come back whole and in order."""
    line = F.struct("l_linenumber", F.concat(C("l_partkey").cast("string"), F.lit(" | "), C("l_returnflag")).alias("r"))
    docs = v["lineitem"].groupBy(C("l_orderkey").alias("document_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["r"]), "\n").alias("text"))
    return I.chunk_rows(docs).select("document_id", "content")


SUMMARY = """docs AS (SELECT doc_id, text, 'Semestre 1: ' || regexp_extract(text, '[A-Za-z]{4,}') || ', Inventada Total' || chr(10) || 'charla' || chr(10)
      || 'SEMESTRE 2 : Nada Xyzzyqq,' || chr(10) || 'SEMESTRE 3:' || regexp_extract(text, '[A-Za-z]{4,}') || ' xyzzyqq' AS summary FROM documents)"""


@query("validate_summary", SUMMARY + f""", k AS (SELECT *, list_distinct(regexp_extract_all({fold_sql('text')}, '[a-z0-9]+')) AS known FROM docs),
    ln AS (SELECT doc_id, known, unnest(string_split(summary, chr(10))) AS line, unnest(range(len(string_split(summary, chr(10))))) AS n FROM k),
    f AS (SELECT doc_id, n, known, regexp_extract({strip_sql('line')}, '(?i)^(SEMESTRE\\s+\\d+)\\s*:\\s*(.+)$', 1) AS label,
          string_split(regexp_extract({strip_sql('line')}, '(?i)^(SEMESTRE\\s+\\d+)\\s*:\\s*(.+)$', 2), ',') AS courses FROM ln),
    c AS (SELECT doc_id, n, label, list_filter(list_transform(courses, lambda c: trim(c)), lambda c: c <> ''
            AND len(list_filter(regexp_extract_all({fold_sql('c')}, '[a-z0-9]+'), lambda w: length(w) >= 4)) > 0
            AND len(list_filter(regexp_extract_all({fold_sql('c')}, '[a-z0-9]+'), lambda w: length(w) >= 4 AND list_contains(known, w)))
                >= ceil(len(list_filter(regexp_extract_all({fold_sql('c')}, '[a-z0-9]+'), lambda w: length(w) >= 4)) / 2.0)) AS kept FROM f WHERE label <> ''),
    j AS (SELECT doc_id, string_agg(label || ': ' || array_to_string(kept, ', '), chr(10) ORDER BY n) AS s FROM c WHERE len(kept) > 0 GROUP BY 1)
    SELECT k.doc_id AS document_id, CASE WHEN len(known) < 20 THEN k.summary ELSE coalesce(j.s, '') END AS summary FROM k LEFT JOIN j USING (doc_id)""")
def _(v):
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    summary = F.concat(F.lit("Semestre 1: "), word, F.lit(", Inventada Total\ncharla\nSEMESTRE 2 : Nada Xyzzyqq,\nSEMESTRE 3:"), word, F.lit(" xyzzyqq"))
    d = v["documents"].select(C("doc_id").alias("document_id"), "text", summary.alias("summary"))
    return I.validate_summary(d).select("document_id", "summary")


@query("build_document_text", """SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN '=== RESUMEN DE MATERIAS POR SEMESTRE ===' || chr(10) || source || chr(10)
    || '=== FIN DEL RESUMEN ===' || chr(10) || chr(10) || text ELSE text END AS text FROM documents""")
def _(v):
    kind = F.when(C("doc_id") % 3 == 0, "docx").when(C("doc_id") % 3 == 1, "xlsx").otherwise("txt")
    d = v["documents"].select(C("doc_id").alias("document_id"), "text", C("source").alias("summary"), kind.alias("file_type"))
    return I.build_document_text(d).select("document_id", "text")


WORD_VECTOR = r"""w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS word FROM documents),
    h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) AS h FROM w),
    s AS (SELECT doc_id, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2),
    n AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM s GROUP BY 1)"""


@query("embed_texts", WORD_VECTOR + """, m AS (SELECT doc_id, map_from_entries(list((slot, v))) AS m FROM s GROUP BY 1)
    SELECT d.doc_id, array_to_string(list_transform(range(64), lambda i: CAST(coalesce(sign(m.m[i]), 0) AS BIGINT)), ',') AS signs,
      CASE WHEN n.len > 0 THEN 1.0::DOUBLE ELSE 0 END AS length FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""")
def _(v):
    e = I.embed_texts(v["documents"].select("doc_id", "text"), "text")
    signs = F.array_join(F.transform("embedding", lambda x: F.signum(x).cast("long").cast("string")), ",")
    return e.select("doc_id", signs.alias("signs"), F.round(norm(C("embedding")), 4).alias("length"))


def uploads(v):
    ext = F.when(C("doc_id") % 5 == 0, ".csv").when(C("doc_id") % 5 == 1, ".docx").otherwise(".txt")
    return v["documents"].select(
        F.concat(F.lpad(C("doc_id").cast("string"), 12, "0"), ext).alias("file_name"), F.encode("text", "UTF-8").alias("content"),
        F.when(C("doc_id") % 5 == 1, C("text")).alias("decoded"))


@query("ingest_documents", """SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || CASE doc_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.docx' ELSE '.txt' END AS file_name,
    CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'docx' ELSE 'txt' END AS file_type, sha256(text) AS content_hash,
    CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'completed' ELSE 'duplicate' END AS ingestion_status FROM documents""")
def _(v):
    documents, _chunks = I.ingest_documents(uploads(v))
    return documents.select("file_name", "file_type", "content_hash", "ingestion_status")


@query("ingest_chunks")
def _(v):
    _, chunks = I.ingest_documents(uploads(v))
    return chunks.select("document_id", "chunk_index", "content", "token_count", F.size("embedding").alias("dim"))


@query("write_chunks", """SELECT d.doc_id AS document_id, d.doc_id AS chunk_id, CAST(length(d.text) AS BIGINT) AS chars, md5(d.text) AS digest,
    CASE WHEN d.doc_id % 10 = 3 AND p.doc_id IS NOT NULL THEN 'again' ELSE 'first' END AS written
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) p ON p.doc_id = d.doc_id
    WHERE p.doc_id IS NULL OR d.doc_id % 10 = 3""")
def _(v):
    """Write all chunks, delete the documents labelled poor, write every tenth of them anew, compact, read back."""
    path = scratch_path(v.spark, "stored")
    chunks = v["kb_chunks"].select("chunk_id", "document_id", "content")
    tables.write_chunks(chunks.withColumn("written_as", F.lit("first")), path, 8)
    poor = v["labels"].where(C("quality") == 0).select(C("doc_id").alias("document_id"))
    tables.delete_documents(poor, path)
    tables.write_chunks(chunks.where("document_id % 10 = 3").join(poor, "document_id", "left_semi").withColumn("written_as", F.lit("again")), path, 8)
    tables.compact(v.spark, path, 0.1)
    return tables.read_chunks(v.spark, path).select(
        "document_id", "chunk_id", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"), C("written_as").alias("written"))


@query("document_status", """SELECT d.doc_id AS document_id, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END AS ingestion_status,
    CAST(coalesce(e.n, 0) AS BIGINT) AS total_chunks FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    LEFT JOIN (SELECT vec_id, count(*) AS n FROM embeddings GROUP BY 1) e ON e.vec_id = d.doc_id""")
def _(v):
    docs = v["documents"].join(v["labels"], "doc_id", "left").select(
        C("doc_id").alias("document_id"), F.when(C("toxic") == 1, "bad").alias("error"))
    return tables.document_status(docs, v["embeddings"].select(C("vec_id").alias("document_id"))).select(
        "document_id", "ingestion_status", "total_chunks")


@query("eval_results_sink", "SELECT query_id, query_type, ref1, ref2 FROM gold")
def _(v):
    path = scratch_path(v.spark, "stored")
    tables.write_eval_results(v["gold"].select("query_id", "query_type", F.array("ref1", "ref2").alias("expected")), path)
    back = v.spark.read.schema("query_id long, query_type string, expected array<string>").json(path)
    return back.select("query_id", "query_type", C("expected")[0].alias("ref1"), C("expected")[1].alias("ref2"))


@query("chunk_text_udtf")
def _(v):
    register_chunk_text(v.spark)
    return v.spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_text(d.text, 100, 20) c", docs=v["documents"])
