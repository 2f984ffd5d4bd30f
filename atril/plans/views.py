"""Logical tables built from the given parquet tables.

One SQL text per view, valid in Spark and in the checking database alike; only the
two spellings in `_DIALECT` differ.  The views are inputs: no operator logic here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from atril.session import ship_package

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    "kb_documents": """
        SELECT d.doc_id AS document_id, d.source AS title, d.source AS program, d.lang AS faculty,
               CASE d.doc_id % 6 WHEN 0 THEN 'pensum' WHEN 1 THEN 'admision' WHEN 2 THEN 'perfil'
                    WHEN 3 THEN 'mision' WHEN 4 THEN 'reglamento' END AS document_type,
               CASE WHEN l.quality = 0 THEN 'failed' WHEN l.toxic = 1 THEN 'processing'
                    ELSE 'completed' END AS ingestion_status,
               d.source || '_' || CAST(d.doc_id AS @STR@) ||
               CASE d.doc_id % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.md'
                    WHEN 3 THEN '.zip' ELSE '' END AS file_name,
               @MIN(d.doc_id * 7)@ AS created_at, d.text AS content
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "kb_chunks": """
        SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, d.text AS content, e.embedding AS embedding
        FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id""",
    "kb_queries": """
        SELECT b.item_id AS query_id, b.text AS query_text, e.embedding AS query_embedding,
               CASE WHEN b.item_id % 4 = 1 THEN 'src' || CAST(b.item_id % 20 AS @STR@) END AS program,
               CASE WHEN b.item_id % 4 = 2 THEN 'fr' WHEN b.item_id % 4 = 3 THEN '' END AS faculty,
               CASE WHEN b.item_id % 8 = 2 THEN 'pensum' END AS document_type
        FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id""",
    "messages": """
        SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, turn AS ord, role,
               CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 1
                    THEN 'Tu pregunta puede aplicar a varios programas. ' || text ELSE text END AS content,
               @MIN(conv_id * 400 + turn * 3)@ AS created_at,
               CASE WHEN role = 'assistant' AND length(text) % 4 <> 0
                    THEN CAST(length(text) * 3 AS BIGINT) END AS response_time_ms,
               CASE WHEN role = 'assistant' AND length(text) % 3 <> 0
                    THEN CAST(length(text) % 3 AS BIGINT) END AS verification_attempts,
               CASE WHEN role = 'assistant' AND length(text) % 3 <> 0
                    THEN length(text) % 5 <> 0 END AS verification_approved
        FROM {conversations}""",
    "chats": """
        SELECT c.conv_id AS conversation_id,
               CASE WHEN c.conv_id % 4 <> 0 THEN c.conv_id % 37 END AS user_id,
               CASE WHEN c.conv_id % 5 = 0 THEN NULL WHEN c.conv_id % 5 = 1 THEN 'Nueva conversación'
                    ELSE 'Chat ' || CAST(c.conv_id AS @STR@) || ' Pensum' END AS title,
               c.conv_id % 6 <> 0 AS is_active,
               @MIN(c.conv_id * 400)@ AS created_at, @MIN(c.conv_id * 400 + 3 * c.last_turn)@ AS updated_at
        FROM (SELECT conv_id, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id) c""",
    "questions": """
        SELECT conv_id * 1000 + turn AS question_id, conv_id, turn,
               CASE (conv_id + turn) % 12
                    WHEN 0 THEN 'Hola, buenas' WHEN 1 THEN '¿Cuáles son las materias del SEMESTRE III de src3? ' || text
                    WHEN 2 THEN 'gracias ' || text WHEN 3 THEN 'Requisitos de admisión: ' || text
                    WHEN 4 THEN 'Qué hago si pierdo una materia ' || text
                    WHEN 5 THEN 'misión y visión de src' || CAST(conv_id % 20 AS @STR@)
                    WHEN 6 THEN 'último semestre ' || text WHEN 7 THEN 'tercer semestre o semestre 5'
                    WHEN 8 THEN 'créditos del semestre ocho, src1 y SRC2' WHEN 9 THEN text
                    WHEN 10 THEN 'DesarrolloSoftware_e_IngSistemas ' || text
                    ELSE 'duración del plan de estudios src' || CAST(conv_id % 7 AS @STR@) || ' ' || text END AS question
        FROM {conversations} WHERE role = 'user'""",
    "retrieved": """
        SELECT x.question_id AS query_id, x.question AS query_text, x.r + 1 AS rank,
               round(CAST(0.62 AS DOUBLE) - CAST(0.04 AS DOUBLE) * x.r - CAST(x.question_id % 7 AS DOUBLE) / 20, 4) AS score,
               d.doc_id AS chunk_id, d.source AS document_title,
               CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE d.source END AS program, d.lang AS faculty, d.text AS content
        FROM (SELECT question_id, question, conv_id * 8 + turn AS doc_id, 0 AS r FROM {questions}
              UNION ALL SELECT question_id, question, conv_id * 8 + turn + 7, 1 FROM {questions}
              UNION ALL SELECT question_id, question, conv_id * 8 + turn + 14, 2 FROM {questions}
              UNION ALL SELECT question_id, question, conv_id * 8 + turn + 21, 3 FROM {questions}
              UNION ALL SELECT question_id, question, conv_id * 8 + turn + 28, 4 FROM {questions}) x
        JOIN {documents} d ON d.doc_id = x.doc_id""",
    "alias_chunks": """
        SELECT d.doc_id AS chunk_id, d.doc_id AS document_id,
               CASE d.doc_id % 10 WHEN 3 THEN d.text || '. PRIMER ciclo de formación : Plan ' || d.source || ' (I a VI)'
                    WHEN 4 THEN 'Primer ciclo de formacion: Redes ' || d.lang || ' — 97' || d.text ELSE d.text END AS content
        FROM {documents} d""",
    "cache_entries": """
        SELECT e.vec_id AS entry_id, e.embedding AS embedding,
               CASE e.vec_id % 3 WHEN 0 THEN 'materias del segundo semestre ' || d.text WHEN 1 THEN 'misión' ELSE d.text END AS question,
               'respuesta ' || d.text AS answer, e.label AS llm_model, d.source AS program,
               CASE WHEN e.vec_id % 4 = 0 THEN '' ELSE 'Facultad Central ' || d.lang END AS faculty,
               CASE WHEN e.vec_id % 5 = 0 THEN 'otro' ELSE d.source END AS other_program,
               'Estatuto_General' AS title, @MIN(e.vec_id * 80)@ AS ts
        FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id""",
    "cache_queries": """
        SELECT b.item_id AS query_id, e.embedding AS query_embedding,
               CASE b.item_id % 5 WHEN 0 THEN 'créditos semestre 2 de src' || CAST(b.item_id % 20 AS @STR@) || ' facultad'
                    WHEN 1 THEN 'tercer semestre facultad src' || CAST(b.item_id % 20 AS @STR@)
                    WHEN 2 THEN '' WHEN 3 THEN b.text ELSE 'facultad central src' || CAST(b.item_id % 20 AS @STR@) END AS query_text
        FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id""",
    "attempts": """
        SELECT conv_id AS turn_id, turn + 1 AS attempt,
               CASE WHEN (conv_id + turn) % 9 = 0 THEN 'No tengo esa información disponible en mi base de conocimientos.' ELSE text END AS draft,
               CASE (conv_id + turn) % 5 WHEN 0 THEN 'falta una fuente' || chr(10) || 'no' WHEN 1 THEN 'NO' WHEN 2 THEN 'bien' || chr(10) || 'SI'
                    WHEN 3 THEN 'dato inventado' || chr(10) || ' otro ' || chr(10) || 'NO.' END AS grader_output
        FROM {conversations}""",
    "gold": """
        SELECT question_id AS query_id,
               CASE question_id % 4 WHEN 0 THEN 'fuera de alcance' WHEN 1 THEN 'depende de carga' ELSE 'dentro de alcance' END AS query_type,
               'src' || CAST((conv_id * 8 + turn) % 20 AS @STR@) AS ref1, 'src' || CAST(turn AS @STR@) || '_plan' AS ref2
        FROM {questions}""",
    "generated": """
        SELECT q.question_id AS query_id, 'p' || CAST(q.conv_id % 3 AS @STR@) AS provider, 'm1' AS model,
               CASE WHEN q.question_id % 11 <> 0 THEN q.question || CASE q.question_id % 7 WHEN 0 THEN ' Tu pregunta puede aplicar a varios'
                    WHEN 1 THEN ' No tengo esa información disponible en mi base de conocimientos' ELSE '' END END AS answer,
               CAST(length(q.question) AS BIGINT) AS generation_ms, CASE WHEN q.question_id % 11 = 0 THEN 'timeout' END AS error,
               CASE q.question_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS judged
        FROM {questions} q""",
    "grid_cells": """
        WITH g AS (SELECT l_orderkey AS file, l_partkey, l_quantity, l_returnflag, l_discount, l_suppkey, CAST(1 + row_number() OVER (
                     PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS row FROM {lineitem}),
             o AS (SELECT DISTINCT l_orderkey AS file FROM {lineitem})
        SELECT file, 'malla' AS sheet, row, CAST(1 AS BIGINT) AS col, 'AREA ' || l_returnflag AS value, 'text' AS kind FROM g WHERE row % 2 = 0
        UNION ALL SELECT file, 'malla', row, 2, CASE WHEN row = 3 THEN 'COMPONENTE' ELSE CAST(row AS @STR@) END, CASE WHEN row = 3 THEN 'text' ELSE 'number' END FROM g
        UNION ALL SELECT file, 'malla', row, 3, 'C' || CAST(l_partkey AS @STR@), 'text' FROM g WHERE l_suppkey % 3 <> 0
        UNION ALL SELECT file, 'malla', row, 4, CAST(CAST(l_quantity AS BIGINT) AS @STR@), 'number' FROM g
        UNION ALL SELECT file, 'malla', row, 5, CASE WHEN l_suppkey % 2 = 0 THEN 'T' ELSE '' END, 'text' FROM g
        UNION ALL SELECT file, 'malla', row, 6, CAST(l_suppkey % 5 + 1 AS @STR@), 'number' FROM g
        UNION ALL SELECT file, 'malla', row, 7, CASE WHEN l_discount > 0.05 THEN 'CR' ELSE 'HP' END, 'text' FROM g
        UNION ALL SELECT file, 'malla', row, 8, CAST(l_partkey % 4 AS @STR@), 'number' FROM g
        UNION ALL SELECT file, 'malla', row, 9, CASE WHEN row = 4 THEN '0.5' ELSE '7' END, 'number' FROM g
        UNION ALL SELECT file, 'malla', 1, 3, 'I', 'text' FROM o
        UNION ALL SELECT file, 'malla', 1, 7, 'II', 'text' FROM o
        UNION ALL SELECT file, 'malla', 100, 2, CASE WHEN file % 2 = 0 THEN 'Total créditos' ELSE 'Requisitos de grado' END, 'text' FROM o
        UNION ALL SELECT file, 'malla', 100, 4, '12', 'number' FROM o
        UNION ALL SELECT file, 'malla', 101, 1, 'Convenciones', 'text' FROM o
        UNION ALL SELECT file, 'malla', 101, 3, 'Ética', 'text' FROM o
        UNION ALL SELECT file, 'malla', 102, 4, 'Electiva', 'text' FROM o
        UNION ALL SELECT file, 'malla', 102, 8, '5', 'number' FROM o""",
    "page_spans": """
        SELECT o_custkey AS file, o_orderkey % 3 AS page, o_orderkey AS seq, o_totalprice / 1000 AS x,
               CAST(o_custkey % 7 + o_orderkey % 29 AS DOUBLE) AS y,
               CASE o_orderkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN '•' WHEN 2 THEN 'ñ' ELSE ' ' || o_orderpriority END AS text
        FROM {orders}""",
    "members": """
        SELECT c_custkey AS user_id,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'admin' WHEN 'BUILDING' THEN 'guest' ELSE 'user' END AS role,
               c_name AS display_name,
               lower(replace(c_name, '#', '@')) || CASE WHEN c_acctbal > 0 THEN '.org' ELSE '' END AS email
        FROM {customer}""",
    "runs": """
        SELECT o_orderkey AS run_id, o_orderdate AS started_at,
               CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status
        FROM {orders}""",
    "requests": """
        SELECT event_id AS request_id, event_type AS provider, ts, CAST(floor(value * 200) AS BIGINT) AS prompt_chars,
               CAST(user_id % 5 * 100 AS BIGINT) AS max_tokens, user_id FROM {events}""",
    "faculties": """
        SELECT n_nationkey AS faculty_id, n_name AS faculty FROM {nation}""",
    "programs": """
        SELECT s_suppkey AS program_id, s_name AS program,
               CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS faculty_id FROM {supplier}""",
    "answers": """
        SELECT conv_id * 1000 + turn AS answer_id, conv_id * 8 + turn AS doc_id,
               text || CASE turn % 5 WHEN 0 THEN ' [1] y [3], [1]' WHEN 1 THEN ' [' || CAST(conv_id % 14 AS @STR@) || ']'
                    WHEN 2 THEN '. No tengo esa información disponible en mi base de conocimientos [1]'
                    WHEN 3 THEN ' Tu pregunta puede aplicar a varios programas' ELSE ' [123] [2]' END AS answer,
               conv_id % 6 AS n_sources
        FROM {conversations}""",
}

_DIALECT = {
    "spark": {"STR": "STRING", "MIN": "timestampadd(MINUTE, CAST({0} AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"},
    "duckdb": {"STR": "VARCHAR", "MIN": "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({0} AS INTEGER)))"},
}


def render(sql: str, dialect: str) -> str:
    words = _DIALECT[dialect]
    sql = sql.replace("@STR@", words["STR"])
    return re.sub(r"@MIN\((.*?)\)@", lambda m: words["MIN"].format(m.group(1)), sql)


class Inputs:
    """Tables and logical views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self._table(name)
            else:
                sql = render(VIEWS[name], "spark")
                used = {t: self[t] for t in re.findall(r"\{(\w+)\}", sql)}
                self._cache[name] = self.spark.sql(sql, **used)
        return self._cache[name]

    def _table(self, name: str) -> DataFrame:
        """A stored table.  Where `documents` is a single row group, which one task would read and process alone,
        the setting `spark.atril.spread` names the number of tasks it is dealt to; unset, nothing is shuffled."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        spread = self.spark.conf.get("spark.atril.spread", "")
        return df.repartition(int(spread), "doc_id") if name == "documents" and spread else df

    @property
    def now(self):
        """The newest event: time-dependent operators take `now` as a parameter."""
        from pyspark.sql import functions as F

        return self["events"].agg(F.max("ts").alias("now")).first().now


CLOCK = "clock AS (SELECT max(ts) AS now FROM events)"


def oracle(sql: str) -> str:
    """`sql` for the checking database with the views it names put in front.

    `sql` is either a SELECT or a list of CTEs followed by a SELECT.
    """
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(VIEWS[name])
                used.append(name)

    need(sql)
    ctes = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', render(VIEWS[n], 'duckdb'))})" for n in used]
    if re.search(r"\bclock\b", sql):
        ctes.append(CLOCK)
    body = sql.strip()
    if not ctes:
        return body if re.match(r"(?i)(select|with)\b", body) else "WITH " + body
    glue = " " if re.match(r"(?i)select\b", body) else ", "
    return "WITH " + ", ".join(ctes) + glue + body
