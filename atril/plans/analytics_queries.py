"""Registered usage-figure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.operators import analytics as A
from atril.plans.registry import query

C = F.col
TIMED = "timed AS (SELECT event_id AS conversation_id, user_id, ts AS created_at FROM events)"


def timed(v):
    return v["events"].select(C("event_id").alias("conversation_id"), "user_id", C("ts").alias("created_at"))


@query("usage_totals", """SELECT (SELECT CAST(count(*) AS BIGINT) FROM chats WHERE is_active) AS total_conversations,
    (SELECT CAST(count(*) AS BIGINT) FROM messages) AS total_messages,
    (SELECT CAST(count(DISTINCT user_id) AS BIGINT) FROM chats) AS unique_users,
    (SELECT round(avg(response_time_ms) / 1000, 1) FROM messages WHERE role = 'assistant') AS avg_response_time_s""")
def _(v):
    return A.usage_totals(v["chats"], v["messages"])


@query("resolution_rate", """SELECT CAST(r AS BIGINT) AS with_reply, CAST(a AS BIGINT) AS active, CASE WHEN a = 0 THEN 0 ELSE round(r::DOUBLE / a * 100, 1) END AS resolution_rate
    FROM (SELECT (SELECT count(DISTINCT conversation_id) FROM messages WHERE role = 'assistant') AS r, (SELECT count(*) FROM chats WHERE is_active) AS a)""")
def _(v):
    return A.resolution_rate(v["chats"], v["messages"])


@query("week_over_week", TIMED + """, n AS (SELECT CAST(count(*) FILTER (WHERE created_at >= now - INTERVAL 7 DAY) AS BIGINT) AS this_week,
      CAST(count(*) FILTER (WHERE created_at < now - INTERVAL 7 DAY AND created_at >= now - INTERVAL 14 DAY) AS BIGINT) AS last_week FROM timed, clock)
    SELECT this_week, last_week, CAST(floor((this_week - last_week)::DOUBLE / last_week * 100 + 0.5) AS BIGINT) AS delta_pct,
      CASE WHEN this_week = 0 AND last_week = 0 THEN 'Sin datos' WHEN last_week = 0 THEN 'Nueva actividad' ELSE
        CASE WHEN floor((this_week - last_week)::DOUBLE / last_week * 100 + 0.5) >= 0 THEN '+' ELSE '' END ||
        CAST(CAST(floor((this_week - last_week)::DOUBLE / last_week * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS label FROM n""")
def _(v):
    return A.week_over_week(timed(v), v.now)


@query("conversations_per_day", TIMED + """, days AS (SELECT CAST(CAST(now AS DATE) - CAST(i AS INTEGER) AS DATE) AS date FROM clock, range(7) t(i))
    SELECT d.date, substr('LMXJVSD', isodow(d.date), 1) AS label, CAST(count(t.created_at) AS BIGINT) AS count
    FROM days d LEFT JOIN (SELECT created_at FROM timed, clock WHERE created_at >= now - INTERVAL 7 DAY) t ON CAST(t.created_at AS DATE) = d.date GROUP BY 1, 2""")
def _(v):
    return A.per_day(timed(v), v.now)


@query("top_queries", r"""recent AS (SELECT * FROM messages WHERE role = 'user' ORDER BY created_at DESC, message_id DESC LIMIT 200),
    g AS (SELECT substr(regexp_replace(content, '^\s+|\s+$', '', 'g'), 1, 80) AS label, count(*) AS n, max(created_at) AS seen FROM recent GROUP BY 1),
    top AS (SELECT * FROM g ORDER BY n DESC, seen DESC LIMIT 5)
    SELECT label, CAST(n AS BIGINT) AS count, CAST(floor(n * 100.0 / max(n) OVER () + 0.5) AS BIGINT) AS share FROM top""")
def _(v):
    return A.top_queries(v["messages"])


@query("verification_stats", """SELECT CAST(count(verification_attempts) AS BIGINT) AS verified_total,
    CAST(count(*) FILTER (WHERE verification_attempts > 1) AS BIGINT) AS retried_total,
    CAST(count(*) FILTER (WHERE verification_approved = false) AS BIGINT) AS never_approved_total,
    round(count(*) FILTER (WHERE verification_attempts > 1) * 100.0::DOUBLE / count(verification_attempts), 1) AS retry_rate FROM messages""")
def _(v):
    return A.verification_stats(v["messages"])


@query("recent_corrected", """SELECT (SELECT max_by(u.content, u.created_at) FROM messages u WHERE u.conversation_id = m.conversation_id
      AND u.role = 'user' AND u.created_at < m.created_at) AS question, m.content AS answer, m.verification_attempts AS attempts,
      m.verification_approved AS approved, m.created_at FROM (SELECT * FROM messages WHERE verification_attempts > 1
      ORDER BY created_at DESC, message_id DESC LIMIT 5) m""")
def _(v):
    return A.recent_corrected(v["messages"])


@query("role_counts", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE role = 'admin') AS BIGINT) AS admins,
    CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS users FROM members""")
def _(v):
    return A.role_counts(v["members"])


@query("table_counts", """SELECT 'documents' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM kb_documents UNION ALL
    SELECT 'document_chunks', count(*) FROM kb_chunks UNION ALL SELECT 'conversations', count(*) FROM chats UNION ALL
    SELECT 'messages', count(*) FROM messages""")
def _(v):
    return A.table_counts({"documents": v["kb_documents"], "document_chunks": v["kb_chunks"],
                           "conversations": v["chats"], "messages": v["messages"]})


TAX = """tax AS (SELECT DISTINCT 'program' AS kind, program AS name FROM kb_documents UNION ALL SELECT DISTINCT 'faculty', faculty FROM kb_documents
    UNION ALL SELECT 'document_type', 'pensum' UNION ALL SELECT 'faculty', 'sin uso' UNION ALL SELECT 'program', r_name FROM region)"""


@query("taxonomy_usage", TAX + """, used AS (SELECT 'program' AS kind, program AS name FROM kb_documents UNION ALL
      SELECT 'faculty', faculty FROM kb_documents UNION ALL SELECT 'document_type', document_type FROM kb_documents)
    SELECT t.kind, t.name, CAST(count(u.name) AS BIGINT) AS doc_count, count(u.name) = 0 AS deletable
    FROM tax t LEFT JOIN used u ON u.kind = t.kind AND u.name = t.name GROUP BY 1, 2""")
def _(v):
    d = v["kb_documents"]
    tax = d.select(F.lit("program").alias("kind"), C("program").alias("name")).distinct().unionByName(
        d.select(F.lit("faculty").alias("kind"), C("faculty").alias("name")).distinct()).unionByName(
        v["region"].select(F.lit("program").alias("kind"), C("r_name").alias("name"))).unionByName(
        v.spark.createDataFrame([("document_type", "pensum"), ("faculty", "sin uso")], "kind string, name string"))
    return A.taxonomy_usage(d, tax)


@query("distinct_programs", "SELECT DISTINCT program FROM kb_documents WHERE program <> ''")
def _(v):
    return A.distinct_programs(v["kb_documents"])


@query("dedup_case_insensitive", "SELECT min(name) AS name FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS name FROM documents) GROUP BY lower(name)")
def _(v):
    name = F.when(C("doc_id") % 2 == 0, F.upper("source")).otherwise(C("source"))
    return A.dedup_case_insensitive(v["documents"].select(name.alias("name")), "name")


@query("taxonomy_conflicts", """SELECT p.name AS proposal, s.s_suppkey AS conflicting_id FROM
    (SELECT c_custkey AS id, '  ' || upper(replace(c_name, 'Customer', 'Supplier')) || ' ' AS name FROM customer) p
    JOIN supplier s ON lower(s.s_name) = lower(trim(p.name)) WHERE s.s_suppkey <> p.id + 1""")
def _(v):
    props = v["customer"].select(
        (C("c_custkey") + 1).alias("id"),
        F.concat(F.lit("  "), F.upper(F.replace(C("c_name"), F.lit("Customer"), F.lit("Supplier"))), F.lit(" ")).alias("name"))
    return A.taxonomy_conflicts(v["supplier"].select(C("s_suppkey").alias("id"), C("s_name").alias("name")), props)


@query("message_rate_cards", TIMED + """ SELECT CAST(floor((SELECT count(*) FROM messages)::DOUBLE / count(DISTINCT user_id) + 0.5) AS BIGINT) AS messages_per_user,
    CAST(count(*) FILTER (WHERE created_at >= date_trunc('day', now)) AS BIGINT) AS today,
    CAST(count(*) FILTER (WHERE created_at >= now - INTERVAL 7 DAY) AS BIGINT) AS last_7_days FROM timed, clock""")
def _(v):
    return A.message_rate_cards(timed(v), v["messages"], v.now)


BUCKET = TIMED + """, b AS (SELECT CASE WHEN d >= today THEN 'Hoy' WHEN d >= today - 1 THEN 'Ayer' WHEN d >= today - 7 THEN 'Esta semana'
    WHEN d >= today - INTERVAL 1 MONTH THEN 'Este mes' ELSE 'Anteriores' END AS bucket, conversation_id
    FROM (SELECT conversation_id, CAST(created_at AS DATE) AS d, CAST(now - INTERVAL 6 DAY AS DATE) AS today FROM timed, clock))"""


def _shifted(v):
    import datetime as dt

    return (v.now - dt.timedelta(days=6)).date()


@query("date_buckets", BUCKET + " SELECT bucket, conversation_id FROM b")
def _(v):
    return A.date_buckets(timed(v), _shifted(v))


@query("date_bucket_counts", BUCKET + " SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1")
def _(v):
    return A.date_bucket_counts(timed(v), _shifted(v))


@query("chunk_stats", """SELECT l_orderkey AS document_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_tokens
    FROM lineitem GROUP BY 1""")
def _(v):
    return A.chunk_stats(v["lineitem"].select(C("l_orderkey").alias("document_id"), C("l_quantity").cast("long").alias("token_count")))
