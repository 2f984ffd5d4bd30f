"""Registered row-maintenance, listing and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.operators import rows as R
from atril.plans.registry import query
from atril.plans.text_queries import strip_sql

C = F.col
DOC = "document_id, title, program, faculty, document_type, ingestion_status, file_name, created_at"


@query("scan_table", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def _(v):
    return v["lineitem"].select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("filter_documents", f"SELECT {DOC} FROM kb_documents WHERE ingestion_status = 'completed' AND program = 'src3'")
def _(v):
    return R.filter_documents(v["kb_documents"], "completed", "src3").drop("content")


@query("active_conversations", """SELECT * FROM chats WHERE is_active AND user_id = 5
    ORDER BY updated_at DESC, conversation_id LIMIT 20 OFFSET 1""")
def _(v):
    return R.active_conversations(v["chats"], 5, 20, 1)


TO_DELETE = "SELECT DISTINCT conv_id AS conversation_id FROM conversations WHERE role = 'system'"


def _system_ids(v):
    return v["conversations"].where(C("role") == "system").select(C("conv_id").alias("conversation_id"))


@query("soft_delete", f"""SELECT conversation_id, user_id, title, created_at, updated_at,
    is_active AND conversation_id NOT IN ({TO_DELETE}) AS is_active FROM chats""")
def _(v):
    return R.soft_delete(v["chats"], _system_ids(v))


@query("patch_columns", """SELECT d.document_id, d.title,
    CASE WHEN l.quality = 1 THEN CASE WHEN l.toxic = 1 THEN NULL ELSE 'revisado' END ELSE d.program END AS program,
    CASE WHEN l.toxic = 0 THEN 'tox0' ELSE d.faculty END AS faculty
    FROM kb_documents d LEFT JOIN labels l ON l.doc_id = d.document_id""")
def _(v):
    patches = v["labels"].select(
        C("doc_id").alias("document_id"), F.when(C("toxic") == 0, "revisado").alias("program"),
        (C("quality") == 1).alias("program_present"), F.lit("tox0").alias("faculty"),
        (C("toxic") == 0).alias("faculty_present"))
    return R.patch_columns(v["kb_documents"].select("document_id", "title", "program", "faculty"),
                           patches, "document_id", ["program", "faculty"])


def both_kinds(left):
    """Remaining conversations and messages as one table."""
    conv, msgs = left
    return conv.select(F.lit("conversation").alias("kind"), C("conversation_id").alias("id"), "conversation_id").unionByName(
        msgs.select(F.lit("message").alias("kind"), C("message_id").alias("id"), "conversation_id"))


BOTH_KINDS = """SELECT 'conversation' AS kind, conversation_id AS id, conversation_id FROM remaining
    UNION ALL SELECT 'message', m.message_id, m.conversation_id FROM messages m JOIN remaining USING (conversation_id)"""


@query("expire_guest_rows", """remaining AS (SELECT c.conversation_id FROM chats c, clock WHERE NOT (c.user_id IS NULL AND c.created_at < clock.now - INTERVAL 2 HOUR))
    """ + BOTH_KINDS)
def _(v):
    return both_kinds(R.expire_guest_rows(v["chats"], v["messages"], v.now))


@query("close_guest", """remaining AS (SELECT conversation_id FROM chats WHERE user_id IS NOT NULL OR title IS NULL OR title <> 'Nueva conversación')
    """ + BOTH_KINDS)
def _(v):
    """Everyone asks to close the conversations without a title of their own; only guests' go."""
    asked = v["chats"].where("title = 'Nueva conversación'").select("conversation_id")
    return both_kinds(R.close_guests(v["chats"], v["messages"], asked))


@query("fail_orphan_runs", """SELECT run_id, started_at, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status,
    CASE status WHEN 'running' THEN 'interrumpida por reinicio' END AS error,
    CASE status WHEN 'running' THEN clock.now END AS completed_at FROM runs, clock""")
def _(v):
    return R.fail_orphan_runs(v["runs"], v.now)


MESSAGES_IN = """SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN repeat(text || ' ', 4) WHEN 3 THEN '  ' || chr(10) ELSE ' ' || text END AS content,
    CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'voice' ELSE 'video' END AS input_type FROM conversations"""


@query("validate_messages", f"""SELECT conv_id, turn, input_type, {strip_sql('content')} AS content,
    CASE WHEN {strip_sql('content')} = '' THEN 'empty' WHEN length({strip_sql('content')}) > 4000 THEN 'too_long'
         WHEN input_type NOT IN ('text', 'voice') THEN 'input_type' END AS reject_reason FROM ({MESSAGES_IN})""")
def _(v):
    t = C("turn")
    content = (F.when(t % 4 == 1, F.repeat(F.concat(C("text"), F.lit(" ")), F.lit(4)))
               .when(t % 4 == 3, F.lit("  \n")).otherwise(F.concat(F.lit(" "), C("text"))))
    kind = F.when(t % 3 == 0, "text").when(t % 3 == 1, "voice").otherwise("video")
    return R.validate_messages(v["conversations"].select("conv_id", "turn", content.alias("content"), kind.alias("input_type")))


@query("validate_accounts", r"""SELECT user_id, lower(trim(email)) AS email, role, display_name,
    CASE WHEN NOT regexp_full_match(lower(trim(email)), '[^@\s]+@[^@\s]+\.[^@\s]+') THEN 'email'
         WHEN role NOT IN ('user', 'admin') THEN 'role' END AS reject_reason FROM members""")
def _(v):
    return R.validate_accounts(v["members"])


@query("validate_titles", f"""SELECT doc_id, substr({strip_sql("text")}, 1, 100) AS title,
    CASE WHEN {strip_sql("text")} = '' THEN 'empty' END AS reject_reason FROM documents""")
def _(v):
    return R.validate_titles(v["documents"].select("doc_id", C("text").alias("title")))


@query("title_search", "SELECT conversation_id, title FROM chats WHERE contains(lower(coalesce(title, '')), 'pensum')")
def _(v):
    return R.title_search(v["chats"], "PENSUM").select("conversation_id", "title")


@query("auto_title", """SELECT c.conversation_id, c.user_id, c.is_active, c.created_at, c.updated_at,
    CASE WHEN c.title = 'Nueva conversación' THEN coalesce(substr(f.first, 1, 60), c.title) ELSE c.title END AS title
    FROM chats c LEFT JOIN (SELECT conversation_id, min_by(content, ord) AS first FROM messages WHERE role = 'user' GROUP BY 1) f
    USING (conversation_id)""")
def _(v):
    return R.auto_title(v["chats"], v["messages"])


@query("ownership_visible", "SELECT conversation_id, user_id FROM chats WHERE user_id IS NULL OR user_id = 7")
def _(v):
    return R.ownership_visible(v["chats"], 7).select("conversation_id", "user_id")


@query("admin_demotion_guard", """SELECT c.user_id, c.actor_id, c.new_role, m.role AS old_role,
    CASE WHEN c.new_role NOT IN ('user', 'admin') THEN 'bad_role' WHEN c.user_id = c.actor_id THEN 'self'
         WHEN m.role IS NULL THEN 'not_found'
         WHEN m.role = 'admin' AND c.new_role <> 'admin' AND (SELECT count(*) FROM members WHERE role = 'admin') <= 1 THEN 'last_admin'
         ELSE 'ok' END AS verdict
    FROM (SELECT o_custkey AS user_id, o_orderkey % 900 AS actor_id,
                 CASE o_orderstatus WHEN 'O' THEN 'admin' WHEN 'F' THEN 'user' ELSE 'root' END AS new_role FROM orders) c
    LEFT JOIN members m USING (user_id)""")
def _(v):
    role = F.when(C("o_orderstatus") == "O", "admin").when(C("o_orderstatus") == "F", "user").otherwise("root")
    changes = v["orders"].select(C("o_custkey").alias("user_id"), (C("o_orderkey") % 900).alias("actor_id"), role.alias("new_role"))
    return R.admin_demotion_guard(v["members"].select("user_id", "role"), changes)


@query("delete_document_cascade", """poor AS (SELECT doc_id FROM labels WHERE quality = 0)
    SELECT 'document' AS kind, document_id AS id, document_id FROM kb_documents WHERE document_id NOT IN (SELECT doc_id FROM poor)
    UNION ALL SELECT 'chunk', chunk_id, document_id FROM kb_chunks WHERE document_id NOT IN (SELECT doc_id FROM poor)""")
def _(v):
    ids = v["labels"].where(C("quality") == 0).select(C("doc_id").alias("document_id"))
    docs, chunks = R.delete_document_cascade(v["kb_documents"], v["kb_chunks"], ids)
    return docs.select(F.lit("document").alias("kind"), C("document_id").alias("id"), "document_id").unionByName(
        chunks.select(F.lit("chunk").alias("kind"), C("chunk_id").alias("id"), "document_id"))


@query("reset_for_reindex", """poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
    SELECT document_id, CASE WHEN p.doc_id IS NULL THEN ingestion_status ELSE 'processing' END AS ingestion_status,
      CAST(p.doc_id IS NULL AS BIGINT) AS total_chunks, CAST(p.doc_id IS NULL AS BIGINT) AS stored
    FROM kb_documents LEFT JOIN poor p ON p.doc_id = document_id""")
def _(v):
    ids = v["labels"].where(C("quality") == 0).select(C("doc_id").alias("document_id"))
    docs = v["kb_documents"].select("document_id", "ingestion_status", F.lit(1).alias("total_chunks"))
    docs, chunks = R.reset_for_reindex(docs, v["kb_chunks"], ids)
    stored = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("stored"))
    return docs.join(stored, "document_id", "left").select(
        "document_id", "ingestion_status", C("total_chunks").cast("long").alias("total_chunks"), F.coalesce("stored", F.lit(0)).alias("stored"))


@query("previous_user_turn", """SELECT m.message_id, m.role, (SELECT max_by(u.content, u.created_at) FROM messages u
    WHERE u.conversation_id = m.conversation_id AND u.role = 'user' AND u.created_at < m.created_at) AS prev_user_content FROM messages m""")
def _(v):
    return R.previous_user_turn(v["messages"]).select("message_id", "role", "prev_user_content")


@query("content_hash_duplicates", """WITH up AS (SELECT doc_id AS upload_id, sha256(text) AS content_hash FROM documents),
    done AS (SELECT sha256(d.text) AS content_hash FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1)
    SELECT upload_id, content_hash IN (SELECT content_hash FROM done)
       OR upload_id <> min(upload_id) OVER (PARTITION BY content_hash) AS is_duplicate FROM up""")
def _(v):
    up = v["documents"].select(C("doc_id").alias("upload_id"), F.sha2("text", 256).alias("content_hash"))
    status = F.when(C("quality") == 1, "completed").otherwise("failed")
    docs = v["documents"].join(v["labels"], "doc_id").select(F.sha2("text", 256).alias("content_hash"), status.alias("ingestion_status"))
    new, dup = R.content_hash_duplicates(up, docs)
    return new.select("upload_id", F.lit(False).alias("is_duplicate")).unionByName(dup.select("upload_id", F.lit(True).alias("is_duplicate")))


@query("rename_cascade", """SELECT document_id, title, CASE faculty WHEN 'en' THEN 'Ingeniería' ELSE faculty END AS faculty,
    coalesce((SELECT 'P-' || p_brand FROM part WHERE 'src' || p_partkey = program), program) AS program,
    CASE document_type WHEN 'perfil' THEN 'Perfil' ELSE document_type END AS document_type FROM kb_documents""")
def _(v):
    names = v["part"].select(
        F.lit("program").alias("kind"), F.concat(F.lit("src"), C("p_partkey").cast("string")).alias("old_name"),
        F.concat(F.lit("P-"), C("p_brand")).alias("new_name"))
    fixed = v.spark.createDataFrame([("faculty", "en", "Ingeniería"), ("document_type", "perfil", "Perfil")],
                                    "kind string, old_name string, new_name string")
    return R.rename_cascade(v["kb_documents"].select("document_id", "title", "faculty", "program", "document_type"),
                            names.unionByName(fixed))


@query("program_faculty_lookup", "SELECT p.*, f.faculty FROM programs p LEFT JOIN faculties f USING (faculty_id)")
def _(v):
    return R.program_faculty_lookup(v["programs"], v["faculties"])


@query("page_with_total", """SELECT o_orderkey, o_orderdate, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'F') AS total
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
def _(v):
    o = v["orders"].where(C("o_orderstatus") == "F").select("o_orderkey", "o_orderdate")
    return R.page_with_total(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 25)


@query("list_messages", "SELECT message_id, role, content FROM messages WHERE conversation_id = 3 ORDER BY ord LIMIT 3 OFFSET 1")
def _(v):
    return R.listing(v["messages"], [F.asc("ord")], 3, 1, C("conversation_id") == 3).select("message_id", "role", "content")


@query("list_chunks", "SELECT chunk_id, document_id FROM kb_chunks ORDER BY document_id, chunk_id LIMIT 50 OFFSET 10")
def _(v):
    return R.listing(v["kb_chunks"].select("chunk_id", "document_id"), [F.asc("document_id"), F.asc("chunk_id")], 50, 10)


@query("list_runs", "SELECT run_id, started_at, status FROM runs ORDER BY started_at DESC, run_id LIMIT 20")
def _(v):
    return R.listing(v["runs"], [F.desc("started_at"), F.asc("run_id")], 20)


@query("history_window", """SELECT m.message_id, coalesce((SELECT string_agg(u.role || ':' || CASE WHEN length(u.content) > 600
      THEN substr(u.content, 1, 600) || '…' ELSE u.content END, '|' ORDER BY u.ord) FROM messages u
      WHERE u.conversation_id = m.conversation_id AND u.ord < m.ord AND u.ord >= m.ord - 10), '') AS history FROM messages m""")
def _(v):
    shown = F.transform("history", lambda h: F.concat_ws(":", h["role"], h["content"]))
    return R.history_window(v["messages"]).select("message_id", F.array_join(shown, "|").alias("history"))


@query("turn_pairing", """WITH m0 AS (SELECT *, lag(role, 1) OVER w AS r1, lag(content, 1) OVER w AS c1, lag(role, 2) OVER w AS r2,
      lag(content, 2) OVER w AS c2 FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY ord)),
    f AS (SELECT *, coalesce(r1 = 'assistant' AND contains(c1, 'Tu pregunta puede aplicar a varios') AND r2 = 'user', false) AS is_followup FROM m0)
    SELECT message_id, conversation_id, ord, content, is_followup,
      CASE WHEN is_followup THEN c2 || ' ' || content ELSE content END AS retrieval_query FROM f WHERE role = 'user'""".replace("WITH ", "", 1))
def _(v):
    return R.turn_pairing(v["messages"])


@query("newest_n_cap", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1000")
def _(v):
    return R.newest_n_cap(v["events"].select("event_id", "ts"), 1000, "ts", "event_id")


@query("rolling_token_usage", """SELECT request_id, provider, CAST(sum(prompt_chars // 4 + max_tokens) OVER w AS BIGINT) AS used,
    sum(prompt_chars // 4 + max_tokens) OVER w > 27000 AS over
    FROM requests WINDOW w AS (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)""")
def _(v):
    return R.rolling_token_usage(v["requests"], 3600).select("request_id", "provider", "used", "over")


@query("rolling_token_usage_minute", """SELECT request_id, provider, CAST(sum(prompt_chars // 4 + max_tokens) OVER w AS BIGINT) AS used,
    sum(prompt_chars // 4 + max_tokens) OVER w > 27000 AS over
    FROM requests WINDOW w AS (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)""")
def _(v):
    return R.rolling_token_usage(v["requests"]).select("request_id", "provider", "used", "over")


SUGGEST = """subj AS (SELECT document_id, document_type, CASE WHEN program <> '' THEN program WHEN faculty <> '' THEN faculty ELSE title END AS subject
      FROM kb_documents WHERE ingestion_status = 'completed'),
    uniq AS (SELECT lower(subject) AS k, document_type, min_by(subject, document_id) AS subject FROM subj GROUP BY 1, 2)
    SELECT md5('s1|' || k || '|' || coalesce(document_type, '')) AS ord, substr(subject, 1, 48) AS label, document_type,
      CASE document_type WHEN 'pensum' THEN '¿Cuáles son las materias del plan de estudios de ' || subject || '?'
        WHEN 'admision' THEN '¿Cuáles son los requisitos de admisión para ' || subject || '?'
        WHEN 'perfil' THEN '¿Cuál es el perfil profesional de ' || subject || '?'
        WHEN 'mision' THEN '¿Cuál es la misión y visión de la institución?'
        WHEN 'reglamento' THEN '¿Qué establece el reglamento sobre ' || subject || '?'
        ELSE '¿Qué información hay disponible sobre ' || subject || '?' END AS query
    FROM uniq ORDER BY 1 LIMIT 4"""


@query("suggest_questions", SUGGEST)
def _(v):
    return R.suggest_questions(v["kb_documents"], 4, "s1")


@query("fallback_fill", """SELECT * FROM (SELECT 0 AS p, r_name AS ord, r_name AS label FROM region UNION ALL
    SELECT 1, n_name, n_name FROM nation) ORDER BY p, ord LIMIT 9""".replace("SELECT * FROM", "SELECT ord, label FROM", 1))
def _(v):
    a = v["region"].select(C("r_name").alias("ord"), C("r_name").alias("label"))
    b = v["nation"].select(C("n_name").alias("ord"), C("n_name").alias("label"))
    return R.fallback_fill(a, b, 9).select("ord", "label")
