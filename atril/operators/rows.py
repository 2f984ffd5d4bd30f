"""Row selection, maintenance, listings and windows
(survey ids P1-P13, J2, J4, J5, J8, S9, K3, K4, U2, W2-W5, C20)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atril import settings as S
from atril.functions import text as tx
from atril.operators import scale

HOUR_MICROS = 3_600_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# ------------------------------------------------------------------ selection

def filter_documents(docs: DataFrame, status: str | None = None, program: str | None = None) -> DataFrame:
    """P1."""
    if status:
        docs = docs.where(F.col("ingestion_status") == status)
    if program:
        docs = docs.where(F.col("program") == program)
    return docs


def listing(df: DataFrame, order: list[Column], limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """K4: ordered, limited listing; planned as a distributed top-n."""
    if where is not None:
        df = df.where(where)
    return df.orderBy(*order).offset(offset).limit(limit)


def active_conversations(conv: DataFrame, user=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """P3."""
    keep = F.col("is_active")
    if user is not None:
        keep &= F.col("user_id") == F.lit(user)
    return listing(conv, [F.desc("updated_at"), F.asc("conversation_id")], limit, offset, keep)


def page_with_total(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """K3: one page plus the total number of matching rows."""
    total = df.agg(F.count(F.lit(1)))
    return listing(df, order, per_page, (page - 1) * per_page).withColumn("total", total.scalar())


def title_search(conv: DataFrame, needle: str) -> DataFrame:
    """P9."""
    return conv.where(F.lower(F.coalesce("title", F.lit(""))).contains(needle.lower()))


def ownership_visible(conv: DataFrame, viewer) -> DataFrame:
    """P12."""
    return conv.where(F.col("user_id").isNull() | F.col("user_id").eqNullSafe(F.lit(viewer)))


def dimension_check(chunks: DataFrame, dim: int, by: str) -> DataFrame:
    """P10."""
    return chunks.groupBy(F.col(by).alias("model")).agg(
        F.count_if(F.size("embedding") != dim).alias("wrong"), F.count(F.lit(1)).alias("total")
    )


# ------------------------------------------------------------------ maintenance

def soft_delete(conv: DataFrame, ids: DataFrame) -> DataFrame:
    """P4."""
    gone = ids.select("conversation_id").distinct().withColumn("_gone", F.lit(True))
    return conv.join(gone, "conversation_id", "left").withColumn(
        "is_active", F.when(F.col("_gone"), False).otherwise(F.col("is_active"))
    ).drop("_gone")


def patch_columns(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """P5: `<field>_present` says whether a patch names the field; NULL then clears it."""
    p = patches.select(key, *[F.struct(f, F.col(f"{f}_present").alias("present")).alias(f"_p_{f}") for f in fields])
    out = rows.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"_p_{f}.present"), F.col(f"_p_{f}")[f]).otherwise(F.col(f)))
    return out.drop(*[f"_p_{f}" for f in fields])


def expire_guest_rows(conv: DataFrame, msgs: DataFrame, now: dt.datetime, hours: int = S.GUEST_TTL_HOURS):
    """(conversations, messages) that remain after the guest sweep."""
    cutoff = F.lit(now - dt.timedelta(hours=hours))
    gone = conv.where(F.col("user_id").isNull() & (F.col("created_at") < cutoff))
    left = conv.where(F.col("user_id").isNotNull() | (F.col("created_at") >= cutoff))
    return left, msgs.join(gone.select("conversation_id"), "conversation_id", "left_anti")


def close_guests(conv: DataFrame, msgs: DataFrame, asked: DataFrame):
    """P6, explicit form: (conversations, messages) without the guest conversations named in `asked`(conversation_id);
    a conversation with an owner stays, whoever asks."""
    named = asked.select("conversation_id").distinct()
    gone = conv.where(F.col("user_id").isNull()).join(named, "conversation_id", "left_semi").select("conversation_id")
    return conv.join(gone, "conversation_id", "left_anti"), msgs.join(gone, "conversation_id", "left_anti")


def fail_orphan_runs(runs: DataFrame, now: dt.datetime, message: str = "interrumpida por reinicio") -> DataFrame:
    """P7."""
    orphan = F.col("status") == "running"
    return runs.withColumns({
        "error": F.when(orphan, F.lit(message)),
        "completed_at": F.when(orphan, F.lit(now)),
        "status": F.when(orphan, F.lit("failed")).otherwise(F.col("status")),
    })


def validate_messages(df: DataFrame) -> DataFrame:
    """Trimmed content plus `reject_reason` (NULL = accepted)."""
    body = tx.strip(F.col("content"))
    reason = (
        F.when(body.isNull() | (body == ""), "empty")
        .when(F.length(body) > S.MAX_MESSAGE_CHARS, "too_long")
        .when(~F.coalesce(F.col("input_type").isin("text", "voice"), F.lit(False)), "input_type")
    )
    return df.withColumns({"reject_reason": reason, "content": body})


def validate_accounts(df: DataFrame) -> DataFrame:
    """E-mail shape and role."""
    email = F.lower(tx.strip(F.col("email")))
    reason = F.when(~email.rlike("(?U)^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), "email").when(
        ~F.col("role").isin("user", "admin"), "role")
    return df.withColumns({"email": email, "reject_reason": reason})


def validate_titles(df: DataFrame) -> DataFrame:
    """Trimmed title of at most 100 characters; empty is rejected."""
    title = tx.strip(F.col("title"))
    return df.withColumns({
        "reject_reason": F.when(F.coalesce(title, F.lit("")) == "", "empty"),
        "title": F.substring(title, 1, S.MAX_TITLE_CHARS),
    })


def auto_title(conv: DataFrame, msgs: DataFrame) -> DataFrame:
    """P11."""
    first = msgs.where(F.col("role") == "user").groupBy("conversation_id").agg(
        F.substring(F.min_by("content", "ord"), 1, 60).alias("_first"))
    return conv.join(first, "conversation_id", "left").withColumn(
        "title", F.when(F.col("title") == S.UNTITLED, F.coalesce("_first", "title")).otherwise(F.col("title"))
    ).drop("_first")


def admin_demotion_guard(users: DataFrame, changes: DataFrame) -> DataFrame:
    """`verdict` per requested role change, judged against the stored table."""
    admins = users.where(F.col("role") == "admin").agg(F.count(F.lit(1)))
    target = users.select(F.col("user_id"), F.col("role").alias("old_role"))
    verdict = (
        F.when(~F.col("new_role").isin("user", "admin"), "bad_role")
        .when(F.col("user_id") == F.col("actor_id"), "self")
        .when(F.col("old_role").isNull(), "not_found")
        .when((F.col("old_role") == "admin") & (F.col("new_role") != "admin") & (admins.scalar() <= 1), "last_admin")
        .otherwise("ok")
    )
    return changes.join(target, "user_id", "left").withColumn("verdict", verdict)


def delete_document_cascade(docs: DataFrame, chunks: DataFrame, ids: DataFrame):
    """(documents, chunks) without the given documents."""
    gone = ids.select("document_id").distinct()
    return docs.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def reset_for_reindex(docs: DataFrame, chunks: DataFrame, ids: DataFrame):
    """S9, re-index form: chunks go, the document stays as `processing` with no chunks."""
    gone = ids.select("document_id").distinct()
    hit = gone.withColumn("_hit", F.lit(True))
    reset = docs.join(hit, "document_id", "left")
    reset = reset.withColumns({
        "ingestion_status": F.when(F.col("_hit"), F.lit("processing")).otherwise(F.col("ingestion_status")),
        "total_chunks": F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("total_chunks")),
    }).drop("_hit")
    return reset, chunks.join(gone, "document_id", "left_anti")


def content_hash_duplicates(uploads: DataFrame, documents: DataFrame):
    """(new, duplicates).  A duplicate repeats a completed document or an earlier
    upload of the same batch.

    The first upload per hash comes from a map-side combined aggregate, and rows are
    separated on the unique upload id: a hash shared by a third of the uploads never
    gathers in one task.
    """
    done = documents.where(F.col("ingestion_status") == "completed").select("content_hash").distinct()
    firsts = uploads.groupBy("content_hash").agg(F.min("upload_id").alias("upload_id"))
    fresh = firsts.join(done, "content_hash", "left_anti").select("upload_id")
    return uploads.join(fresh, "upload_id", "left_semi"), uploads.join(fresh, "upload_id", "left_anti")


def rename_cascade(documents: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(kind, old_name, new_name) applied to faculty, program, document_type."""
    out = documents
    for kind in ("faculty", "program", "document_type"):
        r = renames.where(F.col("kind") == kind).select(F.col("old_name").alias(kind), F.col("new_name").alias("_new"))
        out = out.join(r, kind, "left").withColumn(kind, F.coalesce("_new", kind)).drop("_new")
    return out


def program_faculty_lookup(programs: DataFrame, faculties: DataFrame) -> DataFrame:
    """J8."""
    return programs.join(faculties, "faculty_id", "left")


# ------------------------------------------------------------------ order-dependent rows

def previous_user_turn(msgs: DataFrame, span: int = 24 * HOUR_MICROS) -> DataFrame:
    """Adds `prev_user_content`, the latest strictly earlier user message."""
    said = F.when(F.col("role") == "user", F.col("content"))
    return scale.carry_last(
        msgs, ["conversation_id"], micros(F.col("created_at")), said, "prev_user_content", span
    )


def history_window(msgs: DataFrame, n: int = S.HISTORY_TURNS, max_chars: int = S.HISTORY_CHARS, span: int = 4096) -> DataFrame:
    """Adds `history`, up to n earlier messages, oldest first, long ones cut."""
    body = F.when(
        F.length("content") > max_chars, F.concat(F.substring("content", 1, max_chars), F.lit("…"))
    ).otherwise(F.col("content"))
    entry = F.struct(F.col("role"), body.alias("content"))
    return scale.preceding_rows(msgs, ["conversation_id"], F.col("ord"), entry, n, "history", span)


def turn_pairing(msgs: DataFrame, span: int = 4096) -> DataFrame:
    """A user reply to a clarification is searched together with its question."""
    entry = F.struct("role", "content")
    paired = scale.preceding_rows(msgs, ["conversation_id"], F.col("ord"), entry, 2, "_prev", span)
    asked, reply_to = F.try_element_at("_prev", F.lit(-1)), F.try_element_at("_prev", F.lit(-2))
    follow = F.coalesce(
        (asked["role"] == "assistant") & asked["content"].contains(S.CLARIFICATION_MARKER)
        & (reply_to["role"] == "user"),
        F.lit(False),
    )
    return paired.where(F.col("role") == "user").select(
        "message_id", "conversation_id", "ord", "content", follow.alias("is_followup"),
        F.when(follow, F.concat_ws(" ", reply_to["content"], F.col("content"))).otherwise(F.col("content"))
        .alias("retrieval_query"),
    )


def newest_n_cap(entries: DataFrame, n: int = S.CACHE_CAPACITY, ts: str = "ts", key: str = "entry_id") -> DataFrame:
    """W4."""
    return entries.orderBy(F.desc(ts), F.asc(key)).limit(n)


def rolling_token_usage(
    requests: DataFrame, window_s: int = S.TOKEN_WINDOW_SECONDS, budget: int = S.TOKEN_BUDGET
) -> DataFrame:
    """Tokens of the trailing window per provider, the request itself included."""
    tokens = (F.floor(F.col("prompt_chars") / S.CHARS_PER_TOKEN) + F.col("max_tokens")).cast("long")
    r = requests.withColumn("tokens", tokens)
    used = scale.trailing_sum(r, ["provider"], micros(F.col("ts")), F.col("tokens"), window_s * 1_000_000, "used")
    return used.withColumn("over", F.col("used") > budget)


# ------------------------------------------------------------------ suggestions

# Question templates by document type and the fallback suggestions.
SUGGESTION_TEMPLATES = {
    "pensum": "¿Cuáles son las materias del plan de estudios de {subject}?",
    "admision": "¿Cuáles son los requisitos de admisión para {subject}?",
    "perfil": "¿Cuál es el perfil profesional de {subject}?",
    "mision": "¿Cuál es la misión y visión de {institution}?",
    "reglamento": "¿Qué establece el reglamento sobre {subject}?",
}
SUGGESTION_DEFAULT = "¿Qué información hay disponible sobre {subject}?"
SUGGESTION_FALLBACK = [
    ("Programas académicos", "¿Qué programas académicos ofrece {institution}?"),
    ("Proceso de admisión", "¿Cómo es el proceso de admisión en {institution}?"),
    ("Sedes", "¿Cuáles son las sedes de {institution}?"),
    ("Contacto", "¿Cómo puedo contactar a {institution}?"),
]


def fallback_fill(rows: DataFrame, fallback: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """`rows` in order, topped up to n from `fallback`."""
    both = rows.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    return both.orderBy("_p", order).limit(n)


def suggest_questions(docs: DataFrame, n: int = 4, seed: str = "", institution: str = "la institución") -> DataFrame:
    """C20: one suggestion per (subject, type), in seeded hash order, filled to n."""
    spark = docs.sparkSession
    subject = F.coalesce(tx.truthy(F.col("program")), tx.truthy(F.col("faculty")), F.col("title"))
    done = docs.where(F.col("ingestion_status") == "completed").withColumn("subject", subject)
    unique = done.groupBy(F.lower("subject").alias("_key"), "document_type").agg(
        F.min_by("subject", "document_id").alias("subject"))
    seeded = F.md5(F.concat_ws("|", F.lit(seed), F.col("_key"), F.coalesce("document_type", F.lit(""))))
    template = F.lit(SUGGESTION_DEFAULT)
    for kind, words in SUGGESTION_TEMPLATES.items():
        template = F.when(F.col("document_type") == kind, F.lit(words)).otherwise(template)
    text = F.replace(F.replace(template, F.lit("{subject}"), F.col("subject")), F.lit("{institution}"), F.lit(institution))
    made = unique.select(
        seeded.alias("ord"), F.substring("subject", 1, 48).alias("label"), text.alias("query"), "document_type")
    spare = spark.createDataFrame(
        [(str(i), label, q.format(institution=institution), None) for i, (label, q) in enumerate(SUGGESTION_FALLBACK)],
        "ord string, label string, query string, document_type string",
    )
    return fallback_fill(made, spare, n).select("ord", "label", "query", "document_type")
