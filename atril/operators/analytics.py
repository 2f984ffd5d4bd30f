"""Usage figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril.functions import text as tx

# Spanish weekday letters from Monday, and the date bucket names.
WEEKDAY_LETTERS = "LMXJVSD"
BUCKETS = ["Hoy", "Ayer", "Esta semana", "Este mes", "Anteriores"]


def usage_totals(conv: DataFrame, msgs: DataFrame) -> DataFrame:
    """A1."""
    c = conv.agg(
        F.count_if("is_active").alias("total_conversations"), F.countDistinct("user_id").alias("unique_users")
    )
    m = msgs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("role") == "assistant", F.col("response_time_ms"))).alias("ms"),
    )
    return c.withColumns({
        "total_messages": m.select("n").scalar(),
        "avg_response_time_s": m.select(F.when(F.col("ms") != 0, F.round(F.col("ms") / 1000, 1))).scalar(),
    })


def resolution_rate(conv: DataFrame, msgs: DataFrame) -> DataFrame:
    """A2: the numerator also counts inactive conversations."""
    active = conv.agg(F.count_if("is_active"))
    return msgs.where(F.col("role") == "assistant").agg(
        F.countDistinct("conversation_id").alias("with_reply")
    ).withColumn("active", active.scalar()).withColumn(
        "resolution_rate",
        F.coalesce(F.round(F.try_divide(F.col("with_reply"), F.col("active")) * 100, 1), F.lit(0.0)),
    )


def week_over_week(conv: DataFrame, now: dt.datetime) -> DataFrame:
    """A3."""
    week, two = F.lit(now - dt.timedelta(days=7)), F.lit(now - dt.timedelta(days=14))
    counts = conv.where(F.col("created_at") >= two).agg(
        F.count_if(F.col("created_at") >= week).alias("this_week"),
        F.count_if(F.col("created_at") < week).alias("last_week"),
    )
    pct = F.floor((F.col("this_week") - F.col("last_week")) / F.when(F.col("last_week") > 0, F.col("last_week")) * 100 + 0.5)
    label = (
        F.when((F.col("this_week") == 0) & (F.col("last_week") == 0), "Sin datos")
        .when(F.col("last_week") == 0, "Nueva actividad")
        .otherwise(F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%")))
    )
    return counts.withColumns({"delta_pct": pct.cast("long"), "label": label})


def per_day(df: DataFrame, now: dt.datetime, days: int = 7) -> DataFrame:
    """A4: zero-filled counts of the last days, oldest first."""
    spark = df.sparkSession
    day = F.explode(F.sequence(F.date_sub(F.lit(now.date()), days - 1), F.lit(now.date()))).alias("date")
    calendar = spark.range(1).select(day)
    counts = df.where(F.col("created_at") >= F.lit(now - dt.timedelta(days=days))).groupBy(
        F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "date", "left").select(
        "date",
        F.substring(F.lit(WEEKDAY_LETTERS), F.weekday("date") + 1, F.lit(1)).alias("label"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    ).orderBy("date")


def top_queries(msgs: DataFrame, recent: int = 200, n: int = 5) -> DataFrame:
    """A5: most frequent among the most recent user messages; ties by recency."""
    latest = msgs.where(F.col("role") == "user").orderBy(F.desc("created_at"), F.desc("message_id")).limit(recent)
    top = latest.groupBy(F.substring(tx.strip(F.col("content")), 1, 80).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.max(F.struct("created_at", "message_id")).alias("_seen")
    ).orderBy(F.desc("count"), F.desc("_seen")).limit(n)
    best = top.agg(F.max("count"))
    return top.withColumn("share", F.floor(F.col("count") * 100 / best.scalar() + 0.5).cast("long")).drop("_seen")


def verification_stats(msgs: DataFrame) -> DataFrame:
    """A6."""
    return msgs.agg(
        F.count_if(F.col("verification_attempts").isNotNull()).alias("verified_total"),
        F.count_if(F.col("verification_attempts") > 1).alias("retried_total"),
        F.count_if(~F.col("verification_approved")).alias("never_approved_total"),
    ).withColumn("retry_rate", F.coalesce(
        F.round(F.try_divide(F.col("retried_total"), F.col("verified_total")) * 100, 1), F.lit(0.0)))


def recent_corrected(msgs: DataFrame, n: int = 5) -> DataFrame:
    """The n newest retried answers with the question before each.

    Only those n conversations are looked up, not the whole history.
    """
    newest = msgs.where(F.col("verification_attempts") > 1).orderBy(
        F.desc("created_at"), F.desc("message_id")).limit(n).select(
        "message_id", "conversation_id", F.col("created_at"), F.col("content").alias("answer"),
        F.col("verification_attempts").alias("attempts"), F.col("verification_approved").alias("approved"))
    asked = msgs.where(F.col("role") == "user").select(
        F.col("conversation_id"), F.col("created_at").alias("_asked_at"), F.col("content").alias("_q"))
    pairs = asked.join(F.broadcast(newest), "conversation_id").where(F.col("_asked_at") < F.col("created_at"))
    question = pairs.groupBy("message_id").agg(F.max_by("_q", "_asked_at").alias("question"))
    return newest.join(question, "message_id", "left").select(
        "question", "answer", "attempts", "approved", "created_at").orderBy(F.desc("created_at"))


def role_counts(users: DataFrame) -> DataFrame:
    """A8."""
    return users.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(F.col("role") == "user").alias("users"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A9."""
    from atril.operators.scale import union_all

    return union_all([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])


def taxonomy_usage(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """A10: taxonomy(kind, name) with the documents using each name."""
    long = docs.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("faculty", "program", "document_type")
    ])).alias("e")).select("e.*").where(F.col("name").isNotNull())
    used = long.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("doc_count"))
    out = taxonomy.join(used, ["kind", "name"], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return out.withColumn("deletable", F.col("doc_count") == 0)


def distinct_programs(docs: DataFrame) -> DataFrame:
    """A11."""
    return docs.select("program").where(F.col("program") != "").distinct()


def dedup_case_insensitive(docs: DataFrame, column: str) -> DataFrame:
    """The smallest spelling of each name."""
    named = docs.where(F.col(column) != "")
    return named.groupBy(F.lower(column).alias("_k")).agg(F.min(column).alias("name")).select("name")


def taxonomy_conflicts(taxonomy: DataFrame, proposals: DataFrame) -> DataFrame:
    """taxonomy(id, name), proposals(id or NULL, name)."""
    t = taxonomy.select(F.col("id").alias("conflicting_id"), F.lower("name").alias("_k"))
    p = proposals.select(F.col("id").alias("_self"), F.col("name").alias("proposal"),
                         F.lower(tx.strip(F.col("name"))).alias("_k"))
    hit = p.join(t, "_k").where(~F.col("_self").eqNullSafe(F.col("conflicting_id")))
    return hit.select("proposal", "conflicting_id")


def best_score_per_entity(results: DataFrame, column: str = "program") -> DataFrame:
    """A14."""
    named = results.where(F.col(column) != "")
    return named.groupBy("query_id", F.col(column).alias("name")).agg(F.max("score").alias("best_score"))


def message_rate_cards(conv: DataFrame, msgs: DataFrame, now: dt.datetime) -> DataFrame:
    """Messages per distinct user, conversations today and in the last 7 days."""
    midnight = dt.datetime.combine(now.date(), dt.time())
    users = F.countDistinct("user_id")
    n_msgs = msgs.agg(F.count(F.lit(1))).scalar()
    c = conv.agg(
        users.alias("_u"),
        F.count_if(F.col("created_at") >= F.lit(midnight)).alias("today"),
        F.count_if(F.col("created_at") >= F.lit(now - dt.timedelta(days=7))).alias("last_7_days"),
    ).withColumn("_m", n_msgs)
    per_user = F.when(F.col("_u") > 0, F.floor(F.try_divide(F.col("_m"), F.col("_u")) + 0.5)).otherwise(0)
    return c.select(per_user.cast("long").alias("messages_per_user"), "today", "last_7_days")


def date_buckets(conv: DataFrame, today: dt.date) -> DataFrame:
    """(bucket, conversation_id), one row per conversation."""
    day = F.lit(today)
    d = F.to_date("created_at")
    bucket = (
        F.when(d >= day, BUCKETS[0]).when(d >= F.date_sub(day, 1), BUCKETS[1])
        .when(d >= F.date_sub(day, 7), BUCKETS[2]).when(d >= F.add_months(day, -1), BUCKETS[3])
        .otherwise(BUCKETS[4])
    )
    return conv.select(bucket.alias("bucket"), "conversation_id")


def date_bucket_counts(conv: DataFrame, today: dt.date) -> DataFrame:
    """Non-empty buckets with their size."""
    return date_buckets(conv, today).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """A21."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
