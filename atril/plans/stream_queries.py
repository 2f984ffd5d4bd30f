"""Registered streaming jobs, run over everything available, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.functions.text import ABBREVIATIONS, MIN_SENTENCE_CHARS
from atril.operators import scale
from atril.operators.rows import micros
from atril.plans.ingest_queries import uploads
from atril.plans.registry import query
from atril.session import scratch_path
from atril.streaming import jobs as J

C = F.col


def ts():
    return C("ts").cast("timestamp").alias("ts")


def events(v):
    return J.table_stream(v.spark, v.dir, "events")


@query("stream_daily_activity", """SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", CAST(count(*) AS BIGINT) AS count
    FROM events, clock GROUP BY 1, 2, now HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= now - INTERVAL 1 HOUR""")
def _(v):
    return J.run_to_table(J.stream_daily_activity(events(v).select(C("ts").cast("timestamp").alias("created_at"))), "daily")


@query("stream_token_budget", """slides AS (SELECT event_type AS provider, CAST(floor(value * 200) AS BIGINT) // 4 + user_id % 5 * 100 AS tokens,
      unnest([0, 1, 2, 3, 4, 5]) AS i, time_bucket(INTERVAL 10 SECOND, ts) AS t FROM events),
    w AS (SELECT t - to_seconds(i * 10) AS start, provider, CAST(sum(tokens) AS BIGINT) AS used FROM slides GROUP BY 1, 2)
    SELECT start, start + INTERVAL 60 SECOND AS "end", provider, used, used > 27000 AS over FROM w, clock WHERE start + INTERVAL 60 SECOND <= now - INTERVAL 1 MINUTE""")
def _(v):
    tokens = (F.floor(F.floor(C("value") * 200) / 4) + C("user_id") % 5 * 100).cast("long").alias("tokens")
    return J.run_to_table(J.stream_token_budget(events(v).select(C("event_type").alias("provider"), ts(), tokens)), "budget")


ROUTES = ["chat", "upload", "register", "login", "forgot", "reset"]


@query("stream_quota_audit", """r AS (SELECT 'c' || user_id % 5 AS client, (['chat','upload','register','login','forgot','reset'])[1 + CAST(event_id % 6 AS INTEGER)] AS route, ts FROM events),
    s AS (SELECT client, route, CASE route WHEN 'chat' THEN 60 WHEN 'login' THEN 300 ELSE 3600 END AS secs, CASE route WHEN 'chat' THEN 20 WHEN 'upload' THEN 20 WHEN 'register' THEN 5
      WHEN 'login' THEN 10 WHEN 'forgot' THEN 3 ELSE 10 END AS quota, ts FROM r),
    w AS (SELECT to_timestamp(floor(epoch(ts) / secs) * secs)::TIMESTAMP AS start, secs, quota, client, route, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL)
    SELECT start, start + to_seconds(secs) AS "end", client, route, n, n > quota AS over FROM w, clock WHERE start + to_seconds(secs) <= now - INTERVAL 1 MINUTE""")
def _(v):
    route = F.element_at(F.array(*[F.lit(r) for r in ROUTES]), (C("event_id") % 6 + 1).cast("int"))
    client = F.concat(F.lit("c"), (C("user_id") % 5).cast("string"))
    return J.run_to_table(J.stream_quota_audit(events(v).select(client.alias("client"), route.alias("route"), ts())), "quota")


@query("stream_session_expiry", """g AS (SELECT event_id AS conversation_id, ts FROM events WHERE user_id % 3 = 0)
    SELECT conversation_id, ts + INTERVAL 2 HOUR AS expired_at FROM g
    WHERE date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT max(ts) FROM g) - INTERVAL 2 HOUR""")
def _(v):
    conv = events(v).select(C("event_id").alias("conversation_id"), F.when(C("user_id") % 3 != 0, C("user_id")).alias("user_id"),
                            C("ts").cast("timestamp").alias("created_at"))
    return J.run_to_table(J.stream_session_expiry(conv), "expiry")


@query("stream_retrieval_quality", """l AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CASE WHEN user_id % 7 <> 0 THEN value / 97 END AS s FROM events),
    q AS (SELECT start, CASE WHEN s IS NULL THEN 'none' WHEN s < 0.35 THEN 'weak' ELSE 'good' END AS quality, s FROM l)
    SELECT start, start + INTERVAL 1 HOUR AS "end", quality, CAST(count(*) AS BIGINT) AS n, avg(s) AS avg_top_score FROM q, clock
    GROUP BY 1, 2, 3, now HAVING start + INTERVAL 1 HOUR <= now - INTERVAL 10 MINUTE""", rounded=("avg_top_score",))
def _(v):
    log = events(v).select(C("ts").cast("timestamp").alias("created_at"), F.when(C("user_id") % 7 != 0, C("value") / 97).alias("top_score"))
    return J.run_to_table(J.stream_retrieval_quality(log), "quality")


@query("stream_repeat_suppress", """RECURSIVE e AS (SELECT event_id AS request_id, user_id || '|' || event_type AS key, ts FROM events),
    r AS (SELECT key, min(ts) AS ts FROM e GROUP BY 1 UNION ALL
      SELECT r.key, n.ts FROM r, LATERAL (SELECT min(e.ts) AS ts FROM e WHERE e.key = r.key AND e.ts > r.ts + INTERVAL 1800 SECOND) n WHERE n.ts IS NOT NULL)
    SELECT min(e.request_id) AS request_id, r.key, r.ts FROM r JOIN e ON e.key = r.key AND e.ts = r.ts GROUP BY 2, 3""")
def _(v):
    req = events(v).select(C("event_id").alias("request_id"), F.concat_ws("|", C("user_id").cast("string"), C("event_type")).alias("key"), ts())
    out = J.run_to_table(J.stream_repeat_suppress(req), "repeat")
    return out.withColumn("ts", C("ts").cast("timestamp_ntz"))


@query("repeat_requests", """SELECT event_id, coalesce(ts - max(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
      <= INTERVAL 1800 SECOND, false) AS is_repeat FROM events""")
def _(v):
    """Batch twin of the repeat rule: an identical request came within the TTL before."""
    e = v["events"].select("event_id", "user_id", "event_type", micros(C("ts")).alias("us"))
    prev = scale.carry_last(e, ["user_id", "event_type"], C("us"), C("us"), "prev", 24 * 3_600_000_000)
    return prev.select("event_id", F.coalesce(C("us") - C("prev") <= 1800 * 1_000_000, F.lit(False)).alias("is_repeat"))


def sentence_sql(table: str, key: str) -> str:
    """Sentences of whole texts: cut behind every closing, joined until long enough."""
    abbreviations = ", ".join(f"'{a}'" for a in ABBREVIATIONS)
    strip = r"regexp_replace({0}, '^[\s\v\p{{Z}}]+|[\s\v\p{{Z}}]+$', '', 'g')"
    return rf"""parts AS (SELECT {key}, regexp_extract_all(text, '[^.!?…\n]*(?:[.!?…]+|\n+)|[^.!?…\n]+$') AS s FROM {table} WHERE text IS NOT NULL),
    marked AS (SELECT key, list_transform(range(1, len(s) + 1), lambda i: {{'t': s[i], 'c': CASE regexp_extract(s[i], '([.!?…]+|\n+)$')
        WHEN '' THEN false WHEN '.' THEN NOT (regexp_matches(s[i], '[0-9]\.$') AND i < len(s) AND regexp_matches(s[i + 1], '^[0-9]'))
          AND NOT list_contains([{abbreviations}], lower(regexp_extract(s[i], '(\p{{L}}*)\s*\.$', 1))) ELSE true END, 'o': CAST([] AS VARCHAR[])}}) AS x FROM parts),
    joined AS (SELECT key, list_reduce(list_prepend({{'t': '', 'c': false, 'o': CAST([] AS VARCHAR[])}}, x), lambda acc, y:
        CASE WHEN y.c AND length({strip.format("acc.t || y.t")}) >= {MIN_SENTENCE_CHARS}
          THEN {{'t': '', 'c': false, 'o': list_append(acc.o, {strip.format("acc.t || y.t")})}} ELSE {{'t': acc.t || y.t, 'c': false, 'o': acc.o}} END) AS r FROM marked),
    said AS (SELECT key, CASE WHEN {strip.format("r.t")} = '' THEN r.o ELSE list_append(r.o, {strip.format("r.t")}) END AS o FROM joined)"""


@query("stream_sentences", sentence_sql("conversations", "conv_id * 1000 + turn AS key") + """
    SELECT key AS message_id, CAST(unnest(range(len(o))) AS BIGINT) AS n, unnest(o) AS sentence FROM said""")
def _(v):
    """Tokens dealt over five micro-batches by a hash, so most arrive in another micro-batch than their neighbours."""
    words = F.split(C("text"), "(?<= )")
    # Split before the rows are multiplied: beside a generator, an expression is computed again for every row it makes.
    said = v["conversations"].select((C("conv_id") * 1000 + C("turn")).alias("message_id"), words.alias("words"), F.size(words).alias("k"))
    tokens = said.select("message_id", "k", F.posexplode("words").alias("seq", "delta"))
    tokens = tokens.select("message_id", C("seq").cast("long").alias("seq"), "delta", (C("seq") == C("k") - 1).alias("done"))
    path = scratch_path(v.spark, "sentences")
    J.run_in_parts(tokens, F.pmod(F.xxhash64("message_id", "seq"), F.lit(5)), 5, f"{path}/tokens",
                   lambda stream: J.start_append(J.stream_sentences(stream), f"{path}/data", f"{path}/checkpoint"))
    return v.spark.read.schema(J.SENTENCE).parquet(f"{path}/data").withColumn("n", C("n").cast("long"))


@query("split_sentences", sentence_sql("documents", "doc_id AS key") + """
    SELECT key AS doc_id, CAST(unnest(range(len(o))) AS BIGINT) AS n, unnest(o) AS sentence FROM said""")
def _(v):
    said = v["documents"].select("doc_id", F.posexplode(J.sentences_of("text")).alias("n", "sentence"))
    return said.withColumn("n", C("n").cast("long"))


@query("stream_token_usage", """r AS (SELECT event_id AS request_id, event_type AS provider, ts, CAST(floor(value * 200) AS BIGINT) // 4 + user_id % 5 * 100 AS tokens FROM events),
    u AS (SELECT request_id, provider, ts, CAST(sum(tokens) OVER (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM r)
    SELECT request_id, provider, ts, used, used > 27000 AS over FROM u, clock WHERE time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND <= now - INTERVAL 60 SECOND""")
def _(v):
    tokens = (F.floor(F.floor(C("value") * 200) / 4) + C("user_id") % 5 * 100).cast("long").alias("tokens")
    return J.run_to_table(J.stream_token_usage(events(v).select(C("event_id").alias("request_id"), C("event_type").alias("provider"), ts(), tokens)), "usage")


@query("stream_ingest", """SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || CASE doc_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.docx' ELSE '.txt' END AS file_name,
    CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id % 7 % 5, doc_id) = 1 THEN 'completed' ELSE 'duplicate' END AS ingestion_status,
    true AS chunks_stored FROM documents""")
def _(v):
    """Documents uploaded in five batches; copies of a text meet within a batch and across batches."""
    path = scratch_path(v.spark, "ingest")
    J.run_in_parts(v["documents"], C("doc_id") % 7 % 5, 5, f"{path}/uploads", lambda stream: J.stream_ingest(uploads({"documents": stream}), path))
    documents = v.spark.read.parquet(f"{path}/documents")
    n = v.spark.read.parquet(f"{path}/chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    # A completed document has exactly the chunks it says; a repeated one adds none.
    stored = F.when(C("ingestion_status") == "completed", C("total_chunks") == F.coalesce("n", F.lit(0))).otherwise(C("total_chunks") == 0)
    return documents.join(n, "document_id", "left").select("file_name", "ingestion_status", stored.alias("chunks_stored"))
