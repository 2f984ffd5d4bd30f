"""Structured Streaming jobs (survey ids ST1-ST8).

Late rows: each windowed job drops rows older than its watermark; the delay is a
parameter.  All sinks are append-only tables, so a job restarted from its
checkpoint continues without loss or repetition.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from atril import settings as S
from atril.functions.sentences import Assembler, split_sentences
from atril.functions.text import content_hash
from atril.operators.ingest import ingest_documents
from atril.session import materialise, scratch_path

# Declared quotas as route -> (requests, seconds).
QUOTAS = {
    "chat": (20, 60), "upload": (20, 3600), "register": (5, 3600),
    "login": (10, 300), "forgot": (3, 3600), "reset": (10, 3600),
}


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def start_append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available and return the sink as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = start_append(stream, f"{path}/data", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_in_parts(df: DataFrame, part: Column, parts: int, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """`df` as a stream of `parts` micro-batches, the rows where `part` is 0, 1 and so on: each is written by as many tasks as
    hold its rows and then taken by a run of its own, which goes on from the checkpoint of the run before."""
    for k in range(parts):
        df.where(part == k).write.mode("append").parquet(folder)
        start(df.sparkSession.readStream.schema(df.schema).parquet(folder)).awaitTermination()


def _plain_window(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").cast("timestamp_ntz").alias("start"),
        F.col("window.end").cast("timestamp_ntz").alias("end"), *rest)


def stream_ingest(
    files: DataFrame, path: str, embed_fn: Callable | None = None, available_now: bool = True
) -> StreamingQuery:
    """ST1: every micro-batch of files goes through the ingestion pipeline.

    The content hashes met so far are keyed state of the stream, so a batch reads its own files only, however long
    the history is.  A hash new to the state comes with the batch it is new in; other files of that batch repeat earlier
    content (whether that could be read or not: the same bytes fail the same way).  A batch writes to its own partition
    in overwrite mode, so a replayed batch leaves the same tables.
    """
    kwargs = {} if embed_fn is None else {"embed_fn": embed_fn}
    columns = [F.col("content")] + ([F.col("decoded").cast("binary")] if "decoded" in files.columns else [])
    hashed = files.select(F.struct(*files.columns).alias("file"), content_hash(F.coalesce(*columns)).alias("hash"))
    fresh = hashed.select("hash").where("hash IS NOT NULL").dropDuplicates(["hash"])
    both = hashed.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)), allowMissingColumns=True)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = materialise(batch, "batch")
        mine = rows.where("NOT fresh")
        seen = mine.select("hash").where("hash IS NOT NULL").distinct().join(rows.where("fresh").select("hash"), "hash", "left_anti")
        known = seen.select(F.col("hash").alias("content_hash"), F.lit("completed").alias("ingestion_status"))
        documents, chunks = ingest_documents(mine.select("file.*"), known, **kwargs)
        documents.write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")

    writer = both.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


_ADMITTED = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType())])


#: Keys of a stream are dealt to so many groups, each with one state and one Python call a micro-batch; a call for every
#: key costs about a millisecond.
STATE_GROUPS = 1024
_HELD = T.StructType([T.StructField("held", T.StringType())])
_NO_TIME = int(np.datetime64("NaT").astype("int64"))


def _group(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(STATE_GROUPS))


def stream_repeat_suppress(requests: DataFrame, ttl_seconds: int = S.RETRIEVAL_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """ST2: requests(request_id, key, ts) that are not repeats.

    A request repeats when the last admitted one with its key is at most the TTL older; a
    repeat does not renew the TTL.  State is one time per key, dropped once the watermark
    passes its end; the keys of a hash share a group.
    """
    ttl = ttl_seconds * 1_000_000

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {k: t for k, t in json.loads(state.get[0])} if state.exists else {}
        kept = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
            admitted = []
            for k, t in zip(rows["key"].tolist(), rows["ts"].to_numpy("datetime64[us]").astype("int64").tolist()):
                k = k if isinstance(k, str) else None
                fresh = k not in last or t != _NO_TIME and t - last[k] > ttl
                if fresh:
                    last[k] = t
                admitted.append(fresh)
            kept = [rows.loc[np.array(admitted, bool), ["request_id", "key", "ts"]]]
        now = state.getCurrentWatermarkMs()
        last = {k: t for k, t in last.items() if (t + ttl) // 1000 >= now}
        if last:
            state.update((json.dumps(list(last.items())),))
            state.setTimeoutTimestamp(max((min(last.values()) + ttl) // 1000, now + 1))
        elif state.exists:
            state.remove()
        yield from kept

    grouped = requests.select("request_id", "key", "ts", _group("key").alias("group")).withWatermark("ts", delay).groupBy("group")
    return grouped.applyInPandasWithState(
        admit, _ADMITTED, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def stream_daily_activity(conversations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST3: closed UTC days with their number of conversations."""
    counts = conversations.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day")).agg(
        F.count(F.lit(1)).alias("count"))
    return _plain_window(counts)


def stream_token_budget(
    requests: DataFrame, budget: int = S.TOKEN_BUDGET, width: str = "60 seconds", slide: str = "10 seconds", delay: str = "1 minute"
) -> DataFrame:
    """ST4: tokens per provider in sliding windows (an approximation of the per-request frame)."""
    used = requests.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "provider").agg(
        F.sum("tokens").alias("used"))
    return _plain_window(used).withColumn("over", F.col("used") > budget)


def stream_token_usage(
    requests: DataFrame, budget: int = S.TOKEN_BUDGET, width_s: int = S.TOKEN_WINDOW_SECONDS, delay_s: int = 60
) -> DataFrame:
    """ST4, exact: per request(request_id, provider, ts, tokens) the tokens its provider used in the trailing `width_s`
    seconds, the request itself and both ends included.

    Time is cut into ranges of the window's length; a request is kept in its own range and, as context, in the next, so
    every (provider, range) is complete by itself and a busy provider is spread over as many tasks as it has
    ranges.  The watermark of `delay_s` seconds closes a range and drops its state.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def trailing(times: pd.Series, tokens: pd.Series) -> pd.Series:
        def one(at: np.ndarray, used: np.ndarray) -> np.ndarray:
            order = np.argsort(at, kind="stable")
            total = np.concatenate([[0], np.cumsum(used[order])])
            ranks = np.searchsorted(at[order], at - width_s * 1_000_000, "left"), np.searchsorted(at[order], at, "right")
            return total[ranks[1]] - total[ranks[0]]

        return pd.Series([one(np.asarray(a), np.asarray(u)) for a, u in zip(times, tokens)])

    width = F.make_dt_interval(secs=F.lit(width_s))
    twice = requests.select("request_id", "provider", "ts", "tokens", F.explode(F.array(F.lit(False), F.lit(True))).alias("context"))
    ranged = twice.withColumn("clock", F.when(F.col("context"), F.col("ts") + width).otherwise(F.col("ts")))
    # The context copies move the clock ahead by one width, so the delay takes it back.
    held = ranged.withWatermark("clock", f"{delay_s + width_s} seconds").groupBy(F.window("clock", f"{width_s} seconds"), "provider").agg(
        F.collect_list(F.struct("request_id", "ts", "tokens", "context")).alias("items"))
    used = trailing(F.transform("items", lambda i: F.unix_micros(i["ts"])), F.transform("items", lambda i: i["tokens"]))
    each = held.select("provider", F.explode(F.arrays_zip("items", used.alias("used"))).alias("x")).where("NOT x.items.context")
    return each.select(
        "x.items.request_id", "provider", F.col("x.items.ts").cast("timestamp_ntz").alias("ts"), "x.used", (F.col("x.used") > budget).alias("over"))


def stream_quota_audit(requests: DataFrame, quotas: dict[str, tuple[int, int]] = QUOTAS, delay: str = "1 minute") -> DataFrame:
    """ST5: requests(client, route, ts) counted per declared window; reports, never blocks.

    One windowed count per distinct window length; the handful of limits is a literal map.
    """
    limits = F.create_map(*[F.lit(x) for route, (n, _) in quotas.items() for x in (route, n)])
    marked = requests.withWatermark("ts", delay)
    parts = []
    for seconds in sorted({s for _, s in quotas.values()}):
        routes = [r for r, (_, s) in quotas.items() if s == seconds]
        counted = marked.where(F.col("route").isin(*routes)).groupBy(
            F.window("ts", f"{seconds} seconds"), "client", "route").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_plain_window(counted))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("over", F.col("n") > F.element_at(limits, F.col("route")))


def stream_session_expiry(conversations: DataFrame, ttl: str = "2 hours") -> DataFrame:
    """ST6: guest conversations once the stream's clock is `ttl` past the second of their creation.

    The watermark is the newest creation time less the TTL.  State is one creation time per waiting conversation
    (and second), dropped when the watermark passes it; the conversations of a hash share a group.  One that has already
    passed on arrival, however late, is reported with its micro-batch.  Every row goes out twice for that: one copy moves
    the clock and ends there, the other carries no event time, as Spark drops rows whose event time is behind the watermark.
    """
    guests = conversations.where("user_id IS NULL AND created_at IS NOT NULL")
    twice = guests.select(F.col("conversation_id").cast("string").alias("id"), F.unix_micros("created_at").alias("created"),
                          F.explode(F.array(F.col("created_at"), F.lit(None).cast("timestamp"))).alias("clock"))
    waiting = twice.withColumn("group", _group("id")).withWatermark("clock", ttl).where("clock IS NULL")

    def expire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first: dict[tuple, int] = {}
        held = [json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            held += [zip(f["id"].tolist(), f["created"].tolist()) for f in frames]
        for rows in held:
            for name, created in rows:
                at = (name if isinstance(name, str) else None, created // 1_000_000)
                first[at] = min(created, first.get(at, created))
        now = state.getCurrentWatermarkMs()
        gone, wait, end = [], [], 0
        for (name, second), created in first.items():
            if (second + 1) * 1000 <= now:
                gone.append((name, created))
            else:
                wait.append((name, created))
                end = min(end, second) if len(wait) > 1 else second
        if wait:
            state.update((json.dumps(wait),))
            state.setTimeoutTimestamp((end + 1) * 1000 - 1)  # fires once the watermark is above it
        elif state.exists:
            state.remove()
        if gone:
            yield pd.DataFrame({"id": pd.Series([name for name, _ in gone], dtype=object), "created": [created for _, created in gone]})

    gone = waiting.groupBy("group").applyInPandasWithState(
        expire, T.StructType([T.StructField("id", T.StringType()), T.StructField("created", T.LongType())]), _HELD,
        "append", GroupStateTimeout.EventTimeTimeout)
    return gone.select(F.col("id").cast(conversations.schema["conversation_id"].dataType).alias("conversation_id"),
                       (F.timestamp_micros("created") + F.expr(f"INTERVAL {ttl}")).cast("timestamp_ntz").alias("expired_at"))


SENTENCE = T.StructType([
    T.StructField("message_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sentence", T.StringType())])


def _assemble(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # Of every open message: pending text, open span, sentences given out, next token, tokens that came early.
    open_ = {m: (pending, hidden, n, expected, {seq: (delta, last) for seq, delta, last in early})
             for m, pending, hidden, n, expected, early in (json.loads(state.get[0]) if state.exists else [])}
    touched = {}
    for rows in frames:
        for m, seq, delta, last in zip(*(rows[c].tolist() for c in ("message_id", "seq", "delta", "done"))):
            m = m if isinstance(m, str) else None
            if m not in open_:
                open_[m] = ("", False, 0, 0, {})
            touched[m] = True
            if seq >= open_[m][3]:
                open_[m][4].setdefault(seq, (delta, bool(last)))
    ids, places, out = [], [], []
    for m in touched:
        pending, hidden, n, expected, waiting = open_[m]
        a, sentences, done = Assembler(pending, hidden), [], False
        while expected in waiting and not done:
            delta, done = waiting.pop(expected)
            expected += 1
            sentences += a.feed(delta) + (a.flush() if done else [])
        ids += [m] * len(sentences)
        places += range(n, n + len(sentences))
        out += sentences
        if done:
            del open_[m]
        else:
            open_[m] = (a.pending, a.hidden, n + len(sentences), expected, waiting)
    if open_:
        state.update((json.dumps([(m, *rest, [(seq, *token) for seq, token in sorted(waiting.items())]) for m, (*rest, waiting) in open_.items()]),))
    elif state.exists:
        state.remove()
    if ids:
        yield pd.DataFrame({"message_id": ids, "n": np.array(places, "int32"), "sentence": out})


def stream_sentences(tokens: DataFrame) -> DataFrame:
    """ST7: tokens(message_id, seq, delta, done) to completed sentences.

    `seq` counts the tokens of a message from 0.  A token that arrives before its turn, in the same micro-batch or an
    earlier one, waits in the state until those before it have come; one that comes twice counts once.  The open messages
    of a hash share a group.
    """
    named = tokens.select(F.col("message_id").cast("string").alias("message_id"), "seq", "delta", "done", _group("message_id").alias("group"))
    said = named.groupBy("group").applyInPandasWithState(
        _assemble, "message_id string, n int, sentence string", _HELD, "append", GroupStateTimeout.NoTimeout)
    return said.withColumn("message_id", F.col("message_id").cast("long"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences_of(texts: pd.Series) -> pd.Series:
    """ST7, batch twin: sentences of complete texts."""
    return texts.map(lambda t: None if t is None else split_sentences(t))


def stream_retrieval_quality(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes", threshold: float = S.SCORE_THRESHOLD) -> DataFrame:
    """ST8: retrieval log rows per window and quality label with their mean top score."""
    label = F.when(F.col("top_score").isNull(), "none").when(F.col("top_score") < threshold, "weak").otherwise("good")
    counts = log.withWatermark("created_at", delay).groupBy(
        F.window("created_at", width), label.alias("quality")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("top_score").alias("avg_top_score"))
    return _plain_window(counts)
