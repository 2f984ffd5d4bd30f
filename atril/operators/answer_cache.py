"""Semantic answer reuse."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atril import settings as S
from atril.functions import text as tx
from atril.operators import retrieval as R
from atril.operators.rows import micros, newest_n_cap
from atril.session import materialise


def semester_guard(query: Column, cached_question: Column) -> Column:
    """C11."""
    mine, theirs = tx.semester_reference(query), tx.semester_reference(cached_question)
    return mine.isNull() | theirs.isNull() | (mine == theirs)


def _single_value_words(sources: Column, field: str) -> Column:
    values = F.array_distinct(F.filter(F.transform(sources, lambda s: s[field]), lambda x: x != ""))
    value = F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1)))
    return F.coalesce(tx.significant_words(value), F.array().cast("array<string>"))


def entity_guard(sources: Column, cached_question: Column, query: Column) -> Column:
    """The question must share a word with the one program, and with the one
    faculty, the cached sources are about; with neither to go by, with their one title."""
    asked = tx.significant_words(query)
    program, faculty = _single_value_words(sources, "program"), _single_value_words(sources, "faculty")
    title = _single_value_words(sources, "document_title")

    def clashes(words: Column) -> Column:
        return (F.size(words) > 0) & ~F.arrays_overlap(words, asked)

    same_question = (F.size(asked) > 0) & tx.is_subset(asked, tx.significant_words(cached_question))
    no_field = (F.size(program) == 0) & (F.size(faculty) == 0)
    rejected = clashes(program) | clashes(faculty) | (no_field & ~same_question & clashes(title))
    return ~F.coalesce(rejected, F.lit(False))


def answer_cache_lookup(
    queries: DataFrame, entries: DataFrame, now: dt.datetime,
    threshold: float = S.CACHE_THRESHOLD, ttl_seconds: int = S.CACHE_TTL_SECONDS,
) -> DataFrame:
    """Outcome per query from its single best live entry; newest wins a tie, and a
    rejected best entry is not replaced by the second best."""
    age = F.lit(now) - F.col("ts")
    live = entries.where(age <= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))
    newest_first = F.concat(
        F.lpad((F.lit(9_000_000_000_000_000_000) - micros(F.col("ts"))).cast("string"), 19, "0"),
        F.lit(":"), F.col("entry_id").cast("string"))
    live = live.withColumn("chunk_id", newest_first)
    # At most one narrow row per question, written down so that the planner knows its size when it meets the entries' texts.
    best = materialise(R.vector_topk(queries, live.select("chunk_id", "embedding"), 1, 1e-8), "best-entries")
    found = live.select(
        "chunk_id", "entry_id", F.col("question").alias("cached_question"), "answer", "sources"
    ).join(best, "chunk_id").drop("chunk_id", "rn")
    j = queries.select("query_id", "query_text").join(found, "query_id", "left")
    guarded = F.col("query_text") != ""
    outcome = (
        F.when(F.col("score").isNull(), "empty")
        .when(F.col("score") < threshold, "below_threshold")
        .when(guarded & ~semester_guard(F.col("query_text"), F.col("cached_question")), "semester_rejected")
        .when(guarded & ~entity_guard(F.col("sources"), F.col("cached_question"), F.col("query_text")), "entity_rejected")
        .otherwise("hit"))
    return j.select("query_id", outcome.alias("outcome"), "score", "entry_id",
                    F.when(outcome == "hit", F.col("answer")).alias("answer"))


def cache_admission(turns: DataFrame, documents: DataFrame, capacity: int = S.CACHE_CAPACITY) -> DataFrame:
    """Turns whose answer may be reused; any later document change clears them."""
    ok = turns.where(
        (F.col("quality") == "good") & (tx.strip(F.col("answer")) != "") & F.col("embedding").isNotNull()
        & F.coalesce(F.col("verification_approved"), F.lit(True)))
    changed = documents.agg(F.max("updated_at")).scalar()
    fresh = ok.where(changed.isNull() | (F.col("ts") > changed))
    return newest_n_cap(fresh, capacity)
