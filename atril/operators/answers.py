"""Context assembly, cited sources, judging and verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atril import settings as S
from atril.functions import text as tx


def assemble_context(results: DataFrame) -> DataFrame:
    """C17: numbered blocks in rank order and the numbered source list, per query."""
    item = F.struct("rank", "document_title", "content", "chunk_id", "score", "program", "faculty")
    g = results.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("i"))
    block = F.transform("i", lambda r, n: F.concat(
        F.lit("["), (n + 1).cast("string"), F.lit("] "), r["document_title"], F.lit("\n"), r["content"]))
    sources = F.transform("i", lambda r, n: F.struct(
        (n + 1).cast("int").alias("citation_number"), r["chunk_id"].alias("chunk_id"),
        r["document_title"].alias("document_title"), F.substring(r["content"], 1, 200).alias("content_preview"),
        r["score"].alias("score"), r["program"].alias("program"), r["faculty"].alias("faculty")))
    return g.select("query_id", F.array_join(block, S.BLOCK_SEPARATOR).alias("context"), sources.alias("sources"))


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of `sources` (numbered 1..n per answer) the answer cites; none for a refusal."""
    cited = answers.where(~tx.refusal_flag(F.col("answer"))).select(
        "answer_id", F.explode(tx.citations(F.col("answer"))).alias("citation_number"))
    return sources.join(cited, ["answer_id", "citation_number"], "left_semi")


def judge_answers(rows: DataFrame, judge_fn) -> DataFrame:
    """Adds `judge_output` and `hallucinated`.

    `judge_fn(questions, contexts, answers)` returns one text per row.  A failing
    batch is retried row by row; a failing row gives NULL and is left out of rates.
    """

    @F.pandas_udf(T.StringType())
    def judged(question: pd.Series, context: pd.Series, answer: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(judge_fn(list(question), list(context), list(answer))))
        except Exception:
            def one(q, c, a):
                try:
                    return judge_fn([q], [c], [a])[0]
                except Exception:
                    return None

            return pd.Series([one(*r) for r in zip(question, context, answer)])

    cut = F.substring("context", 1, S.GRADING_CONTEXT_CHARS)
    out = rows.withColumn("judge_output", judged("question", cut, "answer"))
    return out.withColumn("hallucinated", tx.verdict(F.col("judge_output"))["hallucinated"])


def lexical_judge(rows: DataFrame, min_share: float = 0.5) -> DataFrame:
    """C24 offline default: an answer is hallucinated when fewer than `min_share` of the
    numbers and codes it states occur in its context."""
    def codes(c):
        return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]*\\p{N}[\\p{L}\\p{N}_]*"), F.lit(0)))

    stated, known = codes(F.col("answer")), codes(F.substring("context", 1, S.GRADING_CONTEXT_CHARS))
    share = F.when(F.size(stated) > 0, F.size(F.array_intersect(stated, known)) / F.size(stated)).otherwise(F.lit(1.0))
    return rows.withColumn("grounded_share", share).withColumn("hallucinated", F.col("grounded_share") < min_share)


def verification_outcome(attempts: DataFrame, max_attempts: int = S.VERIFICATION_MAX_ATTEMPTS) -> DataFrame:
    """Per turn the attempts used, whether one was approved, the reason attached to
    the last one, and what is served."""
    v = tx.verdict(F.col("grader_output"))
    is_refusal = tx.refusal_flag(F.col("draft"))
    approved = is_refusal | ~F.coalesce(v["rejected"], F.lit(False))
    a = attempts.where(F.col("attempt") <= max_attempts).select(
        "turn_id", "attempt", approved.alias("ok"),
        F.struct("attempt", "draft", F.when(~is_refusal, v["reason"]).alias("reason")).alias("try"))
    g = a.groupBy("turn_id").agg(
        F.min_by("try", F.when(F.col("ok"), F.col("attempt"))).alias("good"),
        F.max_by("try", "attempt").alias("last"), F.bool_or("ok").alias("approved"))
    final = F.when(F.col("approved"), F.col("good")).otherwise(F.col("last"))
    return g.select(
        "turn_id", final["attempt"].alias("attempts"), "approved", final["reason"].alias("reason"),
        F.when(F.col("approved"), final["draft"]).otherwise(F.lit(S.REFUSAL_MARKER)).alias("served"))
