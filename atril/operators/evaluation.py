"""Query bank, retrieval and generation scores, suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril.functions import text as tx

# Question types of the bank.
IN_SCOPE = "dentro de alcance"
REFUSAL_TYPES = ["fuera de alcance", "depende de carga"]


def load_gold_bank(rows: DataFrame) -> DataFrame:
    """Seven positional columns to (query_id, category, query_text, query_type, expected)."""
    gid, category, _program, question, _answer, source, kind = rows.columns[:7]
    present = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    kept = rows.where(present(gid) & present(question) & present(kind))
    return kept.select(
        F.col(gid).cast("string").alias("query_id"), F.coalesce(F.col(category), F.lit("")).alias("category"),
        tx.strip(F.col(question)).alias("query_text"), F.lower(tx.strip(F.col(kind))).alias("query_type"),
        F.coalesce(tx.split_doc_refs(F.col(source)), F.array().cast("array<string>")).alias("expected"))


def expected_document_match(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, ref, rank) where the reference and the title contain one another."""
    refs = gold.select("query_id", F.explode(F.array_distinct("expected")).alias("ref"))
    titles = results.select("query_id", "rank", tx.normalize_doc_ref(F.col("document_title")).alias("_title"))
    either = F.contains("ref", "_title") | F.contains("_title", "ref")
    return refs.join(titles, "query_id").where(either).select("query_id", "ref", "rank")


def score_retrieval(gold: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """C21."""
    m = expected_document_match(gold, results).groupBy("query_id").agg(
        F.countDistinct("rank").alias("_hits"), F.countDistinct("ref").alias("_found"), F.min("rank").alias("_first"))
    scored = (F.col("query_type") == IN_SCOPE) & (F.size("expected") > 0)
    j = gold.join(m, "query_id", "left")

    def metric(value):
        return F.when(scored, F.coalesce(value, F.lit(0.0)))

    return j.select(
        "query_id", "query_type",
        metric(F.col("_hits") / F.lit(k)).alias("precision_at_k"),
        metric(F.col("_found") / F.when(F.size("expected") > 0, F.size("expected"))).alias("recall_at_k"),
        metric(1 / F.col("_first")).alias("reciprocal_rank"))


def retrieval_summary(cases: DataFrame, k: int) -> DataFrame:
    """Cases with precision_at_k, recall_at_k, reciprocal_rank, retrieval_ms, error."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.agg(
        F.lit(k).alias("k"),
        F.count("precision_at_k").alias("scored_cases"),
        zero(F.avg("precision_at_k")).alias("mean_precision_at_k"),
        zero(F.avg("recall_at_k")).alias("mean_recall_at_k"),
        zero(F.avg("reciprocal_rank")).alias("mrr"),
        zero(F.avg(F.when(F.col("recall_at_k").isNotNull(), (F.col("recall_at_k") > 0).cast("double")))).alias("hit_rate"),
        zero(F.avg(F.when(F.col("error").isNull(), F.col("retrieval_ms")))).alias("avg_retrieval_ms"),
        F.count("error").alias("error_cases"))


def score_generation(gold: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answers(provider, model, query_id, answer, generation_ms, error),
    verdicts(provider, query_id, hallucinated)."""
    expected = F.col("query_type").isin(*REFUSAL_TYPES)
    failed = F.col("error").isNotNull()
    refused = ~failed & tx.refusal_flag(F.col("answer"))
    clarification = ~failed & tx.clarification_flag(F.col("answer"))
    j = answers.join(gold.select("query_id", "query_type"), "query_id").join(
        verdicts.withColumnRenamed("hallucinated", "_h"), ["provider", "query_id"], "left")
    judged = (F.col("query_type") == IN_SCOPE) & ~refused & ~clarification & ~failed
    return j.select(
        "provider", "model", "query_id", "answer", "generation_ms", "error",
        F.coalesce(refused, F.lit(False)).alias("refused"),
        F.coalesce(clarification, F.lit(False)).alias("clarification"),
        expected.alias("expected_refusal"),
        (~failed & (F.coalesce(refused, F.lit(False)) == expected)).alias("refusal_ok"),
        F.when(judged, F.col("_h")).alias("hallucinated"))


def _rate(part, whole):
    return F.coalesce(F.try_divide(F.count_if(part), F.count_if(whole)), F.lit(0.0))


def generation_summary(cases: DataFrame) -> DataFrame:
    """A16."""
    ok = F.col("error").isNull()
    judged, refusal = ok & F.col("hallucinated").isNotNull(), ok & F.col("expected_refusal")
    return cases.groupBy("provider", "model").agg(
        _rate(judged & F.col("hallucinated"), judged).alias("hallucination_rate"),
        F.count_if(judged).alias("judged_cases"),
        _rate(refusal & F.col("refusal_ok"), refusal).alias("safe_rejection_rate"),
        F.count_if(refusal).alias("refusal_cases"),
        F.coalesce(F.avg(F.when(ok, F.col("generation_ms"))), F.lit(0.0)).alias("avg_generation_ms"),
        F.count_if(~ok).alias("error_cases"))


def _recomputed(cases: DataFrame) -> DataFrame:
    ok = cases.where(F.col("error").isNull())
    return ok.withColumn("_clar", F.coalesce(tx.clarification_flag(F.col("answer")), F.lit(False)))


def generation_stats_recomputed(cases: DataFrame) -> DataFrame:
    """Figures with the clarification flag read again from the answer text."""
    inside = ~F.col("expected_refusal")
    judged = inside & F.col("hallucinated").isNotNull() & ~F.col("_clar")
    return _recomputed(cases).groupBy("provider", "model").agg(
        _rate(judged & F.col("hallucinated"), judged).alias("hallucination_rate"),
        F.count_if(judged).alias("judged_cases"),
        _rate(F.col("expected_refusal") & F.col("refusal_ok"), F.col("expected_refusal")).alias("safe_rejection_rate"),
        F.count_if(inside & F.col("refused")).alias("unexpected_refusal"),
        F.count_if(inside & F.col("_clar")).alias("clarification_triggered"),
        F.count_if(inside & ~F.col("refused") & ~F.col("_clar") & F.col("hallucinated").isNull()).alias("judge_failed"))


def generation_issues(cases: DataFrame) -> DataFrame:
    """A17, the listed cases: one row per (provider, issue, query_id), never one array per provider."""
    inside = ~F.col("expected_refusal")
    issues = F.array_compact(F.array(
        F.when(inside & F.col("refused"), F.lit("unexpected_refusal")),
        F.when(inside & F.col("_clar"), F.lit("clarification_triggered")),
        F.when(inside & ~F.col("refused") & ~F.col("_clar") & F.col("hallucinated").isNull(), F.lit("judge_failed"))))
    return _recomputed(cases).select("provider", "model", F.explode(issues).alias("issue"), "query_id")


def grade_case(cases: DataFrame, retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """C23.

    cases(case_id, answerable, keywords, doc_substring, rag_skipped, must_retrieve),
    retrieval(case_id, quality, titles, retrieval_ms), answers(case_id, answer, sources_cited, generation_ms).
    """
    j = cases.join(retrieval, "case_id", "left").join(answers, "case_id", "left")
    ans, skipped = F.col("answerable"), F.col("rag_skipped")
    quality = F.coalesce("quality", F.lit("none"))
    has_doc = F.exists(
        F.coalesce("titles", F.array().cast("array<string>")),
        lambda t: F.lower(F.coalesce(t, F.lit(""))).contains(F.lower(F.col("doc_substring"))))
    low = F.lower(F.coalesce("answer", F.lit("")))
    missing = F.filter("keywords", lambda k: ~low.contains(F.lower(k)))
    zero = F.coalesce("sources_cited", F.lit(0)) == 0
    retrieval_note = F.when(ans & ~skipped & (quality != "good"), "quality_not_good").when(
        ans & ~skipped & (F.coalesce("doc_substring", F.lit("")) != "") & ~has_doc, "document_missing")
    answer_notes = F.array(
        F.when(ans & (F.size(missing) > 0), "keywords_missing"),
        F.when(ans & (F.size("keywords") > 0) & zero & ~skipped, "no_source_cited"),
        F.when(~ans & ~F.coalesce(tx.refusal_flag(F.col("answer")), F.lit(False)), "refusal_expected"),
        F.when(~ans & ~zero, "sources_on_refusal"))
    skip_notes = F.array(
        F.when(skipped & ~zero, "retrieval_not_skipped"),
        F.when(~skipped & F.col("must_retrieve") & zero, "retrieval_skipped"))
    notes = F.array_compact(F.concat(F.array(retrieval_note), answer_notes, skip_notes))
    out = j.select(
        "case_id", "retrieval_ms", "generation_ms", retrieval_note.isNull().alias("retrieval_ok"),
        (F.size(F.array_compact(answer_notes)) == 0).alias("answer_ok"),
        (F.size(F.array_compact(skip_notes)) == 0).alias("skip_ok"), notes.alias("notes"))
    return out.withColumn("passed", F.col("retrieval_ok") & F.col("answer_ok") & F.col("skip_ok"))


def suite_summary(graded: DataFrame) -> DataFrame:
    """A18."""
    return graded.agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg("retrieval_ms"), F.lit(0.0)).alias("avg_retrieval_ms"),
        F.coalesce(F.avg("generation_ms"), F.lit(0.0)).alias("avg_generation_ms"),
        F.count_if("retrieval_ok").alias("retrieval_passed"), F.count_if("answer_ok").alias("answer_passed"),
        F.count_if("skip_ok").alias("skip_passed"))
