"""Program aliases, program filter, ambiguity and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril import settings as S
from atril.functions import text as tx

# Fixed value: the line that introduces a programme's second name.
ALIAS_LINE = "(?iu)Primer ciclo de formaci[oó]n\\s*:\\s*([^—(\\n]+)"


def program_aliases(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """C14: (alias, program); several programs for one alias resolve to the smallest."""
    named = chunks.withColumn("alias", tx.strip(F.regexp_extract("content", ALIAS_LINE, 1))).where(F.col("alias") != "")
    tagged = docs.where(F.col("program") != "").select("document_id", "program")
    return named.select("document_id", "alias").join(tagged, "document_id").groupBy("alias").agg(
        F.min("program").alias("program"))


def detect_program_filter(queries: DataFrame, programs: DataFrame, aliases: DataFrame) -> DataFrame:
    """The one program a topic question fully names, else NULL.

    A fully named program has all its words in the question, so questions and
    programs meet on one word per program (its longest) and the rest is verified in
    the join; no question is paired with every program.
    """
    names = programs.select(F.col("program").alias("name"), "program").unionByName(
        aliases.select(F.col("alias").alias("name"), "program"))
    words = tx.significant_words(F.col("name"))
    longest = F.array_max(F.transform("_nw", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    names = names.where(F.col("name") != "").withColumn("_nw", words).where(F.size("_nw") > 0)
    names = names.select("program", "_nw", longest["w"].alias("_word"))
    asked = queries.where(tx.varying_topic(F.col("query_text"))).select(
        "query_id", tx.significant_words(F.col("query_text")).alias("_qw"))
    met = asked.select("query_id", "_qw", F.explode("_qw").alias("_word")).join(names, "_word").where(
        tx.is_subset(F.col("_nw"), F.col("_qw")))
    only = met.groupBy("query_id").agg(F.min("program").alias("program"), F.max("program").alias("_last")).where(
        F.col("program") == F.col("_last")).select("query_id", F.col("program").alias("program_filter"))
    return queries.select("query_id").join(only, "query_id", "left")


def detect_ambiguity(
    queries: DataFrame, results: DataFrame, quality: DataFrame, margin: float = S.AMBIGUITY_MARGIN
) -> DataFrame:
    """(query_id, entity_type, candidates) for questions that need a clarification."""
    asked = queries.where(tx.varying_topic(F.col("query_text"))).join(
        quality.where(F.col("quality") == "good").select("query_id"), "query_id", "left_semi"
    ).select("query_id", tx.significant_words(F.col("query_text")).alias("_qw"))
    long = results.select("query_id", "score", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("program", "faculty")])).alias("e"))
    best = long.select("query_id", "score", "e.*").groupBy("query_id", "kind", "name").agg(F.max("score").alias("best"))
    top = results.groupBy("query_id").agg(F.max("score").alias("_top"))
    named = best.where(F.col("name") != "").join(top, "query_id").join(asked, "query_id")
    close = F.col("_top") - F.col("best") <= margin
    mentioned = tx.words_mention(F.col("_qw"), tx.significant_words(F.col("name")))
    named = named.select("query_id", "kind", "name", close.alias("close"), mentioned.alias("mentioned"))

    def names(kind):
        return F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("close"), F.col("name")))).alias(f"_{kind}s")

    def said(kind, among):
        return F.coalesce(F.bool_or((F.col("kind") == kind) & among & F.col("mentioned")), F.lit(False))

    g = named.groupBy("query_id").agg(
        names("program"), names("faculty"),
        said("program", F.col("close")).alias("_p_close"), said("program", F.lit(True)).alias("_p_any"),
        said("faculty", F.col("close")).alias("_f_close"))
    by_program = (F.size("_programs") >= 2) & ~F.col("_p_close")
    by_faculty = (F.size("_facultys") >= 2) & ~F.col("_f_close") & ~F.col("_p_any")
    return g.where(by_program | by_faculty).select(
        "query_id", F.when(by_program, "program").otherwise("faculty").alias("entity_type"),
        F.when(by_program, F.col("_programs")).otherwise(F.col("_facultys")).alias("candidates"))


def route_turns(turns: DataFrame, cache: DataFrame, ambiguity: DataFrame, quality: DataFrame) -> DataFrame:
    """turns(query_id, query_text, is_followup) labelled by how they are answered."""
    hit = cache.where(F.col("outcome") == "hit").select("query_id", F.lit(True).alias("_hit"))
    unclear = ambiguity.select("query_id", F.lit(True).alias("_unclear"))
    j = turns.join(hit, "query_id", "left").join(unclear, "query_id", "left").join(
        quality.select("query_id", "quality"), "query_id", "left")
    greeting = tx.is_greeting(F.col("query_text"))
    route = (
        F.when(F.col("_hit"), "cached").when(greeting, "greeting")
        .when(F.coalesce("_unclear", F.lit(False)) & ~F.col("is_followup"), "clarification")
        .when(F.coalesce("quality", F.lit("none")) != "good", "refusal").otherwise("answer"))
    return j.select("query_id", route.alias("route"))
