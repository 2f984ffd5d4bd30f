"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.operators import evaluation as E
from atril.operators import retrieval as R
from atril.plans.registry import query
from atril.plans.text_queries import REFS, strip_sql

C = F.col


@query("load_gold_bank", rf"""WITH bank AS (SELECT CASE WHEN doc_id % 9 <> 0 THEN doc_id END AS gid, lang, text, {REFS} AS refs,
      CASE doc_id % 3 WHEN 0 THEN ' Dentro de Alcance ' WHEN 1 THEN 'FUERA de alcance' ELSE '' END AS kind FROM documents)
    SELECT CAST(gid AS VARCHAR) AS query_id, lang AS category, {strip_sql('text')} AS query_text, lower(trim(kind)) AS query_type, '3' AS n_expected
    FROM bank WHERE gid IS NOT NULL AND text <> '' AND kind <> ''""".replace("'3' AS n_expected", "CAST(2 AS BIGINT) AS n_expected"))
def _(v):
    refs = F.concat(C("source"), F.lit(".xlsx; Sitio Web / "), F.upper("lang"),
                    F.lit("_Guía.PDF (verificar nota); por verificar;"), C("source"), F.lit(".docx.pdf"))
    kind = F.when(C("doc_id") % 3 == 0, " Dentro de Alcance ").when(C("doc_id") % 3 == 1, "FUERA de alcance").otherwise("")
    rows = v["documents"].select(
        F.when(C("doc_id") % 9 != 0, C("doc_id")).alias("ID"), C("lang").alias("Categoria"), C("source").alias("Programa"),
        C("text").alias("Consulta"), F.lit("").alias("Respuesta"), refs.alias("Fuente"), kind.alias("Tipo"))
    out = E.load_gold_bank(rows)
    return out.select("query_id", "category", "query_text", "query_type",
                      (F.size("expected") - 1).cast("long").alias("n_expected"))


MATCH = """refs AS (SELECT query_id, unnest([ref1, ref2]) AS ref FROM gold),
    m AS (SELECT r.query_id, r.ref, t.rank FROM refs r JOIN retrieved t USING (query_id) WHERE contains(r.ref, t.document_title) OR contains(t.document_title, r.ref))"""
SCORED = MATCH + """, h AS (SELECT query_id, count(DISTINCT rank) AS hits, count(DISTINCT ref) AS found, min(rank) AS first FROM m GROUP BY 1),
    cases AS (SELECT g.query_id, g.query_type, CASE WHEN query_type = 'dentro de alcance' THEN coalesce(hits, 0)::DOUBLE / 5 END AS precision_at_k,
      CASE WHEN query_type = 'dentro de alcance' THEN coalesce(found, 0)::DOUBLE / 2 END AS recall_at_k,
      CASE WHEN query_type = 'dentro de alcance' THEN coalesce(1.0::DOUBLE / first, 0) END AS reciprocal_rank FROM gold g LEFT JOIN h USING (query_id))"""


def gold(v):
    return v["gold"].select("query_id", "query_type", F.array("ref1", "ref2").alias("expected"))


@query("expected_document_match", MATCH + " SELECT query_id, ref, CAST(rank AS BIGINT) AS rank FROM m")
def _(v):
    return E.expected_document_match(gold(v), v["retrieved"]).withColumn("rank", C("rank").cast("long"))


@query("score_retrieval", SCORED + " SELECT * FROM cases", rounded=('precision_at_k', 'recall_at_k', 'reciprocal_rank'))
def _(v):
    return E.score_retrieval(gold(v), v["retrieved"], 5)


@query("retrieval_summary", SCORED + """ SELECT CAST(5 AS BIGINT) AS k, CAST(count(precision_at_k) AS BIGINT) AS scored_cases, avg(precision_at_k) AS mean_precision_at_k,
    avg(recall_at_k) AS mean_recall_at_k, avg(reciprocal_rank) AS mrr, avg(CASE WHEN recall_at_k IS NOT NULL THEN CAST(recall_at_k > 0 AS INTEGER) END)::DOUBLE AS hit_rate,
    avg(CASE WHEN query_id % 11 <> 0 THEN query_id % 500 END)::DOUBLE AS avg_retrieval_ms, CAST(count(*) FILTER (WHERE query_id % 11 = 0) AS BIGINT) AS error_cases FROM cases""", rounded=('mean_precision_at_k', 'mean_recall_at_k', 'mrr', 'hit_rate', 'avg_retrieval_ms'))
def _(v):
    cases = E.score_retrieval(gold(v), v["retrieved"], 5).withColumns({
        "retrieval_ms": C("query_id") % 500, "error": F.when(C("query_id") % 11 == 0, "timeout")})
    return E.retrieval_summary(cases, 5).withColumn("k", C("k").cast("long"))


GENERATED = """cases AS (SELECT a.provider, a.model, a.query_id, a.answer, a.generation_ms, a.error,
      coalesce(contains(a.answer, 'No tengo esa información'), false) AS refused, coalesce(contains(a.answer, 'Tu pregunta puede aplicar a varios'), false) AS clarification,
      g.query_type <> 'dentro de alcance' AS expected_refusal,
      a.error IS NULL AND coalesce(contains(a.answer, 'No tengo esa información'), false) = (g.query_type <> 'dentro de alcance') AS refusal_ok,
      CASE WHEN g.query_type = 'dentro de alcance' AND a.error IS NULL AND NOT contains(a.answer, 'No tengo esa información')
        AND NOT contains(a.answer, 'Tu pregunta puede aplicar a varios') THEN a.judged END AS hallucinated
      FROM generated a JOIN gold g USING (query_id))"""


def generation_cases(v):
    a = v["generated"]
    verdicts = a.select("provider", "query_id", C("judged").alias("hallucinated"))
    return E.score_generation(gold(v), a.drop("judged"), verdicts)


@query("score_generation", GENERATED + " SELECT * FROM cases")
def _(v):
    return generation_cases(v)


@query("generation_summary", GENERATED + """ SELECT provider, model, count(*) FILTER (WHERE hallucinated)::DOUBLE / count(hallucinated) AS hallucination_rate,
    CAST(count(hallucinated) AS BIGINT) AS judged_cases,
    count(*) FILTER (WHERE expected_refusal AND refusal_ok AND error IS NULL)::DOUBLE / count(*) FILTER (WHERE expected_refusal AND error IS NULL) AS safe_rejection_rate,
    CAST(count(*) FILTER (WHERE expected_refusal AND error IS NULL) AS BIGINT) AS refusal_cases,
    avg(generation_ms) FILTER (WHERE error IS NULL) AS avg_generation_ms, CAST(count(error) AS BIGINT) AS error_cases FROM cases GROUP BY 1, 2""", rounded=('hallucination_rate', 'safe_rejection_rate', 'avg_generation_ms'))
def _(v):
    return E.generation_summary(generation_cases(v))


# Stored runs may carry a verdict for a clarification: the figures must leave it out.
STALE = GENERATED + """, stale AS (SELECT * REPLACE (CASE WHEN clarification THEN true ELSE hallucinated END AS hallucinated) FROM cases WHERE error IS NULL)"""


def stale_cases(v):
    return generation_cases(v).withColumn("hallucinated", F.when(C("clarification"), True).otherwise(C("hallucinated")))


@query("generation_stats_recomputed", STALE + """ SELECT provider, model,
    count(*) FILTER (WHERE hallucinated AND NOT expected_refusal AND NOT clarification)::DOUBLE
      / count(*) FILTER (WHERE hallucinated IS NOT NULL AND NOT expected_refusal AND NOT clarification) AS hallucination_rate,
    CAST(count(*) FILTER (WHERE hallucinated IS NOT NULL AND NOT expected_refusal AND NOT clarification) AS BIGINT) AS judged_cases,
    count(*) FILTER (WHERE expected_refusal AND refusal_ok)::DOUBLE / count(*) FILTER (WHERE expected_refusal) AS safe_rejection_rate,
    CAST(count(*) FILTER (WHERE NOT expected_refusal AND refused) AS BIGINT) AS unexpected_refusal,
    CAST(count(*) FILTER (WHERE NOT expected_refusal AND clarification) AS BIGINT) AS clarification_triggered,
    CAST(count(*) FILTER (WHERE NOT expected_refusal AND NOT refused AND NOT clarification AND hallucinated IS NULL) AS BIGINT) AS judge_failed
    FROM stale GROUP BY 1, 2""", rounded=('hallucination_rate', 'safe_rejection_rate'))
def _(v):
    return E.generation_stats_recomputed(stale_cases(v))


@query("generation_issues", STALE + """ SELECT provider, model, 'unexpected_refusal' AS issue, query_id FROM stale WHERE NOT expected_refusal AND refused
    UNION ALL SELECT provider, model, 'clarification_triggered', query_id FROM stale WHERE NOT expected_refusal AND clarification
    UNION ALL SELECT provider, model, 'judge_failed', query_id FROM stale WHERE NOT expected_refusal AND NOT refused AND NOT clarification AND hallucinated IS NULL""")
def _(v):
    return E.generation_issues(stale_cases(v))


GRADED = """r AS (SELECT query_id, min_by(score, rank) AS s, string_agg(document_title, '|') AS titles FROM retrieved GROUP BY 1),
    c AS (SELECT g.query_id AS case_id, g.query_type = 'dentro de alcance' AS ans, g.query_id % 5 = 0 AS skipped, g.query_id % 7 = 0 AS must,
      CASE WHEN g.query_id % 3 = 0 THEN upper(g.ref1) END AS sub, a.answer, g.query_id % 4 AS cited, r.s, r.titles, g.query_id % 500 AS rms, a.generation_ms AS gms
      FROM gold g LEFT JOIN r USING (query_id) LEFT JOIN generated a USING (query_id)),
    n AS (SELECT *, CASE WHEN ans AND NOT skipped AND (s IS NULL OR s < 0.35) THEN 'quality_not_good'
        WHEN ans AND NOT skipped AND coalesce(sub, '') <> '' AND NOT coalesce(len(list_filter(string_split(titles, '|'), lambda t: contains(lower(t), lower(sub)))) > 0, false) THEN 'document_missing' END AS n1,
      CASE WHEN ans AND NOT contains(lower(coalesce(answer, '')), 'src') THEN 'keywords_missing' END AS n2,
      CASE WHEN ans AND cited = 0 AND NOT skipped THEN 'no_source_cited' END AS n3,
      CASE WHEN NOT ans AND NOT coalesce(contains(answer, 'No tengo esa información disponible'), false) THEN 'refusal_expected' END AS n4,
      CASE WHEN NOT ans AND cited <> 0 THEN 'sources_on_refusal' END AS n5,
      CASE WHEN skipped AND cited <> 0 THEN 'retrieval_not_skipped' END AS n6, CASE WHEN NOT skipped AND must AND cited = 0 THEN 'retrieval_skipped' END AS n7 FROM c),
    graded AS (SELECT case_id, rms AS retrieval_ms, gms AS generation_ms, n1 IS NULL AS retrieval_ok, n2 IS NULL AND n3 IS NULL AND n4 IS NULL AND n5 IS NULL AS answer_ok,
      n6 IS NULL AND n7 IS NULL AS skip_ok, concat_ws(',', n1, n2, n3, n4, n5, n6, n7) AS notes FROM n)"""


def graded(v):
    g, a = v["gold"], v["generated"]
    cases = g.select(
        C("query_id").alias("case_id"), (C("query_type") == "dentro de alcance").alias("answerable"),
        F.array(F.lit("SRC")).alias("keywords"), F.when(C("query_id") % 3 == 0, F.upper("ref1")).alias("doc_substring"),
        (C("query_id") % 5 == 0).alias("rag_skipped"), (C("query_id") % 7 == 0).alias("must_retrieve"))
    q = g.select("query_id")
    titles = v["retrieved"].groupBy("query_id").agg(F.collect_list("document_title").alias("titles"))
    ret = R.retrieval_quality(v["retrieved"], q).join(titles, "query_id", "left").select(
        C("query_id").alias("case_id"), "quality", "titles", (C("query_id") % 500).alias("retrieval_ms"))
    ans = a.select(C("query_id").alias("case_id"), "answer", (C("query_id") % 4).alias("sources_cited"), "generation_ms")
    return E.grade_case(cases, ret, ans)


@query("grade_case", GRADED + " SELECT *, retrieval_ok AND answer_ok AND skip_ok AS passed FROM graded")
def _(v):
    return graded(v).withColumn("notes", F.array_join("notes", ","))


@query("suite_summary", GRADED + """ SELECT CAST(count(*) FILTER (WHERE retrieval_ok AND answer_ok AND skip_ok) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total,
    avg(retrieval_ms) AS avg_retrieval_ms, avg(generation_ms) AS avg_generation_ms, CAST(count(*) FILTER (WHERE retrieval_ok) AS BIGINT) AS retrieval_passed,
    CAST(count(*) FILTER (WHERE answer_ok) AS BIGINT) AS answer_passed, CAST(count(*) FILTER (WHERE skip_ok) AS BIGINT) AS skip_passed FROM graded""", rounded=('avg_retrieval_ms', 'avg_generation_ms'))
def _(v):
    return E.suite_summary(graded(v))
