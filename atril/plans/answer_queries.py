"""Registered answer post-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.operators import answers as N
from atril.plans.registry import query
from atril.plans.text_queries import CITED

C = F.col


@query("assemble_context", """SELECT query_id, string_agg('[' || rank || '] ' || document_title || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
    string_agg(rank || ':' || chunk_id || ':' || substr(content, 1, 200), '|' ORDER BY rank) AS sources
    FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM retrieved) GROUP BY 1""")
def _(v):
    out = N.assemble_context(v["retrieved"])
    shown = F.transform("sources", lambda s: F.concat_ws(
        ":", s["citation_number"].cast("string"), s["chunk_id"].cast("string"), s["content_preview"]))
    return out.select("query_id", "context", F.array_join(shown, "|").alias("sources"))


@query("cited_sources", f"""cites AS (SELECT answer_id, unnest({CITED.format('answer')}) AS c FROM answers
      WHERE NOT contains(answer, 'No tengo esa información disponible en mi base de conocimientos')),
    src AS (SELECT answer_id, unnest(range(1, n_sources + 1)) AS citation_number FROM answers)
    SELECT s.answer_id, s.citation_number FROM src s JOIN cites ON cites.answer_id = s.answer_id AND c = citation_number""")
def _(v):
    a = v["answers"]
    src = a.where(C("n_sources") > 0).select("answer_id", F.explode(F.sequence(F.lit(1), C("n_sources").cast("int"))).alias("citation_number"))
    out = N.cited_sources(a, src)
    return out.withColumn("citation_number", C("citation_number").cast("long"))


CODES = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]*\p{{N}}[\p{{L}}\p{{N}}_]*'))"


@query("judge_answers_lexical", f"""SELECT answer_id, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS grounded_share,
    CASE WHEN len(a) = 0 THEN false ELSE len(list_intersect(a, b))::DOUBLE / len(a) < 0.5 END AS hallucinated
    FROM (SELECT a.answer_id, {CODES.format('a.answer')} AS a, {CODES.format("substr(d.text || ' [1] 3 ', 1, 20480)")} AS b
          FROM answers a JOIN documents d ON d.doc_id = a.doc_id)""", rounded=('grounded_share',))
def _(v):
    d = v["documents"].select(C("doc_id"), F.concat(C("text"), F.lit(" [1] 3 ")).alias("context"))
    rows = v["answers"].join(d, "doc_id")
    return N.lexical_judge(rows).select("answer_id", "grounded_share", "hallucinated")


def contains_judge(questions, contexts, answers):
    """Batch judge used offline: quotes its reason, then the verdict line."""
    return ["respaldada\nNO" if a in c else "sin respaldo\nSI" for c, a in zip(contexts, answers)]


@query("judge_answers")
def _(v):
    d = v["documents"].select("doc_id", C("text").alias("context"))
    rows = v["answers"].join(d, "doc_id").withColumn("question", C("answer"))
    return N.judge_answers(rows.select("answer_id", "question", "context", "answer"), contains_judge).select(
        "answer_id", "judge_output", "hallucinated")


@query("verification_outcome", r"""g AS (SELECT turn_id, attempt, draft, grader_output, contains(draft, 'No tengo esa información disponible') AS refusal,
      list_filter(list_transform(string_split(coalesce(grader_output, ''), chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines FROM attempts WHERE attempt <= 2),
    v AS (SELECT *, refusal OR NOT starts_with(upper(coalesce(lines[-1], '')), 'NO') AS ok,
      CASE WHEN NOT refusal THEN nullif(array_to_string(lines[1:-2], ' '), '') END AS reason FROM g),
    pick AS (SELECT turn_id, bool_or(ok) AS approved, coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS attempts FROM v GROUP BY 1)
    SELECT p.turn_id, p.attempts, p.approved, v.reason, CASE WHEN p.approved THEN v.draft ELSE 'No tengo esa información disponible en mi base de conocimientos' END AS served
    FROM pick p JOIN v ON v.turn_id = p.turn_id AND v.attempt = p.attempts""")
def _(v):
    return N.verification_outcome(v["attempts"])
