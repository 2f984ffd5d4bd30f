"""Registered question-understanding and answer-reuse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.operators import answer_cache as K
from atril.operators import retrieval as R
from atril.operators import understanding as U
from atril.plans.registry import query
from atril.plans.text_queries import SEMESTER_SQL, fold_sql, greeting_sql, mention_sql, varying_sql, words_sql

C = F.col
ALIASES = r"""aliases AS (SELECT alias, min(program) AS program FROM (
    SELECT trim(regexp_extract(c.content, '(?i)Primer ciclo de formaci[oó]n\s*:\s*([^—(\n]+)', 1)) AS alias, d.program
    FROM alias_chunks c JOIN kb_documents d USING (document_id)) WHERE alias <> '' GROUP BY 1)"""


def asked(v):
    return v["questions"].select(C("question_id").alias("query_id"), C("question").alias("query_text"))


@query("program_aliases", ALIASES + " SELECT alias, program FROM aliases")
def _(v):
    return U.program_aliases(v["alias_chunks"], v["kb_documents"])


@query("detect_program_filter", ALIASES + f""", names AS (SELECT DISTINCT program AS name, program FROM kb_documents UNION ALL SELECT alias, program FROM aliases),
    nw AS (SELECT DISTINCT program, {words_sql('name')} AS w FROM names),
    qw AS (SELECT question_id, {words_sql('question')} AS w FROM questions WHERE {varying_sql('question')}),
    m AS (SELECT qw.question_id, min(program) AS p, count(DISTINCT program) AS n FROM qw, nw
          WHERE len(nw.w) > 0 AND len(list_intersect(nw.w, qw.w)) = len(nw.w) GROUP BY 1)
    SELECT q.question_id AS query_id, CASE WHEN m.n = 1 THEN m.p END AS program_filter FROM questions q LEFT JOIN m USING (question_id)""")
def _(v):
    from atril.operators.analytics import distinct_programs

    return U.detect_program_filter(asked(v), distinct_programs(v["kb_documents"]),
                                   U.program_aliases(v["alias_chunks"], v["kb_documents"]))


QUALITY = """quality AS (SELECT query_id, CASE WHEN score < 0.35 THEN 'weak' ELSE 'good' END AS quality FROM retrieved WHERE rank = 1)"""
AMBIGUOUS = QUALITY + f""", q AS (SELECT question_id AS query_id, question FROM questions JOIN quality ON query_id = question_id
      WHERE quality = 'good' AND {varying_sql('question')}),
    top AS (SELECT query_id, max(score) AS top FROM retrieved GROUP BY 1),
    ent AS (SELECT query_id, 'program' AS kind, program AS name, score FROM retrieved UNION ALL SELECT query_id, 'faculty', faculty, score FROM retrieved),
    best AS (SELECT q.query_id, kind, name, max(score) AS best, any_value({mention_sql('q.question', 'name')}) AS said FROM ent JOIN q USING (query_id) WHERE name <> '' GROUP BY 1, 2, 3),
    cand AS (SELECT b.*, top.top - best <= 0.15::DOUBLE AS close FROM best b JOIN top USING (query_id)),
    agg AS (SELECT query_id, list(name ORDER BY name) FILTER (WHERE kind = 'program' AND close) AS ps, list(name ORDER BY name) FILTER (WHERE kind = 'faculty' AND close) AS fs,
      coalesce(bool_or(said) FILTER (WHERE kind = 'program' AND close), false) AS pc, coalesce(bool_or(said) FILTER (WHERE kind = 'program'), false) AS pa,
      coalesce(bool_or(said) FILTER (WHERE kind = 'faculty' AND close), false) AS fc FROM cand GROUP BY 1),
    amb AS (SELECT query_id, CASE WHEN len(ps) >= 2 AND NOT pc THEN 'program' ELSE 'faculty' END AS entity_type,
      CASE WHEN len(ps) >= 2 AND NOT pc THEN ps ELSE fs END AS names FROM agg
      WHERE (len(ps) >= 2 AND NOT pc) OR (len(fs) >= 2 AND NOT fc AND NOT pa))"""


def _quality(v):
    q = asked(v)
    return R.retrieval_quality(v["retrieved"], q)


@query("detect_ambiguity", AMBIGUOUS + " SELECT query_id, entity_type, array_to_string(names, '|') AS candidates FROM amb")
def _(v):
    out = U.detect_ambiguity(asked(v), v["retrieved"], _quality(v))
    return out.withColumn("candidates", F.array_join("candidates", "|"))


@query("best_score_per_entity", """SELECT query_id, program AS name, max(score) AS best_score FROM retrieved WHERE program <> '' GROUP BY 1, 2""")
def _(v):
    from atril.operators.analytics import best_score_per_entity

    return best_score_per_entity(v["retrieved"])


def semester_sql(x: str) -> str:
    return f"(SELECT {SEMESTER_SQL} FROM (SELECT regexp_extract_all({fold_sql(x)}, '[a-z0-9]+') AS w))"


@query("semester_guard", f"""pairs AS (SELECT a.question_id, a.question AS qa, b.question AS qb FROM questions a JOIN questions b
      ON b.conv_id = a.conv_id AND b.turn = a.turn + 2), s AS (SELECT question_id, {semester_sql('qa')} AS x, {semester_sql('qb')} AS y FROM pairs)
    SELECT question_id, x IS NULL OR y IS NULL OR x = y AS passes FROM s""")
def _(v):
    q = v["questions"]
    nxt = q.select("conv_id", (C("turn") - 2).alias("turn"), C("question").alias("other"))
    return q.join(nxt, ["conv_id", "turn"]).select("question_id", K.semester_guard(C("question"), C("other")).alias("passes"))


GUARD = f"""(CASE WHEN len(pw) > 0 AND len(list_intersect(pw, qw)) = 0 THEN false WHEN len(fw) > 0 AND len(list_intersect(fw, qw)) = 0 THEN false
    WHEN len(pw) = 0 AND len(fw) = 0 AND NOT (len(qw) > 0 AND len(list_intersect(qw, cw)) = len(qw))
         AND len(tw) > 0 AND len(list_intersect(tw, qw)) = 0 THEN false ELSE true END)"""
GUARD_WORDS = f"""CASE WHEN program = other_program THEN {words_sql('program')} ELSE [] END AS pw, {words_sql('faculty')} AS fw,
    {words_sql('title')} AS tw, {words_sql('query_text')} AS qw, {words_sql('e.question')} AS cw"""


def entries(v):
    e = v["cache_entries"]

    def source(program):
        return F.struct(C(program).alias("program"), C("faculty"), C("title").alias("document_title"))

    return e.select("entry_id", "embedding", "question", "answer", "ts",
                    F.array(source("program"), source("other_program")).alias("sources"))


@query("entity_guard", f"""q AS (SELECT entry_id - 1 AS entry_id, CASE entry_id % 4 WHEN 0 THEN 'facultad central ' || program WHEN 1 THEN program || ' ' || question
      ELSE question END AS query_text FROM cache_entries),
    p AS (SELECT e.entry_id, {GUARD_WORDS} FROM q JOIN cache_entries e USING (entry_id)) SELECT entry_id, {GUARD} AS passes FROM p""")
def _(v):
    e = v["cache_entries"]
    text = (F.when(C("entry_id") % 4 == 0, F.concat(F.lit("facultad central "), C("program")))
            .when(C("entry_id") % 4 == 1, F.concat_ws(" ", "program", "question")).otherwise(C("question")))
    q = e.select((C("entry_id") - 1).alias("entry_id"), text.alias("query_text"))
    return entries(v).join(q, "entry_id").select(
        "entry_id", K.entity_guard(C("sources"), C("question"), C("query_text")).alias("passes"))


@query("answer_cache_lookup", f"""live AS (SELECT e.* FROM cache_entries e, clock WHERE e.ts >= clock.now - INTERVAL 15 DAY),
    pairs AS (SELECT q.query_id, e.entry_id, e.ts, round(list_cosine_similarity(q.query_embedding::DOUBLE[], e.embedding::DOUBLE[]), 8) AS raw FROM cache_queries q, live e),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, ts DESC, entry_id) AS rn FROM pairs WHERE raw > 0) WHERE rn = 1),
    w AS (SELECT q.query_id, q.query_text, b.entry_id, round(b.raw, 4) AS score, e.answer, {GUARD_WORDS}, {semester_sql('query_text')} AS sq, {semester_sql('e.question')} AS se
          FROM cache_queries q LEFT JOIN best b USING (query_id) LEFT JOIN cache_entries e USING (entry_id)),
    o AS (SELECT *, CASE WHEN score IS NULL THEN 'empty' WHEN score < 0.4 THEN 'below_threshold'
      WHEN query_text <> '' AND NOT (sq IS NULL OR se IS NULL OR sq = se) THEN 'semester_rejected'
      WHEN query_text <> '' AND NOT {GUARD} THEN 'entity_rejected' ELSE 'hit' END AS outcome FROM w)
    SELECT query_id, outcome, score, entry_id, CASE WHEN outcome = 'hit' THEN answer END AS answer FROM o""")
def lookup(v):
    return K.answer_cache_lookup(v["cache_queries"], entries(v), v.now, 0.4, 15 * 86400)


@query("cache_admission", """turns AS (SELECT m.message_id, m.content, m.created_at, m.verification_approved, m.message_id % 3 <> 0 AS good, e.vec_id
      FROM messages m LEFT JOIN embeddings e ON e.vec_id = m.ord + m.conversation_id WHERE m.role = 'assistant')
    SELECT message_id FROM turns WHERE good AND trim(content) <> '' AND vec_id IS NOT NULL AND coalesce(verification_approved, true)
      AND created_at > (SELECT max(created_at) FROM kb_documents WHERE ingestion_status = 'processing' )
    ORDER BY created_at DESC, message_id LIMIT 100""")
def _(v):
    e = v["embeddings"].select("vec_id", "embedding")
    t = v["messages"].where(C("role") == "assistant").withColumn("vec_id", C("ord") + C("conversation_id")).join(e, "vec_id", "left")
    turns = t.select(C("message_id").alias("entry_id"), C("content").alias("answer"), "embedding", "verification_approved",
                     C("created_at").alias("ts"), F.when(C("message_id") % 3 != 0, "good").otherwise("weak").alias("quality"))
    docs = v["kb_documents"].where(C("ingestion_status") == "processing").select(C("created_at").alias("updated_at"))
    return K.cache_admission(turns, docs, 100).select(C("entry_id").alias("message_id"))


@query("route_turns", AMBIGUOUS + f""" SELECT q.question_id AS query_id, CASE WHEN q.question_id % 13 = 0 THEN 'cached' WHEN {greeting_sql('q.question')} THEN 'greeting'
      WHEN a.query_id IS NOT NULL AND q.question_id % 2 = 1 THEN 'clarification' WHEN coalesce(k.quality, 'none') <> 'good' THEN 'refusal' ELSE 'answer' END AS route
    FROM questions q LEFT JOIN amb a ON a.query_id = q.question_id LEFT JOIN quality k ON k.query_id = q.question_id""")
def _(v):
    q = asked(v)
    turns = q.withColumn("is_followup", C("query_id") % 2 == 0)
    cache = q.select("query_id", F.when(C("query_id") % 13 == 0, "hit").otherwise("below_threshold").alias("outcome"))
    quality = _quality(v)
    return U.route_turns(turns, cache, U.detect_ambiguity(q, v["retrieved"], quality), quality)
