"""Registered retrieval queries and their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril.functions.vector import hashed_embedder
from atril.operators import near_dup
from atril.operators import retrieval as R
from atril.operators.ingest import embed_texts
from atril.plans.registry import ORACLES, query
from atril.plans.views import Inputs

THRESHOLD = 0.15


def described(v: Inputs):
    return R.chunk_document_join(v["kb_chunks"], v["kb_documents"])


DESCRIBED = """described AS (
  SELECT c.chunk_id, c.document_id, c.content, c.embedding, d.title AS document_title, d.program, d.faculty,
         d.document_type
  FROM kb_chunks c JOIN kb_documents d USING (document_id))"""
ALLOWED = """(coalesce(q.program, '') = '' OR q.program = d.program)
    AND (coalesce(q.faculty, '') = '' OR q.faculty = d.faculty)
    AND (coalesce(q.document_type, '') = '' OR q.document_type = d.document_type)"""
PAIRS = DESCRIBED + f""", pairs AS (
  SELECT q.query_id, d.chunk_id,
         round(list_cosine_similarity(q.query_embedding::DOUBLE[], d.embedding::DOUBLE[]), 8) AS raw
  FROM kb_queries q, described d WHERE d.embedding IS NOT NULL AND {ALLOWED})"""
VECTOR = PAIRS + f""", vec AS (
  SELECT query_id, chunk_id, round(raw, 4) AS score, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rn FROM pairs)
  WHERE rn <= 30 AND raw >= {THRESHOLD})"""
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
KEYWORD = f""", qlex AS (
  SELECT query_id, unnest(list_distinct({TOKENS.format("query_text")})) AS lex FROM kb_queries),
qn AS (SELECT query_id, count(*) AS n FROM qlex GROUP BY 1),
toks AS (SELECT chunk_id, {TOKENS.format("content")} AS t FROM described WHERE embedding IS NOT NULL),
pos AS (SELECT chunk_id, unnest(t) AS lex, unnest(range(len(t))) AS p FROM toks),
matched AS (
  SELECT x.query_id, x.chunk_id FROM (
    SELECT l.query_id, p.chunk_id, count(DISTINCT p.lex) AS n FROM qlex l JOIN pos p USING (lex) GROUP BY 1, 2) x
  JOIN qn ON qn.query_id = x.query_id AND qn.n = x.n
  JOIN kb_queries q ON q.query_id = x.query_id JOIN described d ON d.chunk_id = x.chunk_id
  WHERE {ALLOWED}),
hits AS (SELECT m.query_id, m.chunk_id, p.p, p.lex FROM matched m JOIN qlex l USING (query_id)
         JOIN pos p ON p.chunk_id = m.chunk_id AND p.lex = l.lex),
lasts AS (SELECT h.query_id, h.chunk_id, h.p AS e, g.lex, max(g.p) AS last_p
          FROM hits h JOIN hits g ON g.query_id = h.query_id AND g.chunk_id = h.chunk_id AND g.p <= h.p
          GROUP BY 1, 2, 3, 4),
starts AS (SELECT l.query_id, l.chunk_id, e, min(last_p) AS s FROM lasts l JOIN qn ON qn.query_id = l.query_id
           GROUP BY 1, 2, 3, qn.n HAVING count(*) = qn.n),
covers AS (SELECT query_id, chunk_id, s, min(e) AS e FROM starts GROUP BY 1, 2, 3),
dens AS (SELECT c.query_id, c.chunk_id, c.s, c.e, count(*) AS inside FROM covers c
         JOIN hits h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id AND h.p BETWEEN c.s AND c.e
         GROUP BY 1, 2, 3, 4),
fts AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + greatest(e - s - (inside - 1), 0))), 8) AS rank_score
        FROM dens GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id) AS rn
       FROM fts) WHERE rn <= 10)"""
FUSED = """, fused AS (
  SELECT query_id, chunk_id, score, 'vector' AS origin, rn AS ord FROM vec
  UNION ALL
  SELECT k.query_id, k.chunk_id, 0.35, 'keyword', 1000000 + rn FROM kw k
  WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.query_id = k.query_id AND v.chunk_id = k.chunk_id))"""
RERANKED = f""", scored AS (
  SELECT f.*, d.content, d.document_title, d.program, d.faculty,
    round(0.8::DOUBLE * f.score + 0.2::DOUBLE * (
      len(list_intersect(list_distinct({TOKENS.format("q.query_text")}), list_distinct({TOKENS.format("d.content")})))::DOUBLE
      / len(list_distinct({TOKENS.format("q.query_text")}))), 8) AS hybrid
  FROM fused f JOIN kb_queries q USING (query_id) JOIN described d USING (chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, ord) AS rank FROM scored)"""
DEDUPED = r""", heads AS (
  SELECT query_id, rank, chunk_id,
         list_distinct(list_filter(regexp_split_to_array(lower(substr(content, 1, 300)), '\s+'), lambda w: w <> '')) AS words
  FROM ranked),
folded AS (
  SELECT query_id, list_reduce(list([{'rank': rank, 'chunk_id': chunk_id, 'words': words}] ORDER BY rank),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
        len(list_intersect(k.words, x[1].words))::DOUBLE /
        greatest(len(k.words) + len(x[1].words) - len(list_intersect(k.words, x[1].words)), 1) > 0.70)) > 0
      THEN acc ELSE list_concat(acc, x) END) AS kept
  FROM heads GROUP BY query_id),
kept AS (SELECT query_id, unnest(list_transform(kept, lambda k: k.chunk_id)) AS chunk_id FROM folded),
deduped AS (SELECT r.* FROM ranked r JOIN kept USING (query_id, chunk_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(document_title, '') ORDER BY rank) AS rt FROM deduped),
final AS (SELECT * EXCLUDE (rank), newrank AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS newrank FROM capped WHERE rt <= 10)
  WHERE newrank <= 10)"""
FULL = VECTOR + KEYWORD + FUSED + RERANKED + DEDUPED
VECTOR_ONLY = VECTOR + """, fused AS (
  SELECT query_id, chunk_id, score, 'vector' AS origin, rn AS ord FROM vec)""" + RERANKED + DEDUPED
RESULT = """ SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, score, hybrid, origin, document_title,
  program, faculty FROM final"""


def result_columns(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "hybrid", "origin",
                     "document_title", "program", "faculty")


def ranked_candidates(v: Inputs, keyword: bool = True):
    chunks, queries = described(v), v["kb_queries"]
    vec = R.vector_topk(queries, chunks, threshold=THRESHOLD)
    cand = R.hybrid_union(vec, R.keyword_topk(queries, chunks, config="simple"))
    rich = cand.join(chunks.drop("embedding"), "chunk_id").join(queries.select("query_id", "query_text"), "query_id")
    return R.rerank(rich)


@query("chunk_document_join", DESCRIBED + """
  SELECT chunk_id, document_id, document_title, program, faculty, document_type,
         CAST(length(content) AS BIGINT) AS chars FROM described""")
def _(v):
    return described(v).select("chunk_id", "document_id", "document_title", "program", "faculty", "document_type",
                               F.length("content").cast("long").alias("chars"))


@query("retrieval_filters", f"""
  SELECT q.query_id, d.document_id FROM kb_queries q, kb_documents d
  WHERE {ALLOWED} AND (coalesce(q.program, '') <> '' OR coalesce(q.faculty, '') <> '' OR coalesce(q.document_type, '') <> '')""")
def _(v):
    return R.retrieval_filters(v["kb_queries"], v["kb_documents"])


@query("query_chunk_cross", PAIRS + """
  SELECT query_id, CAST(count(*) AS BIGINT) AS n_compared, round(max(raw), 4) AS best_score FROM pairs GROUP BY 1""")
def _(v):
    return R.query_chunk_scan(v["kb_queries"], described(v))


@query("vector_topk", VECTOR + " SELECT query_id, chunk_id, score, CAST(rn AS BIGINT) AS rn FROM vec")
def _(v):
    return R.vector_topk(v["kb_queries"], described(v), threshold=THRESHOLD).withColumn("rn", F.col("rn").cast("long"))


@query("text_match", DESCRIBED + KEYWORD + " SELECT query_id, chunk_id, rank_score FROM fts")
def _(v):
    return R.text_match(v["kb_queries"], described(v), config="simple")


TERMS = f"""words AS (SELECT doc_id, list_distinct({TOKENS.format("text")}) AS w FROM documents),
    kb_terms AS (SELECT doc_id AS query_id, array_to_string(list_transform(list_sort(list_transform(w, lambda x: {{'n': length(x), 'w': x}}), 'DESC')[1:2],
      lambda s: s.w), ' ') AS query_text, NULL AS program, NULL AS faculty, NULL AS document_type FROM words), """


def term_queries(v):
    """Per document a question of its two longest words."""
    words = F.array_distinct(R.words_of(F.col("text")))
    longest = F.slice(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), False), 1, 2)
    return v["documents"].select(
        F.col("doc_id").alias("query_id"), F.array_join(F.transform(longest, lambda s: s["w"]), " ").alias("query_text"))


@query("text_match_terms", TERMS + (DESCRIBED + KEYWORD).replace("kb_queries", "kb_terms") + " SELECT query_id, chunk_id, rank_score FROM fts")
def _(v):
    return R.text_match(term_queries(v), described(v), config="simple")


@query("keyword_topk_terms", TERMS + (DESCRIBED + KEYWORD).replace("kb_queries", "kb_terms") + " SELECT query_id, chunk_id, CAST(rn AS BIGINT) AS rn FROM kw")
def _(v):
    out = R.keyword_topk(term_queries(v), described(v), config="simple")
    return out.select("query_id", "chunk_id", F.col("rn").cast("long").alias("rn"))


@query("text_match_spanish")
def _(v):
    return R.text_match(v["kb_queries"], described(v), config="spanish")


@query("keyword_topk", DESCRIBED + KEYWORD + " SELECT query_id, chunk_id, CAST(rn AS BIGINT) AS rn FROM kw")
def _(v):
    return R.keyword_topk(v["kb_queries"], described(v), config="simple").select("query_id", "chunk_id", F.col("rn").cast("long").alias("rn"))


@query("exclude_seen", VECTOR + KEYWORD + """
  SELECT query_id, chunk_id FROM kw k
  WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.query_id = k.query_id AND v.chunk_id = k.chunk_id)""")
def _(v):
    c = described(v)
    hits = R.keyword_topk(v["kb_queries"], c, config="simple")
    return R.exclude_seen(hits, R.vector_topk(v["kb_queries"], c, threshold=THRESHOLD)).select("query_id", "chunk_id")


@query("hybrid_union", VECTOR + KEYWORD + FUSED + """
  SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, origin, CAST(ord AS BIGINT) AS ord FROM fused""")
def _(v):
    c = described(v)
    return R.hybrid_union(R.vector_topk(v["kb_queries"], c, threshold=THRESHOLD), R.keyword_topk(v["kb_queries"], c, config="simple"))


@query("rerank", VECTOR + KEYWORD + FUSED + RERANKED + """
  SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, hybrid, CAST(rank AS BIGINT) AS rank FROM ranked""")
def _(v):
    return ranked_candidates(v).select("query_id", "chunk_id", "score", "hybrid", F.col("rank").cast("long").alias("rank"))


@query("near_dup_filter", FULL + " SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank FROM deduped")
def _(v):
    return R.near_dup_filter(ranked_candidates(v)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("diversity_cap", VECTOR + KEYWORD + FUSED + RERANKED + """, capped AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, document_title ORDER BY rank) AS rt FROM ranked)
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS rank
  FROM capped WHERE rt <= 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""")
def _(v):
    return R.diversity_cap(ranked_candidates(v), 1, 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("vector_search", VECTOR_ONLY + RESULT)
def _(v):
    return result_columns(R.hybrid_search(v["kb_queries"], described(v), threshold=THRESHOLD, keyword=False))


@query("hybrid_search", FULL + RESULT)
def hybrid_results(v):
    return result_columns(R.hybrid_search(v["kb_queries"], described(v), threshold=THRESHOLD, config="simple"))


@query("hybrid_search_default_threshold", FULL.replace(f"raw >= {THRESHOLD}", "raw >= 0.35") + RESULT)
def _(v):
    return result_columns(R.hybrid_search(v["kb_queries"], described(v), config="simple"))


@query("retrieval_quality", FULL + """
  SELECT q.query_id, CASE WHEN f.query_id IS NULL THEN 'none' WHEN f.score < 0.35 THEN 'weak' ELSE 'good' END AS quality,
         CAST(f.score AS DOUBLE) AS top_score, CAST(coalesce(n.n, 0) AS BIGINT) AS n_results
  FROM kb_queries q LEFT JOIN (SELECT * FROM final WHERE rank = 1) f ON f.query_id = q.query_id
  LEFT JOIN (SELECT query_id, count(*) AS n FROM final GROUP BY 1) n ON n.query_id = q.query_id""")
def _(v):
    res = R.hybrid_search(v["kb_queries"], described(v), threshold=THRESHOLD, config="simple")
    return R.retrieval_quality(res, v["kb_queries"])


@query("retrieval_log_sink", FULL + """
  SELECT q.query_id, substr(q.query_text, 1, 2000) AS query_text,
         coalesce(f.chunks, '') AS chunks, CAST(f.top_score AS DOUBLE) AS top_score
  FROM kb_queries q LEFT JOIN (
    SELECT query_id, string_agg(chunk_id || ':' || CAST(round(score * 10000) AS BIGINT) || ':' || document_title, ';' ORDER BY rank) AS chunks,
           min_by(score, rank) AS top_score FROM final GROUP BY 1) f ON f.query_id = q.query_id""")
def _(v):
    res = R.hybrid_search(v["kb_queries"], described(v), threshold=THRESHOLD, config="simple")
    log = R.retrieval_log(res, v["kb_queries"])
    shown = F.transform("chunks_retrieved", lambda c: F.concat_ws(
        ":", c["chunk_id"].cast("string"), F.round(c["score"] * 10000).cast("long").cast("string"), c["title"]))
    return log.select("query_id", "query_text", F.array_join(shown, ";").alias("chunks"), "top_score")


def stand_in_expansion(texts: list[str]) -> list[str]:
    """A model that answers with the question twice, fails on questions with a length divisible by 7 and has
    nothing to say to those divisible by 5."""
    if any(len(t) % 7 == 0 for t in texts):
        raise RuntimeError("no answer")
    return ["" if len(t) % 5 == 0 else f"Respuesta: {t} {t}" for t in texts]


@query("expand_queries", """SELECT question_id AS query_id,
    CASE WHEN length(question) % 7 = 0 OR length(question) % 5 = 0 THEN question ELSE 'Respuesta: ' || question || ' ' || question END AS embed_text,
    length(question) % 7 = 0 OR length(question) % 5 = 0 AS fell_back, true AS embedded_as_text FROM questions""")
def _(v):
    asked = v["questions"].select(F.col("question_id").alias("query_id"), F.col("question").alias("query_text"))
    made = R.embed_queries(asked, stand_in_expansion, hashed_embedder)
    # The vector is that of the expanded text: the same as embedding the texts directly.
    again = embed_texts(made.select("query_id", "embed_text"), "embed_text", hashed_embedder, out="direct")
    return made.join(again.select("query_id", "direct"), "query_id").select(
        "query_id", "embed_text", (F.col("embed_text") == F.col("query_text")).alias("fell_back"),
        (F.col("query_embedding") == F.col("direct")).alias("embedded_as_text"))


@query("near_dup_pairs", r"""SELECT h.doc_id, CAST(coalesce(r.least, h.doc_id) AS BIGINT) AS class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links
  FROM heads h LEFT JOIN (SELECT a, least(a, min(b)) AS least FROM reach GROUP BY a) r ON r.a = h.doc_id
  LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = h.doc_id""")
def _(v):
    return near_dup.near_dup_classes(v["documents"].select("doc_id", "text"), "doc_id", "text")


# A recursive list of tables has to come first, so this one is put together by hand.
ORACLES["near_dup_pairs"] = r"""WITH RECURSIVE heads AS (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(substr(text, 1, 300)), '\s+'), lambda w: w <> '')) AS words FROM documents),
said AS (SELECT doc_id, len(words) AS n, unnest(words) AS word FROM heads),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM said a JOIN said b ON a.word = b.word AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) > 0.70),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
""" + ORACLES["near_dup_pairs"].removeprefix("WITH ")
