"""Registered text-function queries and their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atril import settings as S
from atril.functions import text as tx
from atril.functions import vector as vx
from atril.plans.registry import query

C = F.col
STOP = "[" + ", ".join(f"'{w}'" for w in tx.ENTITY_STOP_WORDS) + "]"


def fold_sql(x: str) -> str:
    return f"strip_accents(lower({x}))"


def words_sql(x: str) -> str:
    spaced = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return (f"list_distinct(list_filter(regexp_extract_all({fold_sql(spaced)}, '[a-z0-9]+'), "
            f"lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w)))")


def set_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"


def has_word_sql(x: str, pattern: str) -> str:
    return f"regexp_matches(lower({x}), '(^|[^\\p{{L}}\\p{{N}}_])(?:{pattern})($|[^\\p{{L}}\\p{{N}}_])')"


def varying_sql(x: str) -> str:
    return f"(NOT {has_word_sql(x, tx.PROCEDURAL)} AND {has_word_sql(x, tx.VARYING)})"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def greeting_sql(x: str) -> str:
    return (f"(NOT {has_word_sql(x, tx.FACTUAL)} AND {has_word_sql(x, tx.CONVERSATIONAL)} AND "
            f"len(regexp_extract_all({x}, '\\S+')) <= 6)")


def mention_sql(q: str, e: str, overlap: float = 0.5) -> str:
    return (f"(len({words_sql(e)}) > 0 AND len(list_intersect({words_sql(q)}, {words_sql(e)}))::DOUBLE "
            f">= {overlap} * len({words_sql(e)}))")


def _joined(words):
    return F.array_join(F.array_sort(words), " ")


@query("normalize_for_match", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def _(v):
    return v["documents"].select("doc_id", tx.normalize_for_match(C("text")).alias("folded"))


CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    {0}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n\s*\d+\s*\n', chr(10), 'g'),
    '(?i)Página\s+\d+\s+de\s+\d+', '', 'g'), '_{{3,}}', '', 'g'), '-{{3,}}', '', 'g')"""
DIRTY = "'Página 3 de 9' || chr(10) || text || chr(10) || ' 12 ' || chr(10) || chr(10) || chr(10) || '---- fin ____'"


def clean_sql(x: str) -> str:
    inner = f"list_transform(string_split({CLEAN_SQL.format(x)}, chr(10)), lambda l: {strip_sql('l')})"
    return strip_sql(f"array_to_string({inner}, chr(10))")


@query("clean_text", f"SELECT doc_id, {clean_sql(DIRTY)} AS cleaned FROM documents")
def _(v):
    dirty = F.concat(F.lit("Página 3 de 9\n"), C("text"), F.lit("\n 12 \n\n\n---- fin ____"))
    return v["documents"].select("doc_id", tx.clean_text(dirty).alias("cleaned"))


@query("significant_words", f"""SELECT doc_id, array_to_string(list_sort({words_sql("text || ' ' || 'DesarrolloWeb para' || source")}), ' ') AS words
    FROM documents""")
def _(v):
    return v["documents"].select("doc_id", _joined(tx.significant_words(
        F.concat(C("text"), F.lit(" DesarrolloWeb para"), C("source")))).alias("words"))


@query("mentions_entity", f"""SELECT q.question_id, q.conv_source AS entity, {mention_sql("q.question", "q.conv_source")} AS mentioned,
    {mention_sql("q.question", "q.conv_source", 1.0)} AS fully
    FROM (SELECT question_id, question, 'src' || CAST(question_id // 1000 % 20 AS VARCHAR) || ' DesarrolloSoftware Sistemas' AS conv_source
          FROM questions) q""")
def _(v):
    entity = F.concat(F.lit("src"), (F.floor(C("question_id") / 1000) % 20).cast("string"),
                      F.lit(" DesarrolloSoftware Sistemas"))
    q = v["questions"].withColumn("entity", entity)
    return q.select("question_id", "entity", tx.mentions_entity(C("question"), C("entity")).alias("mentioned"),
                    tx.mentions_entity(C("question"), C("entity"), 1.0).alias("fully"))


@query("query_class", f"""SELECT question_id,
    CAST(CASE WHEN {has_word_sql('question', tx.FACTUAL)} THEN 0.0
         WHEN {has_word_sql('question', tx.CONVERSATIONAL)} THEN 0.15 ELSE 0.05 END AS DOUBLE) AS temperature,
    {greeting_sql('question')} AS is_greeting FROM questions""")
def _(v):
    return v["questions"].select("question_id", tx.temperature(C("question")).cast("double").alias("temperature"),
                                 tx.is_greeting(C("question")).alias("is_greeting"))


@query("varying_topic", f"SELECT question_id, {varying_sql('question')} AS varying FROM questions")
def _(v):
    return v["questions"].select("question_id", tx.varying_topic(C("question")).alias("varying"))


@query("keyword_score", f"""SELECT d.doc_id, round(len(list_intersect({set_sql('b.text')}, {set_sql('d.text')}))::DOUBLE
    / len({set_sql('b.text')}), 6) AS score FROM documents d JOIN documents b ON b.doc_id = d.doc_id + 1""")
def _(v):
    """Every document against its neighbour's words."""
    return _beside(v).select("doc_id", F.round(tx.keyword_score(C("other"), C("text")), 6).alias("score"))


def _beside(v):
    """Each document with the text of the next one."""
    d = v["documents"].select("doc_id", "text")
    return d.join(d.select((C("doc_id") - 1).alias("doc_id"), C("text").alias("other")), "doc_id")


def _list(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


SEMESTER_SQL = f"""coalesce(
   list_filter(list_transform(w, lambda x: CASE WHEN list_contains({_list(tx.ORDINALS)}, x)
      THEN {_list(tx.ORDINALS.values())}[list_position({_list(tx.ORDINALS)}, x)] END), lambda y: y IS NOT NULL)[1],
   list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = 'semestre' THEN
      CASE WHEN regexp_full_match(coalesce(w[i + 1], ''), '[0-9]+') THEN w[i + 1]
           ELSE {_list([*tx.CARDINALS.values(), *tx.ROMAN.values()])}[
                list_position({_list([*tx.CARDINALS, *tx.ROMAN])}, w[i + 1])] END END), lambda y: y IS NOT NULL)[1])"""


@query("semester_reference", f"""SELECT question_id, {SEMESTER_SQL} AS semester FROM (
    SELECT question_id, regexp_extract_all({fold_sql('question')}, '[a-z0-9]+') AS w FROM questions)""")
def _(v):
    return v["questions"].select("question_id", tx.semester_reference(C("question")).alias("semester"))


@query("cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(v):
    e = v["embeddings"]
    nxt = e.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vx.cosine(C("embedding"), C("other")), 6).alias("cosine"))


HEAD = r"list_distinct(list_filter(regexp_split_to_array(lower(substr({0}, 1, 300)), '\s+'), lambda w: w <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"({inter}::DOUBLE / greatest(len({a}) + len({b}) - {inter}, 1))"


@query("head_jaccard", f"""SELECT a.doc_id, round({jaccard_sql(HEAD.format('a.text'), HEAD.format('b.text'))}, 6) AS jaccard
    FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def _(v):
    d = v["documents"].select("doc_id", "text")
    nxt = d.select((C("doc_id") - 1).alias("doc_id"), C("text").alias("other"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(tx.head_jaccard(C("text"), C("other")), 6).alias("jaccard"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(v):
    return v["documents"].select("doc_id", tx.content_hash(C("text")).alias("hash"))


@query("request_key", """SELECT question_id, sha256('{"query":"' || question_id || '","threshold":0.35,"top_k":10}') AS key FROM questions""")
def _(v):
    return v["questions"].select("question_id", tx.request_key(
        top_k=F.lit(10), query=C("question_id").cast("string"), threshold=F.lit(0.35)).alias("key"))


@query("token_count", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def _(v):
    return v["documents"].select("doc_id", tx.token_count(C("text")).cast("long").alias("tokens"))


CITED = r"list_sort(list_distinct(list_transform(regexp_extract_all({0}, '\[(\d{{1,2}})\]', 1), lambda d: CAST(d AS BIGINT))))"


@query("citations", f"""SELECT answer_id, array_to_string(list_filter({CITED.format('answer')}, lambda n: n >= 1 AND n <= n_sources), ',') AS cited
    FROM answers""")
def _(v):
    return v["answers"].select("answer_id", F.array_join(tx.citations(C("answer"), C("n_sources")), ",").alias("cited"))


@query("refusal_flag", f"""SELECT answer_id, contains(answer, '{S.REFUSAL_MARKER}') AS refused,
    contains(answer, '{S.CLARIFICATION_MARKER}') AS clarification FROM answers""")
def _(v):
    return v["answers"].select("answer_id", tx.refusal_flag(C("answer")).alias("refused"),
                               tx.clarification_flag(C("answer")).alias("clarification"))


GRADER = """grader AS (SELECT conv_id * 1000 + turn AS gid, CASE turn % 5 WHEN 0 THEN text || chr(10) || ' no, falta '
    WHEN 1 THEN chr(10) || 'Sí' WHEN 2 THEN text || chr(10) || chr(10) || 'SI.' WHEN 3 THEN '  ' ELSE text END AS out FROM conversations)"""
LINES_SQL = rf"""list_filter(list_transform(string_split(out, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '')"""


def _grader(v):
    out = (F.when(C("turn") % 5 == 0, F.concat(C("text"), F.lit("\n no, falta ")))
           .when(C("turn") % 5 == 1, F.lit("\nSí")).when(C("turn") % 5 == 2, F.concat(C("text"), F.lit("\n\nSI.")))
           .when(C("turn") % 5 == 3, F.lit("  ")).otherwise(C("text")))
    return v["conversations"].select((C("conv_id") * 1000 + C("turn")).alias("gid"), out.alias("out"))


@query("verdict", GRADER + f""" SELECT gid, starts_with(upper(coalesce(l[-1], '')), 'NO') AS rejected,
    starts_with(upper(coalesce(l[-1], '')), 'SI') OR starts_with(upper(coalesce(l[-1], '')), 'SÍ') AS hallucinated,
    nullif(array_to_string(l[1:-2], ' '), '') AS reason FROM (SELECT gid, {LINES_SQL} AS l FROM grader)""")
def _(v):
    return _grader(v).select("gid", tx.verdict(C("out")).alias("x")).select("gid", "x.*")


CONTEXT = """ctx AS (SELECT answer_id, answer, '[1] t' || chr(10) || answer || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[2] u' || chr(10)
   || repeat(answer, 20) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[13] w' AS context FROM answers)"""


@query("narrow_context", CONTEXT + rf""", parts AS (
    SELECT answer_id, context, list_filter(string_split(context, chr(10) || chr(10) || '---' || chr(10) || chr(10)),
      lambda b: list_contains({CITED.format('answer')}, try_cast(regexp_extract(b, '^\[(\d{{1,2}})\]', 1) AS BIGINT))) AS kept FROM ctx)
    SELECT answer_id, substr(CASE WHEN len(kept) > 0 THEN array_to_string(kept, chr(10) || chr(10) || '---' || chr(10) || chr(10)) ELSE context END, 1, 20480) AS narrowed
    FROM parts""")
def _(v):
    sep = F.lit(S.BLOCK_SEPARATOR)
    ctx = F.concat(F.lit("[1] t\n"), C("answer"), sep, F.lit("[2] u\n"), F.repeat(C("answer"), F.lit(20)), sep, F.lit("[13] w"))
    return v["answers"].select("answer_id", tx.narrow_context(ctx, C("answer")).alias("narrowed"))


@query("strip_reasoning", r"""SELECT doc_id, regexp_replace(regexp_replace('<Think>' || text || '</think> ' || text || '<think>x</think>', '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS answer
    FROM documents""")
def _(v):
    raw = F.concat(F.lit("<Think>"), C("text"), F.lit("</think> "), C("text"), F.lit("<think>x</think>"))
    return v["documents"].select("doc_id", tx.strip_reasoning(raw).alias("answer"))


MD_STEPS = [("```[\\s\\S]*?```", " "), ("`([^`]*)`", "\\1"), ("!\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"),
            ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("\\*\\*\\*(.*?)\\*\\*\\*|___(.*?)___", "\\1\\2"),
            ("\\*\\*(.*?)\\*\\*|__(.*?)__", "\\1\\2"), ("~~(.*?)~~", "\\1"), ("(?m)^#{1,6}\\s+", ""), ("(?m)^>\\s?", ""),
            ("(?m)^\\s*[-*+]\\s+", ""), ("(?m)^\\s*\\d+[.)]\\s+", ""), ("\\|", " "), ("[#*_~`]", ""),
            ("[ \\t]+", " "), ("\\n{2,}", "@NL@")]


def markdown_sql(x: str) -> str:
    for pattern, to in MD_STEPS:
        to = "chr(10)" if to == "@NL@" else f"'{to}'"
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return strip_sql(x)


MD_IN = "'# Título' || chr(10) || '> **' || source || '** y [enlace](http://x)' || chr(10) || '- `c` ~~no~~' || chr(10) || '1. ' || text"


@query("strip_markdown", f"SELECT doc_id, {markdown_sql(MD_IN)} AS spoken FROM documents")
def _(v):
    raw = F.concat(F.lit("# Título\n> **"), C("source"), F.lit("** y [enlace](http://x)\n- `c` ~~no~~\n1. "), C("text"))
    return v["documents"].select("doc_id", tx.strip_markdown(raw).alias("spoken"))


REFS = "source || '.xlsx; Sitio Web / ' || upper(lang) || '_Guía.PDF (verificar nota); por verificar;' || source || '.docx.pdf'"


@query("split_doc_refs", rf"""WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({REFS}, '[;/]'),
      lambda p: {strip_sql("regexp_replace(p, '\\([^)]*\\)', '', 'g')")}), lambda p: p <> '' AND NOT contains(lower(p), 'sitio web') AND NOT contains(lower(p), 'verificar')) AS p
    FROM documents)
    SELECT doc_id, array_to_string(list_transform(p, lambda x: regexp_replace({fold_sql('x')}, '(\.pptx)?(\.csv)?(\.docx)?(\.xls)?(\.xlsx)?(\.pdf)?$', '')), '|') AS refs FROM parts""")
def _(v):
    cell = F.concat(C("source"), F.lit(".xlsx; Sitio Web / "), F.upper("lang"),
                    F.lit("_Guía.PDF (verificar nota); por verificar;"), C("source"), F.lit(".docx.pdf"))
    return v["documents"].select("doc_id", F.array_join(tx.split_doc_refs(cell), "|").alias("refs"))


@query("cell_to_string", r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN trim(' ' || o_orderpriority || ' ')
    WHEN 1 THEN CAST(CAST(o_custkey AS BIGINT) AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS cell FROM orders""")
def _(v):
    kind = C("o_orderkey") % 4
    return v["orders"].select("o_orderkey", tx.cell_to_string(
        F.when(kind == 0, F.concat(F.lit(" "), C("o_orderpriority"), F.lit(" "))),
        F.when(kind == 1, C("o_custkey").cast("double")), F.when(kind == 2, C("o_orderdate"))).alias("cell"))


@query("roman_ordinal", f"""SELECT doc_id, {_list(tx.ROMAN_ORDINAL.values())}[list_position({_list(tx.ROMAN_ORDINAL)}, label)] AS ordinal
    FROM (SELECT doc_id, (['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','?'])[1 + CAST(doc_id % 14 AS INTEGER)] AS label FROM documents)""")
def _(v):
    labels = F.array(*[F.lit(x) for x in [*tx.ROMAN_ORDINAL, "XIII", "?"]])
    return v["documents"].select("doc_id", tx.roman_ordinal(F.element_at(labels, (C("doc_id") % 14 + 1).cast("int"))).alias("ordinal"))


@query("excerpt", "SELECT doc_id, substr(text, 1, 200) AS preview, substr(text, 1, 48) AS label FROM documents")
def _(v):
    return v["documents"].select("doc_id", tx.excerpt(C("text"), 200).alias("preview"), tx.excerpt(C("text"), 48).alias("label"))


CHAIN = "CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' , ' ELSE '10.0.0.' || event_id || ', 9.9.9.' || user_id || ' ' END"


@query("client_key", f"""SELECT event_id, coalesce(p[len(p)], CASE WHEN user_id % 2 = 0 THEN 'peer' || user_id END, 'unknown') AS client FROM (
    SELECT event_id, user_id, list_filter(list_transform(string_split({CHAIN}, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM events)""")
def _(v):
    chain = F.when(C("user_id") % 3 == 1, F.lit(" , ")).when(C("user_id") % 3 == 2, F.concat(
        F.lit("10.0.0."), C("event_id").cast("string"), F.lit(", 9.9.9."), C("user_id").cast("string"), F.lit(" ")))
    peer = F.when(C("user_id") % 2 == 0, F.concat(F.lit("peer"), C("user_id").cast("string")))
    return v["events"].select("event_id", tx.client_key(chain, peer).alias("client"))


@query("sources_json", """SELECT document_id, '[{"citation_number":1,"chunk_id":' || document_id || ',"document_title":"' || title ||
    '","score":0.5,"program":"' || program || '"}]' AS sources, title AS first_title FROM kb_documents""")
def _(v):
    entry = F.struct(F.lit(1).alias("citation_number"), C("document_id").alias("chunk_id"), C("title").alias("document_title"),
                     F.lit(None).cast("string").alias("content_preview"), F.lit(0.5).alias("score"), C("program"),
                     F.lit(None).cast("string").alias("faculty"))
    d = v["kb_documents"].select("document_id", tx.sources_to_json(F.array(entry)).alias("sources"))
    return d.withColumn("first_title", tx.sources_from_json(C("sources"))[0]["document_title"])


@query("resolve_file_type", f"""SELECT document_id, {_list(tx.EXTENSIONS.values())}[list_position({_list(tx.EXTENSIONS)},
    lower(regexp_extract(file_name, '\\.([^.]+)$', 1)))] AS file_type FROM kb_documents""")
def _(v):
    return v["kb_documents"].select("document_id", tx.file_type(C("file_name")).alias("file_type"))


@query("word_set_ops", f"""SELECT d.doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_and,
    CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_or, len(list_intersect(a, b)) = len(a) AS is_subset
    FROM (SELECT d.doc_id, {set_sql('b.text')} AS a, {set_sql('d.text')} AS b FROM documents d JOIN documents b ON b.doc_id = d.doc_id + 1) d""")
def _(v):
    """Every document's words against its neighbour's."""
    sets = _beside(v).select("doc_id", tx.word_set(C("other")).alias("a"), tx.word_set(C("text")).alias("b"))
    return sets.select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n_and"),
                                      F.size(F.array_union("a", "b")).cast("long").alias("n_or"),
                                      tx.is_subset(C("a"), C("b")).alias("is_subset"))


@query("dimension_check", """SELECT label AS model, CAST(count(*) FILTER (WHERE len(embedding) <> 64) AS BIGINT) AS wrong,
    CAST(count(*) AS BIGINT) AS total FROM embeddings GROUP BY 1""")
def _(v):
    from atril.operators.rows import dimension_check

    return dimension_check(v["embeddings"], 64, "label")
