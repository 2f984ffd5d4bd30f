"""Golden tables: answer reuse, understanding, citations, judging, verification, windows."""

import datetime as dt

import pytest

from atril import settings as S
from atril.operators import answer_cache as K
from atril.operators import answers as N
from atril.operators import rows as W
from atril.operators import understanding as U

SOURCES = "array<struct<program:string,faculty:string,document_title:string>>"


@pytest.mark.parametrize("sources,question,query,passes", [
    ([("Medicina", "", "t")], "requisitos de medicina", "requisitos de enfermería", False),
    ([("Medicina", "", "t")], "requisitos de medicina", "requisitos de Medicina", True),
    ([("Medicina", "", "t"), ("Derecho", "", "t")], "q", "otra cosa", True),
    ([("", "Ciencias Básicas", "t")], "q", "facultad de ciencias", True),
    ([("", "Ciencias Básicas", "t")], "q", "algo distinto", False),
    ([(None, None, "07_DesarrolloSoftware_e_IngSistemas")], "pensum", "materias de sistemas", True),
    ([(None, None, "07_DesarrolloSoftware_e_IngSistemas")], "pensum", "materias de civil", False),
    ([(None, None, "ESTATUTO ESTUDIANTIL")], "requisitos de admisión", "requisitos para admision", True),
    ([("Medicina", "", "ESTATUTO")], "requisitos de admision para medicina", "requisitos de admision", False),
    ([(None, None, "A1"), (None, None, "B1")], "q", "cualquier consulta", True), ([], "q", "cualquiera", True)])
def test_entity_guard(one, sources, question, query, passes):
    got = one(lambda s, q, t: K.entity_guard(s, q, t), [(sources, question, query)], f"s {SOURCES}, q string, t string")
    assert got == [passes]


def test_semester_guard(one):
    rows = [("tercer semestre", "cuarto semestre"), ("semestre 3", "tercer semestre"), ("materias", "tercer semestre"),
            ("último semestre", "semestre 5"), ("a", "b")]
    assert one(K.semester_guard, rows, "a string, b string") == [False, True, True, False, True]


def test_lookup(spark):
    now = dt.datetime(2024, 3, 1)
    old, new = now - dt.timedelta(days=40), now - dt.timedelta(days=1)
    src = [("Medicina", None, "t")]
    entries = spark.createDataFrame([
        (1, [1.0, 0.0], "materias de medicina", "A", src, new - dt.timedelta(hours=1)), (2, [1.0, 0.0], "materias de medicina", "B", src, new),
        (3, [0.0, 1.0], "x", "C", [], old), (4, [-1.0, 0.2], "tercer semestre", "D", [], new)],
        f"entry_id int, embedding array<float>, question string, answer string, sources {SOURCES}, ts timestamp_ntz")
    queries = spark.createDataFrame([
        (1, "materias medicina", [1.0, 0.0]), (2, "materias derecho", [1.0, 0.0]), (3, "", [1.0, 0.0]), (4, "x", [0.0, -1.0]),
        (5, "x", [0.6, 0.8]), (6, "cuarto semestre", [-1.0, 0.2]), (7, "medicina", None)],
        "query_id int, query_text string, query_embedding array<float>")
    got = {r.query_id: (r.outcome, r.entry_id, r.answer) for r in K.answer_cache_lookup(queries, entries, now).collect()}
    assert got == {1: ("hit", 2, "B"), 2: ("entity_rejected", 2, None), 3: ("hit", 2, "B"), 4: ("empty", None, None),
                   5: ("below_threshold", 2, None), 6: ("semester_rejected", 4, None), 7: ("empty", None, None)}


def test_aliases_and_program_filter(spark):
    chunks = spark.createDataFrame([
        (1, "intro"), (1, "Primer ciclo de formación: Tecnología en Desarrollo de Software — Semestres I a VI"),
        (2, "primer ciclo de formacion : Tecnología en Obras Civiles (Semestres)"), (3, "sin alias")], "document_id int, content string")
    docs = spark.createDataFrame([(1, "ingenieria de sistemas"), (2, "Ingeniería Civil"), (3, "Contaduría"), (4, "")], "document_id int, program string")
    aliases = U.program_aliases(chunks, docs)
    assert {(r.alias, r.program) for r in aliases.collect()} == {
        ("Tecnología en Desarrollo de Software", "ingenieria de sistemas"), ("Tecnología en Obras Civiles", "Ingeniería Civil")}
    asked = ["materias de ingeniería civil", "materias de ingenieria", "pensum de contaduría e ingenieria de sistemas",
             "créditos de tecnología en desarrollo de software", "sedes de contaduría",
             "pensum tecnologia en desarrollo de software de ingenieria de sistemas"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string")
    got = [r.program_filter for r in U.detect_program_filter(q, docs.select("program"), aliases).orderBy("query_id").collect()]
    assert got == ["Ingeniería Civil", None, None, "ingenieria de sistemas", None, "ingenieria de sistemas"]


@pytest.mark.parametrize("query,quality,sources,expected", [
    ("¿cuál es el pensum?", "good", [("Civil", "Ing", .6), ("Sistemas", "Ing", .55)], ("program", ["Civil", "Sistemas"])),
    ("¿cuál es el pensum?", "weak", [("Civil", "Ing", .6), ("Sistemas", "Ing", .55)], None),
    ("requisitos de admisión", "good", [("Civil", "Ing", .6), ("Sistemas", "Ing", .55)], None),
    ("pensum de sistemas", "good", [("Civil", "Ing", .6), ("Sistemas", "Ing", .55)], None),
    ("pensum", "good", [("Civil", "Ing", .9), ("Sistemas", "Ing", .5)], None),
    ("pensum", "good", [("", "Ciencias", .6), (None, "Artes", .6)], ("faculty", ["Artes", "Ciencias"])),
    ("pensum de gestión", "good", [("Gestión Pública", "Ciencias", .6), (None, "Artes", .6)], None), ("pensum", "good", [], None)])
def test_ambiguity(spark, query, quality, sources, expected):
    q = spark.createDataFrame([(1, query)], "query_id int, query_text string")
    res = spark.createDataFrame([(1, s, p, f) for p, f, s in sources], "query_id int, score double, program string, faculty string")
    qual = spark.createDataFrame([(1, quality)], "query_id int, quality string")
    got = [(r.entity_type, r.candidates) for r in U.detect_ambiguity(q, res, qual).collect()]
    assert got == ([expected] if expected else [])


def test_cited_sources(spark):
    answers = spark.createDataFrame([
        (1, "ver [2] y [4]"), (2, "sin cita"), (3, S.REFUSAL_MARKER + " [1]"), (4, "[9]")], "answer_id int, answer string")
    src = spark.createDataFrame([(a, n, f"t{n}") for a in range(1, 5) for n in range(1, 6)], "answer_id int, citation_number int, document_title string")
    got = sorted((r.answer_id, r.citation_number) for r in N.cited_sources(answers, src).collect())
    assert got == [(1, 2), (1, 4)]


def test_verification(spark):
    rows = [(1, 1, "a", "SI"), (2, 1, "a", "mal\nNO"), (2, 2, "b", "SI"), (3, 1, "a", "NO"), (3, 2, "b", "peor\nNO"), (3, 3, "c", "SI"),
            (4, 1, S.REFUSAL_MARKER, "NO"), (5, 1, "a", None), (6, 1, "a", "raro")]
    df = spark.createDataFrame(rows, "turn_id int, attempt int, draft string, grader_output string")
    got = {r.turn_id: (r.attempts, r.approved, r.reason, r.served) for r in N.verification_outcome(df).collect()}
    assert got == {1: (1, True, None, "a"), 2: (2, True, None, "b"), 3: (2, False, "peor", S.REFUSAL_MARKER),
                   4: (1, True, None, S.REFUSAL_MARKER), 5: (1, True, None, "a"), 6: (1, True, None, "a")}


def test_judge_failures_are_isolated(spark):
    rows = spark.createDataFrame([("q", "c", "bien"), ("q", "c", "malo"), ("q", "c", "falla")], "question string, context string, answer string")

    def judge(qs, cs, answers):
        if "falla" in answers:
            raise RuntimeError
        return ["motivo\nSI" if a == "malo" else "NO" for a in answers]

    got = {r.answer: r.hallucinated for r in N.judge_answers(rows.coalesce(1), judge).collect()}
    assert got == {"bien": False, "malo": True, "falla": None}


def test_turn_windows(spark):
    ask = S.CLARIFICATION_MARKER + " programas"
    rows = [(1, 0, "user", "pensum"), (1, 1, "assistant", ask), (1, 2, "user", "civil"), (1, 3, "assistant", "x" * 700), (1, 4, "user", "gracias"),
            (2, 0, "user", "sola")]
    df = spark.createDataFrame([(c * 10 + o, c, o, r, t) for c, o, r, t in rows], "message_id int, conversation_id int, ord int, role string, content string")
    got = {r.message_id: (r.is_followup, r.retrieval_query) for r in W.turn_pairing(df).collect()}
    assert got == {10: (False, "pensum"), 12: (True, "pensum civil"), 14: (False, "gracias"), 20: (False, "sola")}
    hist = {r.message_id: r.history for r in W.history_window(df, 2).collect()}
    assert hist[10] == [] and [h.content for h in hist[14]] == ["civil", "x" * 600 + "…"]


def test_token_budget(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 0, 40_000, 0), ("a", 30, 40_000, 0), ("a", 59, 40_000, 0), ("a", 61, 4, 0), ("b", 0, 0, 30_000)]
    df = spark.createDataFrame([(p, t + dt.timedelta(seconds=s), c, m) for p, s, c, m in rows], "provider string, ts timestamp, prompt_chars long, max_tokens long")
    got = [(r.provider, r.used, r.over) for r in W.rolling_token_usage(df).orderBy("provider", "ts").collect()]
    assert got == [("a", 10000, False), ("a", 20000, False), ("a", 30000, True), ("a", 20001, False), ("b", 30000, True)]


def test_guest_expiry_and_guards(spark):
    now = dt.datetime(2024, 1, 2)
    conv = spark.createDataFrame([(1, None, now - dt.timedelta(hours=3)), (2, None, now), (3, 5, now - dt.timedelta(days=9))],
                                 "conversation_id int, user_id int, created_at timestamp_ntz")
    msgs = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "message_id int, conversation_id int")
    left, kept = W.expire_guest_rows(conv, msgs, now)
    assert {r.conversation_id for r in left.collect()} == {2, 3} == {r.conversation_id for r in kept.collect()}
    users = spark.createDataFrame([(1, "admin"), (2, "user")], "user_id int, role string")
    changes = spark.createDataFrame([(1, 9, "user"), (2, 2, "admin"), (2, 1, "jefe"), (2, 1, "admin"), (7, 1, "user")], "user_id int, actor_id int, new_role string")
    assert {(r.user_id, r.new_role, r.actor_id): r.verdict for r in W.admin_demotion_guard(users, changes).collect()} == {
        (1, "user", 9): "last_admin", (2, "admin", 2): "self", (2, "jefe", 1): "bad_role", (2, "admin", 1): "ok", (7, "user", 1): "not_found"}
