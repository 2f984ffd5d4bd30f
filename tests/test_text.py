"""Golden tables for the scalar functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from atril import settings as S
from atril.functions import text as tx
from atril.functions.stemmer import stem


def test_fold(one):
    got = one(tx.normalize_for_match, [("Ingeniería ÑANDÚ",), ("ﬁnanzas ½ Ångström",), ("été",), (None,)], "t string")
    assert got == ["ingenieria nandu", "finanzas 1⁄2 angstrom", "ete", None]


def test_fold_all_code_points(one):
    """Every assigned code point, as NFKD gives it; syllables as their letters."""
    assigned = [chr(c) for c in range(0xA0, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    rows = ["한국어 Ñ", "\U0001d400bc", "\U0001d41ab\u0301 ½", "x\U0001d167y", "ＡＢ각", ""]
    rows += ["a".join(assigned[i : i + 200]) for i in range(0, len(assigned), 200)]
    want = ["".join(c for c in unicodedata.normalize("NFKD", r.lower()) if not unicodedata.combining(c)) for r in rows]
    got = one(tx.normalize_for_match, [(unicodedata.normalize("NFC", r) if i < 6 else r,) for i, r in enumerate(rows)], "t string")
    assert [i for i, (g, w) in enumerate(zip(got, want, strict=True)) if g != w] == []


def test_clean_text(one):
    got = one(tx.clean_text, [
        ("a  b\t\tc\n\n\n\nd",), ("x\n  12  \ny",), ("Página 3 de 10 fin",), ("a ____ b ---- c",), ("  uno  \n  dos  ",),
        ("ﬁn １２",), ("a -- b",), ("",)], "t string")
    assert got == ["a b c\n\nd", "x\ny", "fin", "a  b  c", "uno\ndos", "fin 12", "a -- b", ""]


@pytest.mark.parametrize("text,temp,greet", [
    ("¿Cuáles son los requisitos?", 0.0, False), ("hola", 0.15, True), ("Háblame del lugar", 0.05, False),
    ("hola, cuánto cuesta la matrícula", 0.0, False), ("hola buenas quisiera conversar con alguien un rato largo", 0.15, False),
    ("muchas gracias", 0.15, True), ("ayuda con la carrera", 0.05, False), ("CRÉDITOS", 0.0, False)])
def test_query_class(one, text, temp, greet):
    assert one(tx.temperature, [(text,)], "t string") == [temp]
    assert one(tx.is_greeting, [(text,)], "t string") == [greet]


def test_varying_topic(one):
    rows = [("¿qué materias tiene?",), ("requisitos de admisión",), ("¿qué hago si pierdo una materia?",), ("misión",), ("horarios",)]
    assert one(tx.varying_topic, rows, "t string") == [True, False, False, True, False]


def test_mentions_entity(one):
    rows = [("materias de Ingeniería de Sistemas", "Ingenieria de Sistemas"), ("materias de derecho", "Ingeniería Civil"),
            ("ingenieria", "Ingeniería Civil"), ("algo", "de la"), ("pensum de sistemas", "07_DesarrolloSoftware_e_IngSistemas")]
    assert one(tx.mentions_entity, rows, "q string, e string") == [True, False, True, False, False]
    assert one(lambda q, e: tx.mentions_entity(q, e, 1.0), rows[:3], "q string, e string") == [True, False, False]


def test_keyword_score(one):
    rows = [("hola mundo", "Hola mundo cruel"), ("hola", "adiós"), ("", "x"), ("a b c d", "b d"), ("año", "ano")]
    assert one(tx.keyword_score, rows, "q string, t string") == [1.0, 0.0, 0.0, 0.5, 0.0]


def test_semester_reference(one):
    rows = [("tercer semestre",), ("semestre 3",), ("Semestre III",), ("semestre tres",), ("último semestre",), ("materias",),
            ("semestre siguiente, luego semestre cuatro",), ("semestre 2 o quinto",)]
    assert one(tx.semester_reference, rows, "t string") == ["3", "3", "3", "3", "ULTIMO", None, "4", "5"]


def test_citations_and_context(one):
    assert one(lambda a: tx.citations(a, F.lit(5)), [("x [2] y [4][2] [9] [123]",), ("nada",)], "a string") == [[2, 4], []]
    ctx = S.BLOCK_SEPARATOR.join(["[1] a\nuno", "[2] b\ndos", "[13] c\ntres"])
    got = one(tx.narrow_context, [(ctx, "ver [2]"), (ctx, "sin cita"), (ctx, "[7]"), (ctx, "[13] y [1]")], "c string, a string")
    assert got == ["[2] b\ndos", ctx, ctx, S.BLOCK_SEPARATOR.join(["[1] a\nuno", "[13] c\ntres"])]


def test_verdict(one):
    got = one(tx.verdict, [("SI",), ("Falta dato\nNO, inventa",), ("",), ("razón\n\n sí \n",), (None,), ("quizá",)], "t string")
    assert [None if g is None else tuple(g) for g in got] == [
        (False, True, None), (True, False, "Falta dato"), (False, False, None), (False, True, "razón"), None, (False, False, None)]


def test_reasoning_markdown_refs(one):
    assert one(tx.strip_reasoning, [("<think>x\ny</think> hola <THINK>z</THINK>",)], "t string") == ["hola"]
    md = "# Título\n**negrita** y *cursiva* [ver](http://x) ![img](u)\n- uno\n1. dos\n> cita\n| a | b |\n`c` ~~d~~ 🙂"
    assert one(tx.strip_markdown, [(md,)], "t string") == ["Título\nnegrita y cursiva ver img\nuno\ndos\ncita\n a b \nc d"]
    cells = [("07_X.xlsx; sitio web / 09_Ý.xls (nota)",), ("(verificar si está)",), ("A.pdf",), ("",), ("doc.xlsx.pdf",)]
    assert one(tx.split_doc_refs, cells, "t string") == [["07_x", "09_y"], [], ["a"], [], ["doc"]]


def test_client_and_types(one):
    rows = [("9.9.9.9, 10.0.0.1", "p"), (None, "p"), (" , ", None), ("1.1.1.1", "p")]
    assert one(tx.client_key, rows, "f string, p string") == ["10.0.0.1", "p", "unknown", "1.1.1.1"]
    assert one(lambda f, p: tx.client_key(f, p, 2), rows[:1], "f string, p string") == ["9.9.9.9"]
    assert one(tx.file_type, [("a.DOC",), ("b.md",), ("c.zip",), ("sin",)], "n string") == ["docx", "txt", None, None]


@pytest.mark.parametrize("word,expected", [
    ("requisitos", "requisit"), ("admisiones", "admision"), ("admisión", "admision"), ("programas", "program"),
    ("universidad", "univers"), ("materias", "materi"), ("cantando", "cant"), ("rápidamente", "rapid"), ("chicas", "chic"),
    ("torneos", "torne"), ("sol", "sol"), ("y", "y"), ("paguemos", "pag")])
def test_stemmer(word, expected):
    assert stem(word) == expected
