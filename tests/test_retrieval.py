import numpy as np
import pytest
from pyspark.sql import functions as F

from atril.operators import retrieval as R

SCHEMA = "query_id int, rank int, chunk_id int, content string, score double, document_title string, query_text string, ord long"


def ranked(spark, rows):
    return spark.createDataFrame([(1, i + 1, i, c, float(s), t, q, i) for i, (c, s, t, q) in enumerate(rows)], SCHEMA)


def ids(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_near_dup_keeps_first(spark):
    same = "uno dos tres cuatro cinco"
    df = ranked(spark, [(same, .9, "a", ""), (same, .8, "b", ""), ("algo muy distinto", .7, "c", ""), ("", .6, "d", ""), ("", .5, "e", "")])
    assert ids(R.near_dup_filter(df)) == [0, 2, 3, 4]


def test_diversity(spark):
    df = ranked(spark, [("x", .9, "a", "")] * 5 + [("x", .8, "b", "")] * 3)
    assert ids(R.diversity_cap(df, 2, 5)) == [0, 1, 5, 6]
    assert ids(R.diversity_cap(df, 3, 4)) == [0, 1, 2, 5]


def test_rerank_promotes_keywords(spark):
    df = ranked(spark, [("nada que ver", .55, "a", "costo matrícula civil"), ("costo matrícula civil", .40, "b", "costo matrícula civil")]).drop("rank")
    assert [r.chunk_id for r in R.rerank(df).orderBy("rank").collect()] == [1, 0]


def test_quality(spark):
    res = spark.createDataFrame([(1, 1, .5), (1, 2, .1), (2, 1, .2)], "query_id int, rank int, score double")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert {r.query_id: r.quality for r in R.retrieval_quality(res, q).collect()} == {1: "good", 2: "weak", 3: "none"}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    base[100:200] = base[7]  # a third of all rows is one copied vector
    base[5] = 0
    chunks = [(i, base[i].tolist() if i % 50 else None, "p" + str(i % 3)) for i in range(300)]
    queries = [(i, "q", rng.normal(size=8).tolist() if i else base[7].tolist(), "p1" if i % 2 else None) for i in range(40)]
    return (spark.createDataFrame(queries, "query_id int, query_text string, query_embedding array<float>, program string"),
            spark.createDataFrame(chunks, "chunk_id int, embedding array<float>, program string").repartition(5), queries, chunks)


def brute(queries, chunks, k, threshold):
    out = {}
    for qid, _, qv, program in queries:
        q, found = np.asarray(qv, dtype=np.float32).astype(float), []
        for cid, v, p in chunks:
            if v is None or (program and p != program):
                continue
            c = np.asarray(v, dtype=np.float32).astype(float)
            n = np.linalg.norm(q) * np.linalg.norm(c)
            s = round(float(q @ c / n), 8) if n else 0.0
            if s >= threshold:
                found.append((-s, cid))
        out[qid] = [c for _, c in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("k,threshold", [(5, 0.2), (30, -2.0), (120, 0.0)])
def test_vector_topk_equals_brute_force(vectors, k, threshold):
    q, c, queries, chunks = vectors
    got = {}
    for r in R.vector_topk(q, c, k, threshold).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {k_: v for k_, v in brute(queries, chunks, k, threshold).items() if v}


@pytest.mark.parametrize("bound", [None, 100])
def test_grid_of_many_blocks(spark, vectors, monkeypatch, bound):
    """Several blocks of questions, below and beyond the bound for sending all of them to every task."""
    from atril.operators import grid

    q, c, queries, chunks = vectors
    monkeypatch.setattr(grid.S, "QUERY_BLOCK_ROWS", 7)
    monkeypatch.setattr(grid, "PACK_ROWS", 16)
    monkeypatch.setattr(grid, "CELLS", 20)
    monkeypatch.setattr(grid, "HELD_BLOCKS", 2)
    if bound:
        monkeypatch.setattr(grid.S, "QUERY_BLOCK_BYTES", bound)
    got = {}
    for r in R.vector_topk(q, c, 5, 0.2).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {k: v for k, v in brute(queries, chunks, 5, 0.2).items() if v}
    n = {r.query_id: r.n_compared for r in R.query_chunk_scan(q, c).collect()}
    assert n == {i: len(v) for i, v in brute(queries, chunks, 1000, -2).items()}


def test_many_questions_take_one_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(500)], "chunk_id long, embedding array<float>").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    q = spark.range(20_000).selectExpr("id AS query_id", "array(sin(id), cos(id), sin(2 * id), 0.1D) AS query_embedding")
    found = R.vector_topk(q, chunks, 3, -2.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [chunk_id") == 1 and "Union" not in plan
    assert found.count() == 60_000


def test_odd_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0, 0.0], None), (3, None, None), (4, [0.0, 0.0], None)], "query_id long, query_embedding array<double>, program string")
    c = spark.createDataFrame([("x", [2.0, 0.0], "a"), ("y", [2.0, 0.0], None), ("z", [0.0, 5.0, 0.0], "a"), ("v", None, "a"), ("w", [], "a")], "chunk_id string, embedding array<float>, program string")
    got = {(r.query_id, r.chunk_id): r.score for r in R.vector_topk(q, c, 5, -2.0).collect()}
    assert got == {(1, "x"): 1.0, (2, "z"): 0.0, (4, "x"): 0.0, (4, "y"): 0.0}
    assert R.vector_topk(q.limit(0), c).count() == 0 and R.vector_topk(q, c.limit(0)).count() == 0
    assert R.text_match(q.selectExpr("query_id", "'a' AS query_text").limit(0), c.withColumn("content", F.lit("a"))).count() == 0


def test_query_blocks_cover_everything(vectors):
    from atril.operators import scale

    q = vectors[0]
    blocks = list(scale.query_blocks(q, "query_id", max_rows=7))
    assert len(blocks) > 1
    assert sorted(r.query_id for b in blocks for r in b.collect()) == list(range(40))


def test_text_match_is_conjunction(spark):
    q = spark.createDataFrame([(1, "rojo azul", None), (2, "Rojo", "x"), (3, "¿?", None)], "query_id int, query_text string, program string")
    c = spark.createDataFrame([
        (1, "rojo verde azul", [1.0], "x"), (2, "rojo", [1.0], "y"), (3, "azul rojo azul", [1.0], "y"), (4, "rojo azul", None, "x")],
        "chunk_id int, content string, embedding array<float>, program string")
    got = {(r.query_id, r.chunk_id): r.rank_score for r in R.text_match(q, c, "simple").collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 1)}
    assert got[(1, 1)] == pytest.approx(0.1 / 2) and got[(1, 3)] == pytest.approx(0.2)


def test_spanish_config_stems_and_drops_stop_words(spark):
    q = spark.createDataFrame([(1, "los requisitos de la admisión")], "query_id int, query_text string")
    c = spark.createDataFrame([(1, "Requisito para admisiones", [1.0]), (2, "requisito", [1.0])], "chunk_id int, content string, embedding array<float>")
    assert [r.chunk_id for r in R.text_match(q, c, "spanish").collect()] == [1]


@pytest.mark.parametrize("config", ["simple", "spanish"])
def test_text_match_with_hot_anchors(spark, config):
    """Equal to reading every pair, with words that stand in most chunks and anchors cut into many parts."""
    import random
    import re

    from atril.functions.stemmer import stem

    rng = random.Random(4)
    words = ["el", "la", "curso", "cursos", "costo", "matrícula", "pensum", "nota", "notas", "de", "sede"]
    texts = [" ".join(rng.choices(words, weights=[30, 20, 9, 9, 3, 2, 2, 1, 1, 20, 1], k=rng.randint(0, 25))) for _ in range(120)] + [None, ""]
    asked = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(30)] + ["curso", "el", "", None, "nadie", "curso nadie"]
    stop = set(R.spanish_stop_words())

    def lexemes(text):
        found = re.findall(r"[^\W]+", (text or "").lower())
        return found if config == "simple" else ["" if w in stop else stem(w) for w in found]

    want = {(q, c) for q, a in enumerate(asked) for c, t in enumerate(texts)
            if (need := set(lexemes(a)) - {""}) and need <= set(lexemes(t))}
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string")
    c = spark.createDataFrame([(i, t, [1.0]) for i, t in enumerate(texts)], "chunk_id int, content string, embedding array<float>")
    got = [(r.query_id, r.chunk_id) for r in R.text_match(q, c, config, span=10).collect()]
    assert set(got) == want and len(got) == len(want)


def test_copies_are_matched_once(spark):
    """Copies of a question and of a text are one pair until the end; equal ids, null ids and filters keep their meaning."""
    asked = [(i, "rojo azul", "x" if i % 2 else None) for i in range(40)] + [(90, "rojo", None), (90, "rojo", None), (91, "verde", None), (91, "nada", None), (None, "rojo", None)]
    texts = [(i, "rojo y azul" if i % 3 else "azul, rojo; verde", [1.0], "xy"[i % 4 // 2]) for i in range(60)] + [(None, "rojo azul", [1.0], "x")]
    q = spark.createDataFrame(asked, "query_id int, query_text string, program string")
    c = spark.createDataFrame(texts, "chunk_id int, content string, embedding array<float>, program string")
    hits, _, _ = R.distinct_matches(q, c, "simple", 20_000)
    assert hits.count() <= 20  # 4 questions, 5 texts
    got = sorted((r.query_id, r.chunk_id, r.rank_score) for r in R.text_match(q, c, "simple").collect())
    score = {i: 0.05 if i % 3 else 0.1 for i in range(60)}
    want = [(i, j, score[j]) for i, _, p in asked[:40] for j in range(60) if p is None or j % 4 < 2] + [(91, j, 0.1) for j in range(0, 60, 3)]
    assert got == sorted(want)
    top = sorted((r.query_id, r.rn, r.chunk_id) for r in R.keyword_topk(q, c, 3, "simple").collect() if r.query_id in (0, 1, 90))
    assert top == [(0, 1, 0), (0, 2, 3), (0, 3, 6), (1, 1, 0), (1, 2, 9), (1, 3, 12)]


def test_words_nobody_asks_for_stay_out(spark):
    """The filter loses no value and lets few others through; what it lets through is no matter for the marks."""
    from atril.operators import scale

    words = spark.range(20_000).selectExpr("id", "concat('w', id) AS word").withColumn("word", F.when(F.col("id") != 7, F.col("word")))
    asked = words.where("id % 40 = 0 OR id = 7").select("word")
    kept = {r.id for r in scale.maybe_in(words, "word", asked).collect()}
    assert kept >= {i for i in range(20_000) if i % 40 == 0 or i == 7} and len(kept) < 700
    assert {r.id for r in scale.surely_not_in(words, "word", asked).collect()} == set(range(20_000)) - kept
    terms = spark.createDataFrame([("azul", 1), ("rojo", 2), ("verde", 3)], "lexeme string, term long")
    c = spark.createDataFrame([(1, "rojo gris azul " + "x" * 30_000 + " Rojo", [1.0]), (2, "gris", [1.0]), (3, "azul", None)],
                              "chunk_id int, content string, embedding array<float>")
    assert [(r.chunk_id, [tuple(m) for m in r.marks]) for r in R.question_marks(terms, c, "simple").collect()] == [(1, [(0, 2), (2, 1), (4, 2)])]


@pytest.mark.parametrize("k", [None, 3])
def test_texts_of_many_copies_and_marks(spark, monkeypatch, k):
    """Copies beyond a class and marks beyond a row change no result; the chunks that ride with a hit are bounded."""
    monkeypatch.setattr(R.S, "MARK_ROWS", 4)
    monkeypatch.setattr(R.text_classes, "__defaults__", (10,))
    texts = [(i, "rojo azul " * (9 if i % 2 else 1) + "verde") for i in range(200)]
    q = spark.createDataFrame([(1, "azul rojo"), (2, "verde"), (3, "verde gris")], "query_id int, query_text string")
    c = spark.createDataFrame([(i, t, [1.0]) for i, t in texts], "chunk_id int, content string, embedding array<float>")
    hits, _, classes = R.distinct_matches(q, c, "simple", 5, k)
    rows = hits.collect()
    assert max(len(r.chunks) for r in rows) < (40 if k is None else 4) and classes.count() == len(rows) / 2 and len(rows) >= 4
    if k is None:
        got = {(r.query_id, r.chunk_id): r.rank_score for r in R.text_match(q, c, "simple", span=5).collect()}
        assert got == {(1, i): pytest.approx(1.7 if i % 2 else 0.1) for i in range(200)} | {(2, i): pytest.approx(0.1) for i in range(200)}
    else:
        got = sorted((r.query_id, r.rn, r.chunk_id) for r in R.keyword_topk(q, c, k, "simple", span=5).collect())
        assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 0), (2, 2, 1), (2, 3, 2)]


def test_keyword_hits_are_cut_before_exclusion(spark):
    kw = spark.createDataFrame([(1, i, i) for i in range(1, 4)], "query_id int, chunk_id int, rn int")
    vec = spark.createDataFrame([(1, 2, 0.9, 1)], "query_id int, chunk_id int, score double, rn int")
    rows = R.hybrid_union(vec, kw).orderBy("ord").collect()
    assert [(r.chunk_id, r.score, r.origin) for r in rows] == [(2, .9, "vector"), (1, .35, "keyword"), (3, .35, "keyword")]


def test_expand_queries_falls_back(spark):
    q = spark.createDataFrame([(1, "hola")], "query_id int, query_text string")

    def broken(texts):
        raise RuntimeError

    assert R.expand_queries(q, broken).first().embed_text == "hola"
    many = spark.createDataFrame([(i, f"pregunta {i}") for i in range(50)], "query_id int, query_text string").coalesce(1)
    calls = []

    def picky(texts):
        calls.append(len(texts))
        if "pregunta 33" in texts:
            raise RuntimeError
        return [f"sobre {t}" if t != "pregunta 7" else " " for t in texts]

    got = {r.query_id: r.embed_text for r in R.expand_queries(many, picky).collect()}
    assert got == {i: f"pregunta {i}" if i in (33, 7) else f"sobre pregunta {i}" for i in range(50)}
    assert R.halving(picky, ["a", "pregunta 33", "b"]) == ["sobre a", None, "sobre b"] and calls == [3, 1, 2, 1, 1]
    assert R.halving(lambda ts: ts[1:], ["a", "b"]) == [None, None]
    vectors = R.embed_queries(many, picky, lambda ts: [[float(len(t))] for t in ts]).where("query_id IN (8, 33)")
    assert {r.query_id: r.query_embedding for r in vectors.collect()} == {8: [16.0], 33: [11.0]}
    assert R.expand_queries(q, lambda ts: ["respuesta" for _ in ts]).first().embed_text == "respuesta"


def test_log_has_a_row_without_results(spark):
    q = spark.createDataFrame([(1, "a" * 3000), (2, "b")], "query_id int, query_text string")
    res = spark.createDataFrame([(1, 1, 7, .5, "t")], "query_id int, rank int, chunk_id int, score double, document_title string")
    log = {r.query_id: r for r in R.retrieval_log(res, q).collect()}
    assert len(log[1].query_text) == 2000 and log[1].top_score == .5 and log[2].chunks_retrieved == [] and log[2].top_score is None


def test_near_dup_classes(spark):
    from atril.operators import near_dup

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    base = [list(rng.choice(words, 14, replace=False)) for _ in range(12)]
    texts = [" ".join(rng.permutation(b)) for b in base for _ in range(3)]
    texts += [" ".join([*b[: 14 - k], *rng.choice(words, k)]) for b in base for k in (1, 2, 3)]
    texts += [None, "", "   ", "uno", "uno", "UNO  uno", base[0][0]] + [" ".join(base[1])] * 40
    rows = list(enumerate(texts))

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    sets = [set((t or "")[:300].lower().split()) for t in texts]
    near = {i: {j for j in range(len(sets)) if i != j and jaccard(sets[i], sets[j]) > 0.7} for i in range(len(sets))}
    want = set()
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        want.add((i, min(seen), len(near[i])))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, node int")
    got = [tuple(r) for r in near_dup.near_dup_classes(df, "doc_id", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    assert near_dup.near_dup_classes(df.limit(0), "doc_id", "text").count() == 0


def test_near_dup_frequent_words(spark, monkeypatch):
    """Sets with a frequent word meet on it and the next shared one: links as by brute force, no large meeting."""
    from pyspark.sql import functions as F

    from atril.operators import near_dup

    monkeypatch.setattr(near_dup, "MEETING", 12)
    test_near_dup_classes(spark)
    rng = np.random.default_rng(7)
    drawn = {tuple(sorted(rng.choice(40, int(n), replace=False).tolist())) for n in rng.integers(1, 7, 400)}
    sets = spark.createDataFrame([(i, 1, " ".join(f"w{w}" for w in s)) for i, s in enumerate(sorted(drawn))], "id long, copies long, head string")
    words = [set(s) for s in sorted(drawn)]
    for limit in (.3, .7):
        want = {(i, j) for j, b in enumerate(words) for i, a in enumerate(words[:j]) if len(a & b) / len(a | b) > limit}
        got = [(r.a, r.b) for r in near_dup.near_dup_links(sets, limit).collect()]
        assert set(got) == want and len(got) == len(want)
    met = near_dup.meeting_rows(near_dup.ordered_sets(sets), .7)
    assert max(met.groupBy("word").count().toPandas()["count"]) > 12 >= max(met.groupBy("word", "second").agg(F.count("*").alias("n")).toPandas()["n"])
