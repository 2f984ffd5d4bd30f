"""Vector operators, the registered queries and the pipeline."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from atril.llm import hnsw, mtree, queries
from tests.parity import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + rng.normal(size=8) * 0.12).astype(np.float32).tolist(), i % 3) for i in range(600)]
    rows += [(600 + i, rows[0][1], 0) for i in range(5)] + [(700, None, 1), (701, [0.0] * 8, 1), (702, [float("nan")] * 8, 1), (703, [1.0, None], 1)]
    rows += [(704, [float("inf")] * 8, 1), (705, rows[1][1], None), (706, [1.0, 2.0], 1), (707, [], 1), (800, rows[2][1], 9), (None, rows[3][1], 0)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")


def test_mtree(vectors):
    rows, df = vectors
    v = mtree.quantise(df)
    got = mtree.search(v.where("vec_id % 100 = 0"), mtree.build(v, shard_rows=100, page=8), 10).collect()
    good = {i: np.floor(1024 * np.array(x, float)).astype(np.int64) for i, x, _ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    want = set()
    for q in (i for i in good if i % 100 == 0):
        found = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q and len(x) == len(good[q]))[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert mtree.search(v.limit(0), mtree.build(v)).count() == 0


@pytest.mark.parametrize("shard_rows", [60, 5000])
def test_hnsw(vectors, shard_rows):
    rows, df = vectors
    n = len(rows)
    fit = [x is not None and len(x) > 0 and y is not None and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x, y in rows]
    links, root = [0] * n, list(range(n))
    for a in range(n):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                p, q = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = [new if r == old else r for r in root]
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = {(rows[k][0], links[k], least.get(root[k]), rows[k][0] == least.get(root[k])) for k in range(n)}
    got = {tuple(r) for r in hnsw.near_duplicates(df, shard_rows=shard_rows).collect()}
    right = sum(links[k] for k in range(n))
    assert sum(g[1] for g in got) >= 0.99 * right
    assert len(got & want) >= 0.99 * len(want)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 16))
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    q, p = hnsw.audited_links(hnsw.Graph.build(points), points[:400], 0.75)
    true = int((points[:400] @ points.T >= 0.75).sum())
    assert len(set(zip(q.tolist(), p.tolist(), strict=True))) >= 0.99 * true


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_parity(spark, key):
    ok, info = compare(spark, duck(SF), key, queries.QUERIES[key], queries.ORACLES[key], SF)
    assert ok, info


def test_pipeline_stages(spark):
    """Stage by stage: what stays, what goes, and that the columns stay those of documents."""
    from atril.llm import stages
    from atril.llm.common import table

    docs = table(spark, SF, "documents").selectExpr("*", "1 AS extra")
    plain = stages.drop_toxic(spark, docs, SF)
    assert plain.columns == docs.columns and 0 < plain.count() <= docs.count()
    single = stages.one_per_group(spark, docs, SF)
    classes = queries.QUERIES["op7_ngram_jaccard"](spark, SF)
    assert single.columns == docs.columns and single.count() == classes.select("component_id").distinct().count()
    cut = stages.cut_repeats(spark, docs, SF)
    repeats = {r.doc_id: r for r in queries.QUERIES["op10_suffix_array"](spark, SF).collect()}
    assert {r.doc_id for r in cut.collect()} == {i for i, r in repeats.items() if r.n_removed < r.n_bytes or not r.n_bytes}
    masked = stages.mask_secrets(spark, docs, SF)
    assert masked.columns == docs.columns and masked.where("text RLIKE 'AKIA[A-Z0-9]{12}'").count() == 0


def test_one_row_of_each_class(spark):
    """Null and repeated ids: a row of every class stays, copies go, and texts without words all stay."""
    from atril.llm import stages

    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    near = texts["a"].replace("a39", "other")
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (None, texts["c"]), (3, texts["d"]), (None, texts["d"]), (4, near), (5, texts["a"]),
            (6, texts["e"]), (6, texts["f"]), (6, texts["f"]), (7, texts["e"]), (4, texts["g"]), (8, None), (8, " \n"), (None, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ____ string").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in stages.one_per_group(spark, docs, SF).select("doc_id", "text").collect()), key=repr)
    want = [(None, texts["b"]), (None, texts["c"]), (3, texts["d"]), (4, near), (6, texts["e"]), (6, texts["f"]), (4, texts["g"])] + rows[13:]
    assert got == sorted(want, key=repr)


CLASHING = ["_text", "_key", "_maybe", "_found", "score", "predicted", "n_hits", "kept", "n_bytes", "n_removed", "n_spans", "sid", "row", "a b"]


def clashing(spark, rows):
    """A documents table with nulls and columns named like those the operators use, one a struct with a space in a field's name."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHING})
    return docs.withColumn("with space", F.struct(F.col("doc_id").alias("a field"), F.lit(None).cast("string").alias("b")))


@pytest.mark.parametrize("name", ["drop_toxic", "one_per_group", "cut_repeats", "mask_secrets"])
def test_stages_keep_any_columns(spark, name):
    """Columns of any name come back as they were; nulls, empty texts, repeated rows and empty tables have their stated result."""
    from atril.llm import stages

    stage = getattr(stages, name)
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", " \n", "short", f"one two {passage} three", f"four {passage} five six", "token = abcdefgh12345678 rest", "plain � sign"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(3, "short", "en", "s", 5), (None, None, None, None, None), (None, "alone", None, None, 5)]
    docs = clashing(spark, rows)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    before = {(r.doc_id, *(r[c] for c in CLASHING), r["with space"]) for r in docs.collect()}
    after = got.collect()
    assert {(r.doc_id, *(r[c] for c in CLASHING), r["with space"]) for r in after} <= before
    kept = sorted(((r.doc_id, r.text) for r in after), key=repr)
    changed = {"mask_secrets": {6: "<assign> rest"}}.get(name, {})
    if name in ("drop_toxic", "mask_secrets"):
        assert [d for d, _ in kept] == [d for d, *_ in sorted(((r[0], r[1]) for r in rows), key=repr)] and len(kept) == len(rows)
        assert all(t == texts[d] or d in (4, 5, *changed) for d, t in kept if d is not None)
    if name == "one_per_group":
        assert [d for d, _ in kept].count(3) == 1 and [d for d, _ in kept].count(None) == 2
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_replacement_characters_stay(spark):
    """A genuine U+FFFD outside the passages stays, and characters cut in two go as a whole."""
    from atril.llm import stages

    shared = "é" * 150
    rows = [(1, "a� " + "x" + shared + "y � end", "en", "s", 0), (2, "b" + shared + "ü", "en", "s", 0), (3, "c � alone", "en", "s", 9)]
    cut = {r.doc_id: (r.text, r.n_chars) for r in stages.cut_repeats(spark, clashing(spark, rows), SF).collect()}
    # The first byte of the letter behind the second passage is the same as in the passage, so that letter is cut in two.
    assert cut == {1: ("a� xy � end", 11), 2: ("b", 1), 3: ("c � alone", 9)}


def test_whole_characters():
    from atril.llm.suffixes import whole_characters

    data = np.frombuffer("aéb日c".encode(), np.uint8)
    assert whole_characters(data, [(2, 4)]) == [(1, 4)] and whole_characters(data, [(0, 2)]) == [(0, 3)]
    assert whole_characters(data, [(5, 6)]) == [(4, 7)] and whole_characters(data, [(3, 4)]) == [(3, 4)]


def test_toxicity_of_odd_tables(spark):
    from atril.llm import toxicity

    lexicon = toxicity.Lexicon({" zonk ": 5.0}, (), 20.0, -1.0)
    docs = clashing(spark, [(1, "zonk", "en", "s", 4), (1, "zonk", "en", "s", 4), (2, None, None, None, None), (None, "fine words", None, None, None)])
    got = toxicity.score(docs, lexicon)
    assert set(docs.columns) - {"score", "predicted", "n_hits"} <= set(got.columns)
    assert sorted(((r.doc_id, r.n_hits, r.score == lexicon.score(r.text or "")[0], r._text is None) for r in got.collect()), key=repr) == sorted(
        [(1, 1, True, False), (1, 1, True, False), (2, 0, True, False), (None, 0, True, False)], key=repr)
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.fit(empty).weights == {} and toxicity.fit(empty).score("zonk")[0] < 0.5


def test_labelled_sample(spark):
    """Labels decide the sample: nulls and other values are out, the bound holds about, and no text is shuffled for it."""
    from atril.llm import toxicity

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(2001, None), (2002, 7), (None, 1), (9999, 1)], "doc_id long, toxic int")
    whole = toxicity.labelled_texts(docs, labels)
    assert {(r.doc_id, r.text, r.toxic) for r in whole.collect()} == {(i, f"t{i}", i % 2) for i in range(2000)}
    assert 300 < toxicity.labelled_texts(docs, labels, 500).count() < 700


def test_batches_are_bounded_by_bytes(spark):
    """Whole texts reach Python in batches of some megabytes, whatever their number of rows; a bound of the session's own stays."""
    from atril.llm import common

    def sizes(docs):
        return [r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound, None)
    try:
        spark.conf.unset(bound)
        docs = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id as string), 1000) AS text")
        common.hold_batches(spark)
        assert 2 < len(found := sizes(docs)) and max(found) < 1.1 * common.BATCH_BYTES
        spark.conf.set(bound, 1 << 20)
        common.hold_batches(spark)
        assert int(spark.conf.get(bound)) == 1 << 20
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_worker_a_task(spark):
    """Texts without a repeat pass one Python step, and the patterns of the packing reach Spark without Python workers."""
    from atril.llm import packing, suffixes

    docs = spark.createDataFrame([(i, f"{i} " + "same words again " * 20) for i in range(50)], "doc_id long, text string")
    # Only texts that may hold a repeat go through the step that cuts.
    assert plan(suffixes.cut_repeats(docs)).count("MapInArrow cut") == 1
    packed = packing.pack(spark.read.schema(docs.schema).parquet(f"{SF}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    assert "ExistingRDD" not in plan(packed)
