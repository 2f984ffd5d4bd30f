"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atril.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    return a != b and any(
        (a[:k] + b[k] + a[k + (len(a) == len(b)) :] == b) for k in range(len(b))
    ) and len(b) - len(a) <= 1


def vocabulary(rows, least=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= least}


def variants(words):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abc", max_size=7), max_size=40), st.integers(0, 9), st.integers(0, 10))
def test_list(words, s, high):
    words = sorted(words)
    want = {(a, b) for b in range(len(words)) for a in range(b) if one_edit(words[a], words[b])
            and min(len(words[a]), len(words[b])) == s and spelling.common_prefix(words[a], words[b]) < high}
    got = list(spelling.near_in_list(words, s, high))
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("group", [2, 64])
def test_near_words(spark, group):
    """Hot lists: a third of all words begin alike, another third end alike."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abß") for _ in range(k))
    words = {word(rng.randint(1, 9)) for _ in range(150)} | {"common" + word(rng.randint(1, 5)) for _ in range(150)} | {word(rng.randint(1, 5)) + "ending" for _ in range(150)}
    words |= {"x" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499, ""}
    words = {w: rng.randint(1, 10 ** rng.randint(1, 6)) for w in sorted(words)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    if group == 2:
        got = {r.word: (r.near, r.best, r.best_n) for r in spelling.near_words(df, group).collect()}
        want = {}
        for w in words:
            near = [x for x in words if one_edit(w, x)]
            if near:
                best = min(near, key=lambda x: (-words[x], x))
                want[w] = (len(near), best, words[best])
        assert got == want
    else:
        rows = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert {tuple(r) for r in rows} == variants(words) and len(rows) == len(words)


def test_documents(spark):
    rng = random.Random(3)
    letters = "aeilnorstéß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(60)]
    rows = []
    for i in range(300):
        picked = [rng.choice(base[: 6 if rng.random() < 0.8 else 60]) for _ in range(40)]
        picked += [w[:k] + rng.choice(letters) + w[k + 1 :] for w in rng.sample(base, 6) for k in [rng.randrange(len(w))]]
        rows.append((i, rng.choice([" ", ", ", "\n", "3"]).join(picked).title() if i % 4 else " ".join(picked)))
    rows += [(1, None), (2, ""), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (400, "×÷ÀÿABCDEF z" * 3), (401, "long" * 9000)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, word string, form string")
    words = vocabulary(rows)
    assert {(r.word, r.n) for r in spelling.vocabulary(df).collect()} == set(words.items())
    got = spelling.variants(spelling.vocabulary(df)).collect()
    assert {tuple(r) for r in got} == variants(words) and len(got) == len(words)
    assert any(r.form for r in got)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_chain(spark):
    """Forms are followed to the last one."""
    words = {"a" * 7 + "b" * k: 10**k for k in range(6)}
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {tuple(r) for r in rows} == variants(words)
    assert {r.root for r in rows} == {"a" * 7 + "b" * 5}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    words = vocabulary(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = queries.op12_spelling(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == variants(words)
