"""Text operators against brute force, on small tables with nulls, empty texts, repeated rows and other columns."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atril.llm import byte_bpe, lattice, packing, secret_scan, setjoin, suffixes, toxicity, warc
from atril.llm.common import components, held_out

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    passage, base = prose(60), prose(150).split(" ")
    near = [" ".join(base[:i] + [prose(1)] + base[i + 1 :]) for i in range(5, 145, 9)]
    out = [None, "", "  \n\t", "one", "one two three", prose(400), "x" * 30_000, "é" * 500 + " ü " + "é" * 500]
    out += [prose(30) + " " + passage + " " + prose(30) for _ in range(4)] + near + [prose(80)] * 3 + [prose(120) for _ in range(10)]
    return list(enumerate(out)) + [(7, out[7]), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", "c", 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component string, n long, at string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_byte_bpe(docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tool = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in texts:
        ids = tool.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, texts=True)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert rows_of(got, "doc_id", "decoded") == sorted(((i, t or "") for i, t in texts), key=repr)
    assert byte_bpe.encode_decode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="ab \n'st1é中", max_size=60))
def test_byte_bpe_any_text(a, b):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tool = byte_bpe.codec(path, public_tokenizers.PATTERN)
    if not hasattr(test_byte_bpe_any_text, "own"):
        test_byte_bpe_any_text.own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for text in (a, b, a + " " + b):
        ids = tool.encode(text)
        assert ids == test_byte_bpe_any_text.own.encode_ordinary(text)
        assert "".join(c for _, c in tool.decode(ids)) == text


@given(st.text(max_size=40), st.integers(1, 5))
def test_utf8_stream(text, step):
    data, stream = text.encode(), byte_bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.feed(b"", True) == text


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = sorted(((i, Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts), key=repr)
    got = packing.pack(docs, path, length=256).collect()
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    by_doc = {}
    for i, x in ids:
        by_doc.setdefault(i, []).append(x)
    for r in got:
        assert any(
            zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in by_doc[r.doc_id]
        )
    assert packing.pack(docs.limit(0), path).count() == 0


def test_patterns_cover_the_demand():
    rng = random.Random(3)
    demand = {s: rng.randint(0, 400) for s in range(1, 257)}
    found = packing.solve_patterns(demand, 256)
    assert all(sum(s * n for s, n in p.items()) <= 256 for p, _ in found)
    for s, n in demand.items():
        assert sum(p[s] * times for p, times in found) >= n
    least = math.ceil(sum(s * n for s, n in demand.items()) / 256)
    assert least <= sum(times for _, times in found) <= len(packing.first_fit(demand, 256))


def test_byte_bpe_keeps_what_is_asked_for_again(monkeypatch):
    """When there are too many chunks those asked for again stay; results don't depend on the limits."""
    import tiktoken

    monkeypatch.setattr(byte_bpe, "MAX_CHUNKS", 40)
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 60)
    ranks = byte_bpe.read_ranks(path := public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tool, own = byte_bpe.Codec(path, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made, make = [], tool.met.make
    tool.met.make = lambda chunk: made.append(chunk) or make(chunk)
    for i in range(60):
        text = f"a zzyzx {prose(9)} {i}qx  two\n {prose(3)}"
        assert tool.decimal(text) == (",".join(map(str, own.encode_ordinary(text))), text.encode())
        assert len(tool.met) + len(tool.met.earlier) < 80
    assert made.count("zzyzx") == 1
    for left, right in ((a, b) for a in RNG.sample(sorted(ranks.values()), 60) for b in RNG.sample(sorted(ranks.values()), 60)):
        parts = [tool.machine.token[left], tool.machine.token[right]]
        if all(byte_bpe.merge(p, ranks) == [ranks[p]] for p in parts):
            assert tool.machine.follows(left, right) == (byte_bpe.merge(b"".join(parts), ranks) == [left, right])


def brute_classes(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return [(texts[i][0], len(sets[i]), root[i]) for i in range(len(sets))]


def test_jaccard_classes(docs, texts):
    want = brute_classes(texts)
    least = {}
    for i, _, r in want:
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = [(i, n, least.get(r, i)) for i, n, r in want]
    assert rows_of(setjoin.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)
    assert setjoin.jaccard_classes(docs.limit(0)).count() == 0


def test_jaccard_matrix_finds_what_pivots_miss(spark, texts, docs, monkeypatch):
    """Without any link from the pivots, the matrix alone gives the same classes."""
    monkeypatch.setattr(setjoin, "_with_pivots", lambda docs, sets, least: spark.createDataFrame([], "a long, b long"))
    test_jaccard_classes(docs, texts)


def test_jaccard_bitmaps():
    """No pair that is linked is left out by the bitmaps, most of the others are."""
    rng, kept, far = np.random.default_rng(3), 0, 0
    for n in (1, 2, 3, 31, 32, 33, 400, 900):
        for share in (0, .1, .3, .7, .8, .86, .9, 1):
            for more in (0, .1, .3):
                a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
                b = np.unique(np.concatenate([a[: round(share * n)], rng.integers(-(1 << 63), 1 << 63, round((1 - share + more) * n))]))
                if not len(b):
                    continue
                x, y = (np.frombuffer(setjoin.sketch(t), np.uint64) for t in (a, b))
                able = setjoin.may_link(x, len(a), [y], np.array([len(b)]), 75)[0]
                assert able or not setjoin.linked(a, b, 75)
                assert able == setjoin.may_link(y, len(b), [x], np.array([len(a)]), 75)[0]
                if n > 30 and share <= .3:
                    kept, far = kept + able, far + 1
    assert far and not kept


def test_jaccard_texts_fetched(spark, monkeypatch):
    """Sets that share a few rare tokens only fetch no texts."""
    fetched, fetch = [], setjoin._texts
    monkeypatch.setattr(setjoin, "_texts", lambda docs, sets, wanted: fetched.append(wanted.count()) or fetch(docs, sets, wanted))
    passage = prose(40)
    docs = spark.createDataFrame([(i, prose(60) + " " + passage) for i in range(30)], "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in setjoin.jaccard_classes(docs).collect())
    assert fetched == [0, 0]


def brute_repeats(texts, length=suffixes.LENGTH):
    data = [(t or "").encode() for _, t in texts]
    seen = {}
    for d in data:
        for j in range(len(d) - length + 1):
            seen[d[j : j + length]] = seen.get(d[j : j + length], 0) + 1
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        gone = set()
        for j in range(len(d) - length + 1):
            if seen[d[j : j + length]] > 1:
                gone.update(range(j, j + length))
        spans = sum(1 for j in gone if j - 1 not in gone)
        out.append((i, len(d), len(gone), spans, hashlib.sha256(bytes(b for j, b in enumerate(d) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("together", [4000, 2])
def test_repeats(docs, texts, together, monkeypatch):
    """In sorted groups, and with every larger group counted by prefix."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    got = suffixes.cut_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == brute_repeats(texts)
    assert got[0].at == "x" and suffixes.cut_repeats(docs.limit(0)).count() == 0


@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(symbols):
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert suffixes.suffix_array(np.array(symbols, np.int64)).tolist() == want


def test_secrets(spark):
    key, hexes = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef0123456789abcdef01"
    rows = [
        (1, f"x Password = 'hunter2hunter' and {key} end"), (2, f"{hexes} token: abc"), (3, None), (4, ""),
        (5, "password: token: abcdefgh1"), (6, "AKIASHORT and secret=1234567"), (6, f"é𝄞 {hexes}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secret_scan.scan(docs, secret_scan.train(docs))
    keys = "|".join(["password", "passwd", "secret", "token", "api_?key"])
    want = []
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"(?ai)({keys})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((i, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    masked = {r.doc_id: r.text for r in secret_scan.mask(docs, secret_scan.train(docs)).collect() if r.doc_id < 6}
    assert masked[1] == "x <assign>' and <access> end" and masked[3] is None


def test_inferred_format():
    from collections import Counter

    rng = random.Random(1)
    made = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = ["".join(rng.choice(["the", "ing", "ver", "sch", "lich"]) for _ in range(6)) for _ in range(300)]
    of = lambda xs: secret_scan.infer(Counter(map(secret_scan.symbols, xs)))
    automata = {"assign": of([made(18) for _ in range(300)]), "access": of([]), "hex": of([made(40) for _ in range(300)]), secret_scan.ADDED: of(words)}
    assert sum(secret_scan.ratio(made(18), automata) >= secret_scan.MIN_RATIO for _ in range(100)) > 95
    assert not any(secret_scan.ratio(w, automata) >= secret_scan.MIN_RATIO for w in words)
    assert abs(sum(10 ** p for _, p in automata["hex"].states[0].values()) - 1) < 0.05


def test_toxicity(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        found = prose(40, rng).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                found[rng.randrange(40)] = rng.choice(["zonk", "blarg", "quuxate", "quuxion"])
        rows.append((i, " ".join(found), int(i % 4 == 0)))
    labelled = spark.createDataFrame(rows + [(900, None, 0), (901, "", 0), (902, "x", None)], "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(labelled)
    asked = [(1, prose(20, rng) + " z0nk blаrg"), (2, prose(30, rng)), (3, None), (4, "")]  # a digit, a Cyrillic letter
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string").selectExpr("*", "0.5 AS score"), lexicon).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and 0 <= got[3].score == got[4].score < 0.5
    spared = toxicity.Lexicon(lexicon.weights, ("zonk friends",), lexicon.slope, lexicon.offset)
    assert spared.score("our zonk friends")[1] == 0 and spared.score("our zonk enemies")[1] == 1
    assert toxicity.fit(labelled.where("toxic = 0")).score("zonk")[0] < 0.5


def test_toxicity_learns_exceptions(spark):
    """A phrase seen in clean documents only spares its hits; one also seen in a toxic document, or in few, doesn't."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        extra = rng.choice(["zonk", "blarg"]) + " " + prose(1, rng) if i % 4 == 0 else ""
        extra = {1: "ZÖNK friends", 2: "zonk meeting"}.get(i % 16, extra)
        rows.append((i, f"{prose(20, rng)} {extra} {prose(20, rng)}", int(i % 4 == 0)))
    rows += [(900, prose(30, rng) + " zonk meeting", 1), (901, prose(30, rng) + " blarg garden", 0)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), ("blarg museum",))
    assert lexicon.exceptions == ("blarg museum", ("zonk", "friends"))
    for asked, n in (("our zonk friends", 0), ("our zonk meeting", 1), ("blarg garden", 1), ("zonk friends zonk", 1), ("blarg museum", 0)):
        assert lexicon.score(asked)[1] == n


def test_toxicity_curve_weighs_points_by_their_rows(spark, monkeypatch):
    """The curve gets every sampled row once, however many rows are left out, and cells count by their rows."""
    rows = [(i, "zonk blarg " * (1 + i // 4 % 40) if i % 4 == 0 else "plain words", int(i % 4 == 0)) for i in range(1200)]
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda points, fit=toxicity._logistic: seen.append(points) or fit(points))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.fit(labelled, bound=300)
    sampled = [r for r in labelled.selectExpr("toxic", "pmod(xxhash64(doc_id), 1000000) < 250000 AS used").collect() if r.used]
    assert {y: sum(n for _, y_, n in seen[0] if y_ == y) for y in (0, 1)} == {y: sum(r.toxic == y for r in sampled) for y in (0, 1)}
    clean, toxic = (0.0, 0, 27_000), [(0.001 * i, 1, 30) for i in range(1, 101)]
    a, b = toxicity._logistic([clean, (0.0, 1, 3_000), *toxic])
    assert toxicity._logistic([(x, y, 10 * n) for x, y, n in (clean, (0.0, 1, 3_000), *toxic)]) == pytest.approx((a, b))
    assert toxicity._logistic([clean] + [(0.0, 1, 30)] * 100)[1] == pytest.approx(math.log(3_000 / 27_000), abs=0.01)


def test_lattice_sums_over_segmentations():
    scores = {p: math.log(x) for p, x in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.3, "▁a": 0.2, "<0xC3>": 0.05, "<0xA9>": 0.05}.items()}
    tree = lattice.Lattice(scores)

    def brute(word):
        return 1.0 if not word else sum(math.exp(s) * brute(word[len(p) :]) for p, s in scores.items() if word.startswith(p))

    for word in ("▁a", "▁ab", "▁abab", "▁ba"):
        assert math.isclose(math.exp(tree.score(word)), brute(word))
        uses = {}
        tree.expected(word, 2.0, uses)
        assert math.isclose(sum(len(p) * n for p, n in uses.items()), 2.0 * len(word))
    assert math.isclose(math.exp(tree.score("▁é")), 0.1 * 0.05 * 0.05)


def test_lattice_likelihood(docs, texts):
    got = {(r.doc_id, r.n_tokens): r for r in lattice.score(docs, ~held_out(7, 2), public_tokenizers.path("piece_bpe_32k.model"), hot=50).collect()}
    kept, counts, n = [], {}, 0
    for i, t in texts:
        tokens = [*(t or "").encode().lower().split(), None]
        kept.append((i, tokens, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2))
        if not kept[-1][2]:
            n += len(tokens)
            for w in tokens:
                counts[w] = counts.get(w, 0) + 1
    assert len(got) <= len(texts)
    for i, tokens, out in kept:
        r = got[i, len(tokens)]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in tokens)
        assert (r.held_out, r.n_known, r.train_tokens) == (out, sum(w in counts for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lattice.score(docs.limit(0), ~held_out(7, 2), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_warc(spark):
    rows = [(3, "http://a/é", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (9, "u\r\nX: y", "WARC/1.1\r\n\r\n"), (4, "u", "long " * 5000), (4, "u", "long " * 5000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    first, want = {}, []
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        data, f = (h or "").encode(), first[h or ""]
        kind = ("response", None) if i == f else ("revisit", f)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind))
    got = warc.archive(pages, archive_bytes=4000)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
