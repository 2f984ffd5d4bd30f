"""Documents joined by the Jaccard similarity of their word n-grams, with a token-group matrix (operator 7).

Equal sets are one set.  Sets that share a min-hash form groups of at most `GROUP` similar sets; first every set
is compared with the pivot of its groups, which already connects the large classes.  Then the matrix of tokens
and groups finds what is left: a set may only be linked to a member of a group if enough of its tokens occur in the
union of the group's.  By the order of tokens (rare ones first) it is enough to meet on one of the first tokens of
both; groups met are opened if the overlap with their whole union reaches the bound and if they
hold a set that isn't yet connected to the one asked for.  Before any text is fetched, bitmaps of the sets, some bits a
token, leave out pairs that can't be linked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atril.llm.common import Sieve, arrow_map, components, corpus_text, materialise

SHINGLE = 5
GROUP = 64
KEYS = 4
#: One document in so many shows which tokens are frequent; that decides their order, never a result.
ORDER_SHARE = 16
#: Frequent tokens at most; further ones keep their place by hash.
FREQUENT = 500_000
#: The bitmap by which tasks know them (2 MB).
FREQUENT_BITS = 24
#: Sets that ask the same group, compared together.
ASKING = 256

_BASE = 0x9E3779B97F4A7C15 | 1
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_IN_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest text met."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for place, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[place] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `SHINGLE` words (fewer words: of all of them)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.int64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    run = min(SHINGLE, len(words))
    size = len(words) - run + 1
    hashes = words[:size].copy()
    for k in range(1, run):
        hashes *= _NEXT
        hashes += words[k : k + size]
    hashes = np.sort(mix(hashes).view(np.int64))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _unpacked(packed: bytes) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass"))


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """100 * intersection >= least * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < least * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= least * (len(a) + len(b) - common)


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of two to four bits a token, its length a power of two; the low bits of a token set its bit."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[tokens & (size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size))


def may_link(a: np.ndarray, n: int, others: list[np.ndarray], sizes: np.ndarray, least: int) -> np.ndarray:
    """Whether a set of `n` tokens with the bitmap `a` (64-bit words) may be `linked` with each of the others.

    A bit one bitmap has and the other lacks is a token the other set lacks; the longer bitmap is folded first.
    """
    able = 100 * np.minimum(n, sizes) >= least * np.maximum(n, sizes)
    for i in np.flatnonzero(able):
        size = min(len(a), len(others[i]))
        x, y = _folded(a, size), _folded(others[i], size)
        both = int(np.bitwise_count(x & y).sum())
        most = min(n - int(np.bitwise_count(x).sum()), int(sizes[i]) - int(np.bitwise_count(y).sum())) + both
        able[i] = 100 * most >= least * (n + int(sizes[i]) - most)
    return able


def _signatures(docs: DataFrame) -> DataFrame:
    # Tokens are evenly spread already, so a product with an odd number orders them anew.
    salts = (mix(np.arange(1, KEYS + 1, dtype=np.uint64)) | np.uint64(1))[:, None]

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n", "sid", "bits", *(f"k{i}" for i in range(KEYS)))}
        for text in batch["text"]:
            tokens = shingles(text)
            out["n"].append(len(tokens))
            out["sid"].append(set_id(tokens) if len(tokens) else None)
            out["bits"].append(sketch(tokens) if len(tokens) else None)
            least = (tokens.view(np.uint64) * salts).min(axis=1).view(np.int64).tolist() if len(tokens) else [None] * KEYS
            for i, key in enumerate(least):
                out[f"k{i}"].append(key)
        return {"doc_id": batch["doc_id"], "row": batch["row"], **out}

    keys = ", ".join(f"k{i} long" for i in range(KEYS))
    return materialise(arrow_map(_named_rows(docs), rows, f"doc_id long, row long, n long, sid long, bits binary, {keys}"), "signatures")


def _named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and `row`, a hash of both."""
    return corpus_text(docs).withColumn("row", row_hash())


def row_hash() -> Column:
    """What names a row in `stand_ins`: a hash of doc_id and text, null texts as empty ones."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(`sid`, `packed`) of the sets in `wanted`, one compressed text each; only those texts are shuffled."""
    one = sets.join(wanted, "sid").select("sid", "row")
    sieve = Sieve(one, "row")

    def rows(batch: dict[str, list]) -> dict[str, list]:
        keep = np.flatnonzero(sieve(np.array(batch["row"], np.int64)))
        pack = zstandard.ZstdCompressor(level=1).compress
        return {"row": [batch["row"][i] for i in keep], "packed": [pack(batch["text"][i].encode("utf-8", "surrogatepass")) for i in keep]}

    found = arrow_map(_named_rows(docs).select("row", "text"), rows, "row long, packed binary")
    return found.join(one, "row").dropDuplicates(["row"]).select("sid", "packed")


def _able_pairs(sets: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """The rows (`sid`, `pivot`) of `pairs` whose bitmaps leave a link possible."""
    own = sets.select("sid", "n", "bits")
    both = pairs.join(own, "sid").join(own.select(F.col("sid").alias("pivot"), F.col("n").alias("m"), F.col("bits").alias("other")), "pivot")

    def rows(batch: dict[str, list]) -> dict[str, list]:
        keep = [i for i, (x, n, y, m) in enumerate(zip(batch["bits"], batch["n"], batch["other"], batch["m"], strict=True))
                if may_link(np.frombuffer(x, np.uint64), n, [np.frombuffer(y, np.uint64)], np.array([m]), least)[0]]
        return {"sid": [batch["sid"][i] for i in keep], "pivot": [batch["pivot"][i] for i in keep]}

    return arrow_map(both, rows, "sid long, pivot long")


def _with_pivots(docs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links (a, b) between each set and the pivots of its groups, the smallest set id of each."""
    long = sets.select("sid", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("key")) for i in range(KEYS)))).alias("k")).select("sid", "k.i", "k.key")
    pivots = long.groupBy("i", "key").agg(F.min("sid").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    pairs = long.join(pivots, ["i", "key"]).where("sid <> pivot").select("sid", "pivot").distinct()
    pairs = materialise(_able_pairs(sets, pairs, least), "pairs")
    texts = materialise(_texts(docs, sets, pairs.select("sid").unionByName(pairs.select(F.col("pivot").alias("sid"))).distinct()), "texts")
    both = pairs.join(texts, "sid").join(texts.select(F.col("sid").alias("pivot"), F.col("packed").alias("other")), "pivot")

    def rows(batch: dict[str, list]) -> dict[str, list]:
        met: dict[int, np.ndarray] = {}
        keep = []
        for i, (pivot, text, other) in enumerate(zip(batch["pivot"], batch["packed"], batch["other"], strict=True)):
            if pivot not in met:
                met[pivot] = _unpacked(other)
            if linked(_unpacked(text), met[pivot], least):
                keep.append(i)
        return {"a": [batch["sid"][i] for i in keep], "b": [batch["pivot"][i] for i in keep]}

    return materialise(arrow_map(both, rows, "a long, b long"), "links")


def _frequent(docs: DataFrame) -> np.ndarray:
    """A bitmap of the tokens most frequent among one document in `ORDER_SHARE`; few others share their bits."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        return {"token": pa.array(np.concatenate([shingles(t) for t in batch["text"]] or [np.empty(0, np.int64)]))}

    part = corpus_text(docs).select("text").distinct().where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0)
    counted = arrow_map(part, rows, "token long").groupBy("token").count().where("count >= 4")
    bits = np.zeros(1 << FREQUENT_BITS, bool)
    bits[np.array([r.token for r in counted.orderBy(F.desc("count"), "token").limit(FREQUENT).toLocalIterator()], np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little")


def _first_tokens(docs: DataFrame, frequent, least: int, chosen: Sieve, sieve: Sieve | None) -> DataFrame:
    """(`token`, `sid`, `n`, `index`): the first tokens of each set, rare ones first; `index`: also among those
    by which a set is found by one at least as large.  `chosen` passes a row of every set.  With `sieve`, only
    tokens that pass it."""
    other = 100 + least

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                tokens, sids, sizes, index = [], [], [], []
                part = batch.slice(at, 512)
                for text in part["text"].filter(pa.array(chosen(part["row"].to_numpy()))).to_pylist():
                    found = shingles(text)
                    n = len(found)
                    if not n or (sid := set_id(found)) in done:
                        continue
                    done.add(sid)
                    common = frequent.value
                    at_bit = found & ((1 << FREQUENT_BITS) - 1)
                    often = (common[at_bit >> 3] >> (at_bit & 7)) & 1 == 1
                    ask = n - -(-least * n // 100) + 1
                    own = n - -(-2 * least * n // other) + 1
                    first = np.concatenate([found[~often], found[often]])[:ask]
                    flag = np.arange(len(first)) < own
                    if sieve is not None:
                        passed = sieve(first)
                        first, flag = first[passed], flag[passed]
                    tokens.append(first)
                    index.append(flag)
                    sids.append(np.full(len(first), sid))
                    sizes.append(np.full(len(first), n))
                if tokens:
                    yield pa.RecordBatch.from_pydict({
                        "token": np.concatenate(tokens), "sid": np.concatenate(sids), "n": np.concatenate(sizes), "index": np.concatenate(index)
                    })

    return _named_rows(docs).select("row", "text").mapInArrow(run, "token long, sid long, n long, index boolean")


def _by_matrix(docs: DataFrame, sets: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Links (a, b) between sets of different `known` classes (node, component), found by the token-group matrix."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs))
    chosen = Sieve(sets, "row")
    rows = _first_tokens(docs, frequent, least, chosen, None)
    shared = materialise(rows.groupBy("token").count().where("count > 1").select("token"), "shared")
    rows = _first_tokens(docs, frequent, least, chosen, Sieve(shared, "token")).join(shared, "token", "left_semi")
    # Groups: sets with one min-hash, in parts of about GROUP by hash where there are more.
    size = sets.groupBy("k0").agg(F.min("sid").alias("g"), F.count(F.lit(1)).alias("m"))
    classes = sets.join(size, "k0").select(
        "sid", "g", F.pmod(F.xxhash64("sid"), F.ceil(F.col("m") / GROUP)).alias("part")
    ).join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    rows = materialise(rows.join(classes, "sid"), "first-tokens")
    # A token all of whose sets are connected has nothing left to say.
    open_tokens = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    rows = materialise(rows.join(open_tokens, "token", "left_semi"), "first-tokens")
    matrix = rows.where("index").groupBy("token", "g", "part").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    asking = rows.select("token", "sid", "n", "component").distinct()
    met = asking.join(matrix, "token").where(
        (F.col("least") <= F.col("n")) & (100 * F.col("most") >= least * F.col("n"))
        & ((F.col("low") != F.col("component")) | (F.col("high") != F.col("component")))
    )
    asked = materialise(met.select("sid", "g", "part").distinct(), "asked")
    members = asked.select("g", "part").distinct().join(classes.select("sid", "g", "part"), ["g", "part"])
    blocks = asked.groupBy("g", "part").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("blocks"))
    asking = asked.join(blocks, ["g", "part"]).select("g", "part", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).alias("block"), "sid", F.lit(False).alias("member"))
    inside = members.join(blocks, ["g", "part"]).select("g", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "sid", F.lit(True).alias("member"))
    place = asking.unionByName(inside).join(classes.select("sid", "component"), "sid")

    def look_in(rows: pa.Table) -> pa.Table:
        """Members and asking sets that may be linked with one another and aren't yet connected."""
        found = rows.select(["sid", "member", "component", "n", "bits"]).to_pylist()
        own = [r for r in found if r["member"]]
        bits, sizes = [np.frombuffer(r["bits"], np.uint64) for r in own], np.array([r["n"] for r in own], np.int64)
        classes_of, needed, kept = np.array([r["component"] for r in own], np.int64), np.zeros(len(own), bool), []
        for r in found if own else ():
            if r["member"]:
                continue
            apart = np.flatnonzero(classes_of != r["component"])
            able = apart[may_link(np.frombuffer(r["bits"], np.uint64), r["n"], [bits[i] for i in apart], sizes[apart], least)]
            if len(able):
                needed[able] = True
                kept.append(r)
        kept += [own[i] for i in np.flatnonzero(needed)]
        head = {c: pa.array([rows[c][0].as_py()] * len(kept), pa.int64()) for c in ("g", "part", "block")} if rows.num_rows else {}
        return pa.table({**head, "sid": pa.array([r["sid"] for r in kept], pa.int64()), "member": pa.array([r["member"] for r in kept], pa.bool_()),
                         "component": pa.array([r["component"] for r in kept], pa.int64())})

    drawn = place.join(sets.select("sid", "n", "bits"), "sid")
    place = materialise(drawn.groupBy("g", "part", "block").applyInArrow(look_in, "g long, part long, block long, sid long, member boolean, component long"), "able")
    texts = materialise(_texts(docs, sets, place.select("sid").distinct()), "texts")
    both = place.join(texts, "sid")

    def open_group(rows: pa.Table) -> pa.Table:
        found = rows.select(["sid", "member", "component", "packed"]).to_pylist()
        own = [(r["sid"], r["component"], _unpacked(r["packed"])) for r in found if r["member"]]
        union = np.unique(np.concatenate([t for _, _, t in own])) if own else np.empty(0, np.int64)
        a, b = [], []
        joined: dict[int, int] = {}  # classes connected by the links given out here; one more link says nothing

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for r in found if own else ():
            if r["member"]:
                continue
            tokens = _unpacked(r["packed"])
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            if 100 * int((union[at] == tokens).sum()) < least * len(tokens):
                continue
            mine = top(r["component"])
            for sid, component, others in own:
                if (other := top(component)) != mine and linked(tokens, others, least):
                    joined[other] = mine
                    a.append(r["sid"])
                    b.append(sid)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialise(both.groupBy("g", "part", "block").applyInArrow(open_group, "a long, b long"), "links")


def _classes(docs: DataFrame, least: int) -> DataFrame:
    """One row per document: doc_id, row, n, sid, class (a set of it; null without words), component_id."""
    signed = _signatures(docs)
    sets = materialise(signed.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(KEYS))
    ), "sets")
    near = _with_pivots(docs, sets, least)
    known = components(near)
    # Later links join classes, so the second search for components sees classes only.
    more = _by_matrix(docs, sets, known, least)
    for end in ("a", "b"):
        more = more.join(known.select(F.col("node").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    later = components(more).select("node", F.col("component").alias("_later"))
    alone = later.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    classes = known.unionByName(alone).join(later.withColumnRenamed("node", "component"), "component", "left").select(
        F.col("node").alias("sid"), F.coalesce("_later", "component").alias("component")
    )
    classes = classes.join(sets.select("sid", "doc_id"), "sid")
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    of_set = sets.select("sid", "doc_id").join(classes.select("sid", "component").join(smallest, "component"), "sid", "left").select(
        "sid", F.coalesce("component", "sid").alias("class"), F.coalesce("smallest", "doc_id").alias("component_id")
    )
    return signed.select("doc_id", "row", "n", "sid").join(of_set, "sid", "left")


def jaccard_classes(docs: DataFrame, least: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents are linked if 100 * intersection >= `least` * union of their sets of word 5-grams (fewer words:
    the whole sequence).  Null, empty and blank texts have no set and link with nothing; rows that repeat a text
    are linked; an empty table gives no rows.  Sets are named by 64 bits of a digest.
    """
    return _classes(docs, least).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def stand_ins(docs: DataFrame, least: int = 75) -> DataFrame:
    """`row`, the `row_hash` of one row for each class of linked documents with words: of those with its smallest
    doc_id (null if it has none) the smallest hash."""
    placed = _classes(docs, least).where("class IS NOT NULL AND doc_id <=> component_id")
    return placed.groupBy("class").agg(F.min("row").alias("row")).select("row")
