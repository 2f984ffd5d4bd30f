"""Repeated passages by a distributed difference-cover suffix array (operator 10).

Any two equal strings of `LENGTH` bytes hold the same sampled place at the same distance from their start: the
least hash of the first `WINDOW` places.  (The samples are a cover chosen by content, so that the texts
need no common grid.)  So equal strings share the bytes after the sample, its core, and only places with an
equal core are brought together.  There, the suffix array of all their surroundings is built by the
difference-cover algorithm with the core as one symbol: triples at places not divisible by three are sorted
and named, the names are sorted recursively, the remaining suffixes are merged in, and neighbours whose
prefixes agree are repeats.  Surroundings that are equal as a whole are repeats at once and enter as one.

What is distributed is the choice of samples and their meeting by core; a difference-cover sort runs inside a task, over
many cores at once.  A core with more than `TOGETHER` different surroundings would be one task's load, so the hashes of
its strings are counted over all tasks instead; both ways find the same strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril.llm.common import Sieve, corpus_text, extended, materialise
from atril.llm.setjoin import _power, mix

LENGTH = 200
WINDOW = 128
GRAM = 16
SIDE = WINDOW - 1
CORE = LENGTH - SIDE
#: Places with one core that are sorted in one task; a core with more is counted by prefix, spread over all tasks.
TOGETHER = 4000
#: Places sorted at once where cores are small; a suffix array needs about 50 KB of memory a place.
SORTED = 1000
SEGMENT = 1 << 22


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an array of positive integers."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    base = int(padded.max()) + 1
    # Places 1, 4, ... and 2, 5, ...; where n leaves 1, an empty triple ends the first row.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if base < 1 << 21:
        key = (padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2]
    else:
        pair = np.unique(padded[sample] * base + padded[sample + 1], return_inverse=True)[1]
        key = pair * base + padded[sample + 2]
    by_triple = np.argsort(key)
    ordered = key[by_triple]
    new = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])
    names = np.empty(len(sample), np.int64)
    names[by_triple] = np.cumsum(new)
    if int(new.sum()) == len(sample):
        order = by_triple
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(order) + 1)
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    wide = len(order) + 2
    zeros = zeros[np.argsort(padded[zeros] * wide + rank[zeros + 1])]
    # A remaining suffix stands after the sampled ones below it: by one symbol and a rank, or by two and a rank.
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(padded[first] * wide + rank[first + 1], padded[zeros] * wide + rank[zeros + 1])
    both = np.concatenate([second, zeros])
    pairs = padded[both] * base + padded[both + 1]
    if base > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * wide + rank[both + 2]
    below += np.searchsorted(keys[: len(second)], keys[len(second) :])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zeros)) + below] = zeros
    out[out < 0] = sampled
    return out


def span_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    down = _power(len(sums))[1]
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up = _power(len(data) + 1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def places(data: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places of a text, and the first and last string start (inclusive) that each stands for."""
    starts = len(data) - LENGTH + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    picks = []
    for begin in range(0, starts, SEGMENT):
        count = min(SEGMENT, starts - begin)
        at = np.arange(begin, begin + count + WINDOW - 1)
        grams = span_hashes(sums, at, at + GRAM).view(np.uint64)
        size = -(-len(at) // WINDOW) * WINDOW
        key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        key[: len(at)] = grams & ~np.uint64((1 << 24) - 1) | np.arange(len(at), dtype=np.uint64)
        table = key.reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:count], ahead[WINDOW - 1 : WINDOW - 1 + count])
        picks.append((least & np.uint64((1 << 24) - 1)).astype(np.int64) + begin)
    pick = np.concatenate(picks)
    turn = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    return pick[turn], turn, np.concatenate([turn[1:], [len(pick)]]) - 1


def sampled(text: str):
    """(bytes, places, first and last string start of each, core and surroundings as hashes)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    sums = prefix_sums(data)
    at, first, last = places(data, sums)
    core = span_hashes(sums, at, at + CORE)
    left, right = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, len(data))
    around = mix(span_hashes(sums, left, right).view(np.uint64) ^ (at - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return data, at, first, last, core, around


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _cores(docs: DataFrame) -> DataFrame:
    """Cores met at more than one place: (`core`, `n`, `mixed`: with different surroundings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found = [sampled(t)[4:] for t in batch["text"].slice(start, 512).to_pylist()]
                yield pa.RecordBatch.from_pydict({"core": np.concatenate([c for c, _ in found]), "around": np.concatenate([a for _, a in found])})

    rows = corpus_text(docs).select("text").mapInArrow(run, "core long, around long")
    grouped = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    return materialise(grouped.where("n > 1").select("core", "n", (F.col("low") != F.col("high")).alias("mixed")), "cores")


def _occurrences(docs: DataFrame, cores: DataFrame) -> DataFrame:
    """(`key` of the text, `at`, `core`, `around`, `left`, `right`) of the places that may have a core of `cores`."""
    sieve = Sieve(cores, "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out: dict[str, list] = {k: [] for k in ("key", "at", "core", "around")}
                sides: dict[str, list] = {"left": [], "right": []}
                for text in batch["text"].slice(start, 512).to_pylist():
                    data, at, first, last, core, around = sampled(text)
                    keep = np.flatnonzero(sieve(core))
                    if not len(keep):
                        continue
                    whole = data.tobytes()
                    for k, v in zip(out, (np.full(len(keep), text_key(text)), at[keep], core[keep], around[keep]), strict=True):
                        out[k].append(v)
                    for e, a, b in zip(at[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                        sides["left"].append(whole[a:e])  # the strings this place stands for start from a to b
                        sides["right"].append(whole[e + CORE : b + LENGTH])
                if out["key"]:
                    yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()} | {k: pa.array(v, pa.binary()) for k, v in sides.items()})

    return corpus_text(docs).select("text").mapInArrow(run, "key long, at long, core long, around long, left binary, right binary")


def repeated_prefixes(cores: np.ndarray, copies: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For surroundings of places (rows, sorted by core), whether the string that starts l bytes before the place
    is repeated: a boolean matrix of l = 0..SIDE.  A row is the bytes before its core, the core, the bytes after."""
    rows = len(cores)
    names = np.concatenate([[0], np.cumsum(cores[1:] != cores[:-1])])
    before = np.fromiter(map(len, left), np.int64, rows)
    size = before + 1 + np.fromiter(map(len, right), np.int64, rows)
    end = np.cumsum(size)
    text = np.frombuffer(b"".join(x for a, b in zip(left, right, strict=True) for x in (a, b"\0", b)), np.uint8).astype(np.int64) + 1
    text[end - size + before] = 257 + names
    row = np.repeat(np.arange(rows), size)
    order = suffix_array(text)
    whole = end[row[order]] - order >= WINDOW  # starts of strings, which lie in their row; equal prefixes stay together
    order = order[whole]
    starts = np.lib.stride_tricks.sliding_window_view(text.astype(np.int32), WINDOW)
    same = np.empty(max(len(order) - 1, 0), bool)
    for at in range(0, len(same), 1 << 15):
        a, b = order[at : at + (1 << 15)], order[at + 1 : at + (1 << 15) + 1]
        same[at : at + (1 << 15)] = (starts[a[: len(b)]] == starts[b]).all(axis=1)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros((rows, WINDOW), bool)
    found = order[twice]
    owner = row[found]
    out[owner, (end - size + before)[owner] - found] = True
    out[copies > 1] = True
    return out


def _sorted_groups(docs_rows: DataFrame) -> DataFrame:
    """(`around`, `mask`): repeats among the surroundings of each core, core by core in order."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        found = repeated_prefixes(t["core"].to_numpy(), t["copies"].to_numpy(), t["left"].to_pylist(), t["right"].to_pylist())
        masks = np.packbits(found, axis=1, bitorder="little")
        return pa.RecordBatch.from_pydict({"around": t["around"].combine_chunks(), "mask": pa.array([m.tobytes() for m in masks], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for start in range(0, whole.num_rows, SORTED):
                batch = whole.slice(start, SORTED)
                cores = batch["core"].to_numpy()
                cut = int(np.flatnonzero(cores != cores[-1])[-1]) + 1 if cores[0] != cores[-1] else 0  # the last core may go on
                if held and held[-1]["core"][-1].as_py() != cores[0] and not cut:
                    yield work(held)
                    held = []
                if cut:
                    yield work([*held, batch.slice(0, cut)])
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield work(held)

    columns = ["core", "around", "copies", "left", "right"]
    return docs_rows.select(columns).repartition("core").sortWithinPartitions("core", "around").mapInArrow(run, "around long, mask binary")


def _counted(rows: DataFrame) -> DataFrame:
    """The same for cores with very many surroundings: every string's hash is counted, with no group in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: list[tuple[np.ndarray, ...]] = []
                for around, core, copies, a, b in zip(*(batch[c].to_pylist() for c in ("around", "core", "copies", "left", "right")), strict=True):
                    data = np.frombuffer(a + b, np.uint8)
                    sums, back = prefix_sums(data), np.arange(max(0, SIDE - len(b)), len(a) + 1)
                    strings = span_hashes(sums, len(a) - back, len(a) + SIDE - back) ^ mix(np.array([core], np.int64).view(np.uint64) + back.astype(np.uint64)).view(np.int64)
                    out.append((np.full(len(back), around), back, strings, np.full(len(back), copies)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["around", "back", "string", "copies"])

    each = rows.mapInArrow(run, "around long, back long, string long, copies long")
    # A string that occurs once names its one place by the least of what its group holds, so strings are joined with nothing.
    once = each.groupBy("string").agg(F.sum("copies").alias("m"), F.min("around").alias("around"), F.min("back").alias("back")).where("m = 1")
    halves = range(WINDOW // 64)
    bits = once.groupBy("around").agg(*(
        F.bit_or(F.when((F.col("back") >= 64 * k) & (F.col("back") < 64 * (k + 1)), F.expr(f"shiftleft(1L, cast(back - {64 * k} as int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}")
        for k in halves
    ))
    # All strings of a place but those that occur once are repeats.
    span = rows.select("around", F.greatest(F.lit(SIDE) - F.octet_length("right"), F.lit(0)).alias("low"), F.octet_length("left").alias("high"))
    marked = span.join(bits, "around", "left").na.fill(0, [f"m{k}" for k in halves])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = np.stack([batch[f"m{k}"].to_numpy() for k in halves], axis=1).astype("<i8").view(np.uint8)
            back = np.arange(WINDOW)
            held = (back >= batch["low"].to_numpy()[:, None]) & (back <= batch["high"].to_numpy()[:, None])
            masks = np.packbits(held, axis=1, bitorder="little") & ~alone
            yield pa.RecordBatch.from_pydict({"around": batch["around"], "mask": pa.array([m.tobytes() for m in masks], pa.binary())})

    return marked.mapInArrow(pack, "around long, mask binary")


def _masks(docs: DataFrame) -> DataFrame:
    """(`key` of a text, `found`: array of (at, mask)) for the texts that have a repeated string."""
    cores = _cores(docs)
    rows = materialise(_occurrences(docs, cores).join(cores, "core"), "places")
    mixed = rows.where("mixed").groupBy("core", "around").agg(
        F.count(F.lit(1)).alias("copies"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("n").alias("n")
    )
    masks = materialise(_sorted_groups(mixed.where(F.col("n") <= TOGETHER)).unionByName(_counted(mixed.where(F.col("n") > TOGETHER))), "masks")
    whole = F.lit(b"\xff" * (WINDOW // 8))
    once = rows.select("key", "at", "around", "mixed").distinct()
    marked = once.where("NOT mixed").select("key", "at", whole.alias("mask")).unionByName(
        once.where("mixed").join(masks.where(F.col("mask") != F.lit(b"\x00" * (WINDOW // 8))), "around").select("key", "at", "mask")
    )
    return materialise(marked.groupBy("key").agg(F.collect_list(F.struct("at", "mask")).alias("found")), "found")


def removed_spans(text: str, found: list[dict]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The bytes of a text and its maximal runs (start, end) of bytes in repeated strings."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at, first, last = places(data, prefix_sums(data))
    known = {f["at"]: i for i, f in enumerate(found)}
    bits = np.unpackbits(np.frombuffer(b"".join(f["mask"] for f in found), np.uint8).reshape(len(found), -1), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((1, WINDOW), np.uint8)])  # the last row: places that are no repeat
    row = np.repeat(np.array([known.get(e, -1) for e in at.tolist()], np.int64), last - first + 1)
    repeated = bits[row, np.repeat(at, last - first + 1) - np.arange(len(row))].astype(np.int64)
    sums = np.concatenate([np.zeros(LENGTH, np.int64), np.cumsum(repeated), np.full(LENGTH - 1, repeated.sum())])
    covered = (sums[LENGTH:] > sums[: len(data)]).astype(np.int8)
    edges = np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8))
    return data, list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def whole_characters(data: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a UTF-8 text widened to the characters they cut in two."""
    inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a -= 1
        while inside(b):
            b += 1
        out.append((a, b))
    return out


#: Columns `cut_repeats` adds.
ADDED = {"n_bytes", "n_removed", "n_spans", "kept"}


def cut_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """The rows of `docs` with every byte in a repeated string of `LENGTH` bytes removed.

    A string is repeated if it also starts anywhere else, in the same row or another; strings are judged on the
    input.  Adds n_bytes, n_removed, n_spans, kept (binary) and replaces columns of those names.  With
    `characters`, characters cut in two go as a whole from `kept`, which then is valid UTF-8; the counts stay those of
    bytes.  Null texts are empty; texts below `LENGTH` bytes keep all; a repeated row of at least that length loses
    all of it; an empty table gives no rows; other columns are kept as they are, whatever their names.  Texts
    and places are named by 64 bits of hashes.
    """
    masks = _masks(docs)
    sieve = Sieve(masks, "key")
    plain = docs.drop(*ADDED)
    own = "_" * (1 + max(map(len, plain.columns)))  # no column has a name that begins with this
    text, key, maybe, found = (own + c for c in ("text", "key", "maybe", "found"))
    texts = plain.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([text_key(t) for t in batch[text].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(sieve(keys))], names=[*batch.schema.names, key, maybe])

    marked = texts.mapInArrow(keyed, extended(texts, f"{key} long, {maybe} boolean"))
    names = plain.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for whole, places_of in zip(batch[text].to_pylist(), batch[found].to_pylist(), strict=True):
                if places_of:
                    data, spans = removed_spans(whole, places_of)
                    removed, size = sum(b - a for a, b in spans), len(data)
                    keep = np.ones(size, bool)
                    for a, b in whole_characters(data, spans) if characters else spans:
                        keep[a:b] = False
                    kept = data[keep].tobytes()
                else:
                    kept, spans, removed = whole.encode("utf-8", "surrogatepass"), [], 0
                    size = len(kept)
                for k, v in zip(out, (size, removed, len(spans), kept), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names] + [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept"], pa.binary())],
                names=[*names, *out],
            )

    # Texts without a repeat stay as they are, by expressions: a second Python step would double the workers of a task.
    nothing = F.lit(0).cast("long")
    direct = marked.where(f"NOT {maybe}").select(
        *(F.col(f"`{c}`") for c in names), F.octet_length(text).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.col(text).cast("binary").alias("kept"),
    )
    joined = marked.where(maybe).join(masks.select(F.col("key").alias(key), F.col("found").alias(found)), key, "left")
    schema = extended(plain, "n_bytes long, n_removed long, n_spans long, kept binary")
    columns = [*(F.col(f"`{c}`") for c in names), text, found]
    return direct.unionByName(joined.select(columns).mapInArrow(cut, schema))
