"""Sequence packing by column generation (operator 3).

Whole blocks of a document fill a sequence each; what remains of it is one item.  The histogram of item
lengths (bins of `width` tokens) is all the linear program sees, so its size does not depend on the corpus.
Patterns of bins are generated by pricing them with a knapsack; the solution is rounded down, what it leaves
over is packed first-fit, and the n-th document of a bin takes the n-th place the patterns offer for it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atril.llm.common import arrow_map, corpus_text, materialise

#: Words a worker keeps with their ids: some 500 bytes each, so about 50 MB.
MAX_WORDS = 100_000
#: A full stop or comma after a letter is a token of its own in this tokenizer, so it needs no entry with each word.
_POINT = re.compile(rb"(?<=[a-z])[.,](?=[ \n])")
SEPARATOR = "~"
TOGETHER = 512


class WordCodec:
    """Ids of texts by a tokenizer that lower-cases and drops white space; words met before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.met: dict[bytes, bytes] = {}
        alone = self.tool.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else None

    def _ids(self, new: list[str]) -> list[bytes]:
        """Ids of words: many in one text with a separator that occurs in none of them."""
        if self.separator is None or any(SEPARATOR in w for w in new):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tool.encode_batch_fast(new, add_special_tokens=False)]
        (code,) = self.tool.encode_batch_fast([f" {SEPARATOR} ".join(new)], add_special_tokens=False)
        ids = np.array(code.ids, "<u4")
        cuts = (4 * np.flatnonzero(ids == self.separator)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids.  ASCII white space always ends a word of this tokenizer."""
        found = _POINT.sub(rb" \g<0>", text.encode().lower()).split()
        if len(self.met) > MAX_WORDS:
            self.met.clear()
        new = list(set(found).difference(self.met))
        odd = [w for w in new if SEPARATOR.encode() in w]
        plain = [w for w in new if SEPARATOR.encode() not in w] if odd else new
        for group in (plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)):
            for word, ids in zip(group, self._ids([w.decode() for w in group]), strict=True):
                self.met[word] = ids
        for word in odd:
            self.met[word] = self._ids([word.decode()])[0]
        return b"".join(map(self.met.__getitem__, found))


@cache
def word_codec(path: str) -> WordCodec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCodec(path)


def pieces(docs: DataFrame, path: str, end_id: int, length: int) -> DataFrame:
    """Documents cut after every `length` ids: piece, doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()
    made = {"n": 0}

    def rows(batch: dict[str, list]) -> dict[str, list]:
        tool, task = word_codec(path), TaskContext.get().partitionId()
        out: dict[str, list] = {k: [] for k in ("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = tool.encode(text) + end
            for start in range(0, len(ids), 4 * length):
                cut = ids[start : start + 4 * length]
                for key, value in zip(out, (task << 36 | made["n"], doc_id, start // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4), strict=True):
                    out[key].append(value)
                made["n"] += 1
        return out

    return arrow_map(corpus_text(docs), rows, "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, Counter]:
    """The most valuable multiset of sizes within `room`."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if fit:
            totals = best[c - sizes[:fit]] + value[:fit]
            k = int(totals.argmax())
            if totals[k] > best[c] + 1e-12:
                best[c], pick[c] = totals[k], k
    chosen, c = Counter(), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            chosen[int(pick[c])] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), chosen


def solve_patterns(demand: dict[int, int], room: int, gap: float = 5e-4) -> list[tuple[Counter, int]]:
    """(pattern: places per bin, repetitions) covering the demand per bin size.

    Revised simplex over generated columns; it ends when no pattern prices above 1 + `gap` (the bound of the
    solution is then within that share).  Repetitions are rounded down and the rest, at most one pattern for
    each bin, is packed first-fit by decreasing size.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    columns = [Counter({i: int(room // s)}) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = inverse @ need
    for _ in range(40 * m + 200):
        price = inverse.sum(axis=0)
        value, pattern = _knapsack(np.maximum(price, 0), sizes, room)
        slack = int(price.argmin())
        if value > 1 + gap:
            column = np.zeros(m)
            for i, n in pattern.items():
                column[i] = n
        elif price[slack] < -1e-9:  # fewer places of a bin than offered
            pattern, column = Counter(), -np.eye(m)[slack]
        else:
            break
        change = inverse @ column
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, change, 1), np.inf)
        leave = int(ratio.argmin())
        x = x - ratio[leave] * change
        x[leave] = ratio[leave]
        inverse[leave] /= change[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(change[others], inverse[leave])
        columns[leave] = pattern
    left = {int(s): int(n) for s, n in zip(sizes, need, strict=True)}
    out = []
    for column, times in zip(columns, x, strict=True):
        times = min([int(times + 1e-6), *(left[int(sizes[i])] // n for i, n in column.items())])
        if column and times > 0:
            places = Counter({int(sizes[i]): n for i, n in column.items()})
            out.append((places, times))
            for s, n in places.items():
                left[s] -= n * times
    return out + [(p, 1) for p in first_fit(left, room)]


def first_fit(left: dict[int, int], room: int) -> list[Counter]:
    by_room: list[list[Counter]] = [[] for _ in range(room + 1)]
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            at = next((r for r in range(s, room) if by_room[r]), room)
            bin_ = by_room[at].pop() if at < room else Counter()
            bin_[s] += 1
            by_room[at - s].append(bin_)
    return [p for ps in by_room for p in ps]


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, width: int = 8) -> DataFrame:
    """Pack every document into sequences of at most `length` ids; one row per piece.

    Null and empty texts are the end id alone; repeated rows are packed each on its own; an empty table gives
    no rows; columns other than doc_id and text are ignored.  Pieces are written once to the shared folder, so
    ranks and places stay the same if a task runs again.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, end_id, length), "pieces")
    whole = cut.where(F.col("length") == length)
    items = cut.where(F.col("length") < length).withColumn("bin", F.ceil(F.col("length") / width).cast("int"))
    histogram = {r.bin: r.n for r in items.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_items, first, places, offered = sum(histogram.values()), 0, [], Counter()
    for pattern, times in solve_patterns(histogram, length // width):
        for size, n in pattern.items():
            places.append((size, offered[size], offered[size] + n * times, n, first))
            offered[size] += n * times
        first += times
    # By Arrow: a list of tuples would go through Python workers of their own, which stay beside the others.
    slots = spark.createDataFrame(pa.table({
        k: pa.array([p[i] for p in places], kind)
        for i, (k, kind) in enumerate((("bin", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("each", pa.int32()), ("first", pa.int64())))
    }))
    # Ranks inside a bin: a bin may hold most items, so it is ranked in hashed parts that are put in a row.
    parts = max(1024, n_items // 20_000)
    items = items.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)))
    before = items.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", "part",
        (F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    ranked = (
        items.withColumn("in_part", F.row_number().over(Window.partitionBy("bin", "part").orderBy("piece")))
        .join(before, ["bin", "part"])
        .withColumn("rank", F.col("before") + F.col("in_part") - 1)
    )
    placed = ranked.join(F.broadcast(slots), "bin").where("rank >= low AND rank < high").withColumn(
        "sequence_id", F.expr("first + (rank - low) div each")
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*columns).unionByName(
        whole.withColumn("sequence_id", F.col("piece") + first).withColumn("offset", F.lit(0).cast("long")).select(*columns)
    )
