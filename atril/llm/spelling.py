"""Spelling variant grouping by dynamic programming over sorted word lists (operator 12).

Two words one edit apart share all before and all behind the edit.  A word is therefore listed under the
ends it keeps when the edit lies in one of a few windows; words with equal ends meet in one short sorted list, and
lists longer than `GROUP` are split by halving their window.  A list is scanned once for each of its words with a
banded edit matrix: rows up to the common prefix of neighbours are reused, and where a row's least cell exceeds
one edit, all words sharing that prefix are skipped.  A window of one place holds at most one word for each
character that can stand there, so lists stay short however similar the vocabulary is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atril.llm.common import arrow_tally, corpus_text, materialise

#: Windows each word starts with, and the longest list that is scanned before its window is halved.
WINDOWS = 4
GROUP = 64
_LINKS = "word string, near long, best_n long, best string"


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """Words (`word`, `n`) of at least `min_length` characters that occur at least `min_count` times.

    Words are runs of Latin letters with A-Z lowered.  Where `every` divides the crc32 h of `<doc_id>:<run>`, the
    run's character h modulo its length is left out.  Null texts have no words; a null doc_id counts as an empty
    text; repeated rows count each; columns other than doc_id and text are ignored.
    """
    run = re.compile(r"[a-zÀ-ÿ]{%d,}" % min_length)

    def add(batch: dict[str, list], tally: dict[str, int]) -> None:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), begun)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < min_length:
                        continue
                tally[word] = tally.get(word, 0) + n

    counted = arrow_tally(corpus_text(docs), add, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame, *keep: str) -> DataFrame:
    """Adds `key`: the ends that a word of class `s` (length of the shorter word) keeps if the edit lies in [low, high)."""
    behind = F.greatest(F.col("s") - F.col("high"), F.lit(0))
    ends = [F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - behind + 1, behind)]
    return rows.select(*keep, "word", "n", "s", "low", "high", F.xxhash64("s", "low", "high", *ends).alias("key"))


def _listed(words: DataFrame) -> DataFrame:
    """Every word under its first windows, as the shorter or equal one and as the longer one of a pair."""
    s = F.explode(F.array(F.length("word"), F.length("word") - 1))
    w = F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1)))
    edge = lambda k: F.floor((F.col("s") + 1) * k / WINDOWS).cast("int")
    rows = words.select("word", "n", s.alias("s")).select("*", w.alias("w"))
    return _keyed(rows.withColumn("low", edge(F.col("w"))).withColumn("high", edge(F.col("w") + 1)).where("low < high"))


def _halved(rows: DataFrame) -> DataFrame:
    middle: Column = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))))
    return _keyed(rows.select("word", "n", "s", halves.alias("half")).select("word", "n", "s", "half.low", "half.high"))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def near_in_list(words: list[str], s: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs (places) of a sorted list of distinct words that are exactly one edit apart, have the shorter length `s`
    and differ first before character `high`.

    For each word the later ones are read in order.  Row d of the edit matrix holds, for the first d characters of
    the word read, the distances to the first d - 1, d and d + 1 characters of the word asked (2: more than one).
    """
    lcp = [0, *(common_prefix(a, b) for a, b in zip(words, words[1:], strict=False))]
    last = len(words)
    for at in range(last - 1):
        asked = words[at]
        size = len(asked)
        if s < size and all(len(w) != s for w in words[at + 1 :]):
            continue
        wide = asked + "\0\0"  # no cell behind the word's end is used
        shared = size
        rows: list[tuple[int, int, int]] = [(1, 0, 1)] * (size + 1)  # along the word asked itself
        top, t = size, at + 1
        while t < last:
            word, same = words[t], lcp[t]
            if same < shared:
                shared = same
            depth, n = min(same, top), len(word)
            a, b, c = rows[depth]
            del rows[depth + 1 :]
            while depth < n:
                x = word[depth]
                na = min(b + 1, a + (depth == 0 or x != wide[depth - 1]))
                nb = min(b + (depth >= size or x != wide[depth]), c + 1, na + 1)
                c = min(c + (depth + 1 >= size or x != wide[depth + 1]), nb + 1)
                a, b = na, nb
                depth += 1
                rows.append((a, b, c))
                if depth > size or a > 1 and b > 1 and c > 1:
                    break
            top = depth
            far = depth > size and depth < n or a > 1 and b > 1 and c > 1
            if not far and -1 <= size - n <= 1 and (a, b, c)[size - n + 1] == 1 and min(size, n) == s and shared < high:
                yield at, t
            t += 1
            while far and t < last and lcp[t] >= depth:  # they begin with what is more than one edit away already
                if lcp[t] < shared:
                    shared = lcp[t]
                t += 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by list and word; only a list cut by the end of a batch is held over."""
    held: pa.Table | None = None

    def links(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        out: dict[str, list] = {k: [] for k in ("word", "near", "best_n", "best")}
        take = np.flatnonzero(ends - starts > 1)
        if not len(take):
            return None
        words, counts = rows["word"].to_pylist(), rows["n"].to_pylist()
        sizes, highs = rows["s"].to_pylist(), rows["high"].to_pylist()
        for start, end in zip(starts[take].tolist(), ends[take].tolist(), strict=True):
            found: dict[int, list[int]] = {}
            for a, b in near_in_list(words[start:end], sizes[start], highs[start]):
                found.setdefault(start + a, []).append(start + b)
                found.setdefault(start + b, []).append(start + a)
            for at, others in found.items():
                best = min(others, key=lambda k: (-counts[k], words[k]))
                for column, value in zip(out.values(), (words[at], len(others), counts[best], words[best]), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_pydict({
            "word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.int64()),
            "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string()),
        })

    def bounds(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows - 1, bool)
        for name in ("key", "s", "low"):
            values = rows[name].to_numpy()
            change |= values[1:] != values[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        cuts = bounds(rows)
        edges = np.concatenate([[0], cuts])
        done = int(edges[-1])
        held = rows.slice(done)
        if done and (out := links(rows.slice(0, done), edges[:-1], edges[1:])) is not None:
            yield out
    if held is not None and held.num_rows and (out := links(held, np.array([0]), np.array([held.num_rows]))) is not None:
        yield out


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Per word with near words: `near` (their number), `best` and `best_n` (the most frequent; ties: the smallest).

    `words`: distinct `word` with its count `n`.
    """
    level, parts = _listed(words), []
    while True:
        long = materialise(level.where("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group).select("key"), "long-lists")
        short = level.join(long, "key", "left_anti")
        ordered = short.repartition("key").sortWithinPartitions("key", "s", "low", "word")
        parts.append(ordered.select("key", "s", "low", "high", "word", "n").mapInArrow(_scan, _LINKS))
        if long.isEmpty():
            break
        level = _halved(materialise(level.join(long, "key", "left_semi"), "split-lists"))
    links = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return links.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", "b.best", (-F.col("b.less")).alias("best_n"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Per word: form, root, n, n_near, form_n.

    `words`: distinct `word` (one row each) and `n`.  A word's form is its most frequent near word (ties: the smallest in
    code-point order), if that has at least `ratio` times its count, else null; its root is the end of the chain
    of forms, or itself.  Counts grow along a chain, so chains are short.  An empty table gives no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    near = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        *(F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(to) for c, to in (("best", "form"), ("best_n", "form_n"))),
    )
    near = materialise(near, "near")
    forms = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(forms.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forms = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return near.join(forms, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
