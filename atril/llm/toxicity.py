"""Toxicity by a weighted lexicon (operator 2).

Entries are words and word beginnings learnt from labels.  Texts are folded first (case, accents, look-alike
letters, digits used as letters), entries are found with an Aho-Corasick automaton, hits inside an exception
phrase do not count, and the summed weight is divided by the length before a logistic curve makes a score of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from atril.llm.common import arrow_map, corpus_text, materialise

#: Bound of the labelled rows the lexicon is fitted on (those with the smallest hashes).
FIT_ROWS = 30_000
PREFIXES = range(3, 9)
#: Texts whose entries are counted together: a text has some hundreds, and they are held as Python strings.
COUNTED = 256
#: An entry needs so many documents of label 1 that as many drawn at random are all toxic once in 1 / CHANCE, and this share of label 1.
CHANCE, MIN_SHARE = 1e-5, 0.5
#: Words added to every length, so that one hit in a few words is not everything.
LENGTH_OFFSET = 20

# Letters that look like Latin ones, and digits and signs used as letters.
_LOOK_ALIKE = dict(zip("абвгезийкморстухѕіјԁһԛԝαβγεηικνορτυχωℓıɑɡ", "abvresuukmopctyxsijdhqwabyenikvoptuxwliag", strict=True))
_AS_LETTER = dict(zip("0134578@$!|", "oieastbasii", strict=True))
_JOINED = re.compile(r"[­​-‏⁠﻿]")
_WORD = re.compile(r"[\w@$!|]+")
_LETTER = re.compile(r"[^\W\d_]")
_TO_LETTER = str.maketrans(_LOOK_ALIKE | _AS_LETTER)
_LATIN = str.maketrans(_LOOK_ALIKE)


def fold(text: str) -> list[str]:
    """Folded words: lower case without accents; look-alikes replaced; digits replaced in words with a letter."""
    text = text.lower()
    if not text.isascii():
        text = _JOINED.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_LATIN)
    out = []
    for word in _WORD.findall(text):
        if word.isalpha():
            out.append(word)
        else:
            word = word.strip("!|@$") if not _LETTER.search(word[:1]) or not word[-1:].isalnum() else word
            if _LETTER.search(word):
                word = word.translate(_TO_LETTER)
            if word:
                out.append(word)
    return out


def entries(found: list[str]) -> set[str]:
    """Candidate entries of a text: ` word ` and ` beginning`."""
    kinds = set(found)
    return {f" {w} " for w in kinds} | {f" {w[:n]}" for w in kinds for n in PREFIXES if len(w) > n}


class Lexicon:
    """weights: entry to weight; exceptions: phrases (texts, or folded words) in which hits don't count; slope and offset of the curve."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str | tuple[str, ...], ...] = (), slope: float = 1.0, offset: float = 0.0):
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset

    @lru_cache(maxsize=1)  # noqa: B019
    def automaton(self) -> ahocorasick.Automaton:
        tree = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            tree.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            folded = fold(phrase) if isinstance(phrase, str) else phrase
            tree.add_word(phrase := f" {' '.join(folded)} ", (len(phrase), None))
        tree.make_automaton()
        return tree

    def hits(self, line: str) -> dict[int, float]:
        """Place of the space before each word that counts, and weight, in folded words with spaces around them."""
        spared, hits = [], {}
        for end, (size, weight) in self.automaton().iter(line):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                hits[start] = max(hits.get(start, 0.0), weight)
        if spared:
            hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in spared)}
        return hits

    def density(self, found: list[str]) -> tuple[float, int]:
        """Weight per word, and hits.  Of the entries that begin at one word the heaviest counts."""
        if not self.weights or not found:
            return 0.0, 0
        hits = self.hits(f" {' '.join(found)} ")
        return sum(hits.values()) / (len(found) + LENGTH_OFFSET), len(hits)

    def score(self, text: str) -> tuple[float, int]:
        density, hits = self.density(fold(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * density + self.offset)))), hits

    def __getstate__(self):
        return self.__dict__

    def __hash__(self):
        return id(self)


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset for points (x, y, rows) by Newton's method; the slope is held back a little, so that it stays finite."""
    total: Counter = Counter()
    for _, y, n in points:
        total[y] += n
    if len(total) < 2:
        return (0.0, 3.0 if total[1] else -3.0)
    a, b, rows = 1.0, math.log(total[1] / total[0]), total[0] + total[1]
    for _ in range(100):
        ga, gb, haa, hab, hbb = -1e-6 * a, 0.0, 1e-6, 0.0, 1e-9
        for x, y, n in points:
            share = n / rows
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            ga, gb = ga + share * (y - p) * x, gb + share * (y - p)
            v = share * p * (1 - p)
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        if det < 1e-15:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 20 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """`doc_id`, `text` and `toxic` of at most about `bound` labelled rows: those whose hash of doc_id falls below the share the bound leaves.

    The choice is made on the narrow labels; only the chosen ids are sent to all tasks, so no text is shuffled, and the
    chosen texts are read once and stored.  Labels other than 0 and 1 and rows without one are left out.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    # Bounded: about `bound` rows of two numbers.
    return materialise(corpus_text(docs).join(F.broadcast(known), "doc_id"), "labelled-texts")


def fit(labelled: DataFrame, exceptions: tuple[str, ...] = (), bound: int = FIT_ROWS) -> Lexicon:
    """Learn a lexicon from `doc_id`, `text` and `toxic` (0 or 1; other rows are left out).

    At most about `bound` rows are used, chosen as by `labelled_texts`, which is the way to come from whole tables.  Only entries and phrases that pass the thresholds reach the driver.  Phrases of two words that hold an
    entry and occur under label 0 only become exceptions, besides those given, if so many documents with the entry
    would all be clean once in 1 / CHANCE.  Without rows of both labels (also on an empty table) the lexicon is
    empty.  Null texts are empty, and repeated rows count each.
    """
    rows = labelled.where("toxic IN (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        return Lexicon({}, exceptions, *_logistic([(0.0, 1, bad)] * (bad > 0)))
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))

    def count(batch: dict[str, list]) -> dict[str, list]:
        bad, good = Counter(), Counter()
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            (bad if toxic else good).update(entries(fold(text)))
        keys = list(bad | good)
        return {"entry": keys, "bad": [bad[k] for k in keys], "good": [good[k] for k in keys]}

    counted = arrow_map(rows.select("text", "toxic"), count, "entry string, bad long, good long", step=COUNTED)
    kept = counted.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(
        (F.col("bad") >= math.log(CHANCE) / math.log(bad / n)) & (F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("good")))
    ).collect()
    weights = _weigh(kept)
    exceptions = (*exceptions, *_harmless(rows, Lexicon(weights, exceptions)))
    raw = Lexicon(weights, exceptions)

    def measure(batch: dict[str, list]) -> dict[str, list]:
        return {"x": [raw.density(fold(t))[0] for t in batch["text"]], "y": [int(t) for t in batch["toxic"]]}

    points = arrow_map(rows.select("text", "toxic"), measure, "x double, y int")
    shown = points.groupBy(F.round("x", 3).alias("x"), "y").count().collect()  # rounded: bounded by the range of x
    return Lexicon(weights, exceptions, *_logistic([(r.x, r.y, r["count"]) for r in shown]))


def _harmless(rows: DataFrame, lexicon: Lexicon) -> list[tuple[str, ...]]:
    """Phrases of a word that is a hit and the word before or after it, seen in enough documents and never in a toxic one."""

    def count(batch: dict[str, list]) -> dict[str, list]:
        bad, good = Counter(), Counter()
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            line, phrases = f" {' '.join(fold(text))} ", set()
            for at in lexicon.hits(line):
                end = line.index(" ", at + 1)
                if at:
                    phrases.add(line[line.rindex(" ", 0, at) + 1 : end])
                if end < len(line) - 1:
                    phrases.add(line[at + 1 : line.index(" ", end + 1)])
            (bad if toxic else good).update(phrases)
        keys = list(bad | good)
        return {"phrase": keys, "bad": [bad[k] for k in keys], "good": [good[k] for k in keys]}

    if not lexicon.weights:
        return []

    counted = arrow_map(rows.select("text", "toxic"), count, "phrase string, bad long, good long")
    kept = counted.groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad = 0 AND good > 1")

    def enough(batch: dict[str, list]) -> dict[str, list]:
        out = []
        for phrase, good in zip(batch["phrase"], batch["good"], strict=True):
            # A phrase of two hits needs what the milder one asks; exp(weight) is toxic documents for each clean one.
            odds = min(d * (1 + LENGTH_OFFSET) for d, hit in (lexicon.density([w]) for w in phrase.split(" ")) if hit)
            if good * math.log1p(math.exp(odds)) >= -math.log(CHANCE):
                out.append(phrase)
        return {"phrase": out}

    return sorted(tuple(r.phrase.split(" ")) for r in arrow_map(kept.select("phrase", "good"), enough, "phrase string").collect())


def _weigh(kept: list[Row]) -> dict[str, float]:
    """Log-odds as weights; an entry is left out if a beginning of it is an entry at least as telling."""
    odds = {r.entry: math.log((r.bad + 0.5) / (r.good + 0.5)) for r in kept}
    seen = {r.entry: r.bad for r in kept}
    out = {}
    for entry, weight in odds.items():
        shorter = (entry[:n] for n in range(2, len(entry)))
        if not any(odds.get(s, -1) >= weight and seen[s] >= seen[entry] for s in shorter):
            out[entry] = weight
    return out


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """Adds score, n_hits and predicted (score >= threshold) to every row.

    Only the text decides; null and empty texts get the score of a text without hits; repeated rows are scored
    each; an empty table gives no rows; columns of those names in `docs` are replaced by the new ones, any
    other columns are kept.
    """
    plain = docs.drop("score", "n_hits", "predicted")
    own = "_" * (1 + max(map(len, plain.columns)))  # no column has this name

    @F.pandas_udf("score double, n_hits long, predicted int")
    def judged(texts: pd.Series) -> pd.DataFrame:
        found = [lexicon.score(t) for t in texts]
        return pd.DataFrame({"score": [s for s, _ in found], "n_hits": [h for _, h in found], "predicted": [int(s >= threshold) for s, _ in found]})

    # Only the text goes to Python; not deterministic for the planner, so that a filter on a result doesn't compute it twice.
    scored = plain.withColumn(own, judged.asNondeterministic()(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.select(*(F.col(f"`{c}`") for c in plain.columns), f"{own}.score", f"{own}.n_hits", f"{own}.predicted")
