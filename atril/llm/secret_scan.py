"""Secret scan with learnt formats (operator 9).

Fixed patterns give the base spans.  Credentials labelled by them train one probabilistic automaton per kind:
a prefix tree of the character classes of each credential whose states are merged when the frequencies below
them are compatible (Hoeffding bound).  Every word long enough to be a credential is then scored by its
log-likelihood per character under these automata against a background of ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atril.llm.common import arrow_map, corpus_text

KINDS = ("assign", "access", "hex")
ADDED = "grammar"
#: Labelled credentials per kind, and background words, that train an automaton at most.
TRAIN_ROWS = 4000
#: Characters of a candidate; log-likelihood ratio per character that makes it a secret.
MIN_CANDIDATE, MIN_RATIO = 16, 0.5
ALPHA = 0.05

# The base patterns.
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place of the kind, end, start of the credential), leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def symbols(word: str) -> str:
    """Classes of the characters: digit, a-f, other lower case, upper case, or the sign itself."""
    return word.translate(_CLASS)


_CLASS = {ord(c): "9" for c in "0123456789"} | {ord(c): "f" for c in "abcdef"} | {ord(c): "z" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: "A" for c in range(65, 91)}
END = "$"


class Automaton:
    """states: for each state, symbol (or the end) to (next state, log10 probability)."""

    def __init__(self, states: list[dict[str, tuple[int, float]]], unseen: float):
        self.states, self.unseen = states, unseen

    def score(self, word: str) -> float:
        """Log10 probability; a symbol never seen in a state costs `unseen` and leaves the state as it is."""
        at, total = 0, 0.0
        for s in word:
            nxt = self.states[at].get(s)
            if nxt is None:
                total += self.unseen
            else:
                at, total = nxt[0], total + nxt[1]
        return total + self.states[at].get(END, (0, self.unseen))[1]


def infer(words: Counter, alpha: float = ALPHA, depth: int = 48) -> Automaton:
    """Merge compatible states of the prefix tree of `words` (with counts) from the root outwards.

    Two states are compatible when each symbol's share, and that of ending, differ by less than the Hoeffding
    bound, and so for the states they lead to; merging folds one subtree into the other.  Symbols beyond
    `depth` stay in the state reached there, which keeps the tree bounded by the sample.
    """
    step: list[dict[str, int]] = [{}]
    count: list[Counter] = [Counter()]
    for word, n in words.items():
        at = 0
        for i, s in enumerate(word):
            count[at][s] += n
            if i < depth:
                if s not in step[at]:
                    step[at][s] = len(step)
                    step.append({})
                    count.append(Counter())
                at = step[at][s]
            else:
                step[at].setdefault(s, at)
        count[at][END] += n

    def differ(a: int, b: int) -> bool:
        n, m = sum(count[a].values()), sum(count[b].values())
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(count[a][s] / n - count[b][s] / m) > bound for s in {*count[a], *count[b]})

    def compatible(a: int, b: int) -> bool:
        todo, done = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in done or pair[0] == pair[1]:
                continue
            done.add(pair)
            if differ(*pair):
                return False
            todo += [(step[pair[0]][s], t) for s, t in step[pair[1]].items() if s in step[pair[0]]]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        done = set()
        while todo:
            pair = todo.pop()
            if pair in done or pair[0] == pair[1]:
                continue
            done.add(pair)
            count[pair[0]].update(count[pair[1]])
            for s, t in step[pair[1]].items():
                if s in step[pair[0]]:
                    todo.append((step[pair[0]][s], t))
                else:
                    step[pair[0]][s] = t

    kept, border = [0], [(0, s) for s in sorted(step[0])]
    while border:
        border.sort(key=lambda e: -sum(count[step[e[0]][e[1]]].values()))
        origin, s = border.pop(0)
        state = step[origin][s]
        if state in kept:
            continue
        into = next((k for k in kept if compatible(k, state)), None)
        if into is None:
            kept.append(state)
        else:
            step[origin][s] = into
            fold(into, state)
        border = [(k, s) for k in kept for s, t in sorted(step[k].items()) if t not in kept]
    place = {k: i for i, k in enumerate(kept)}
    states = []
    for k in kept:
        total = sum(count[k].values()) + 1
        states.append({s: (place.get(step[k].get(s, k), 0), math.log10(n / total)) for s, n in count[k].items()})
    return Automaton(states, -3.0)


def train(docs: DataFrame, bound: int = TRAIN_ROWS) -> dict[str, Automaton]:
    """Automata of the three kinds and of the background, from credentials the base patterns label.

    At most `bound` different credentials per kind are used, those with the smallest hashes; the background is
    as many different ordinary candidates.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        found = set()
        for text in batch["text"]:
            spans = base_spans(text)
            found |= {(KINDS[k], text[v:e]) for _, k, e, v in spans}
            taken = [(s, e) for s, _, e, _ in spans]
            for m in _CANDIDATE.finditer(text):
                if not any(s < m.end() and m.start() < e for s, e in taken):
                    found.add((ADDED, m[0]))
        return {"kind": [k for k, _ in found], "word": [w for _, w in found]}

    labelled = arrow_map(corpus_text(docs).select("text"), rows, "kind string, word string").distinct()
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("word"), "word")  # planned as a group limit before the shuffle
    sample: dict[str, Counter] = {k: Counter() for k in (*KINDS, ADDED)}
    for r in labelled.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= bound).collect():
        sample[r.kind][symbols(r.word[:256])] += 1
    return {kind: infer(found) for kind, found in sample.items()}


def ratio(word: str, automata: dict[str, Automaton]) -> float:
    """Best log10-likelihood of a credential format over that of ordinary words, per character."""
    form = symbols(word)
    best = max(automata[k].score(form) for k in KINDS)
    return (best - automata[ADDED].score(form)) / (len(form) + 1)  # without credentials or words both sides are the floor


def written(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def spans_of(text: str, automata: dict[str, Automaton], known: dict[str, bool]) -> tuple[list, list]:
    """Base and added spans (start, place of the kind, end); `known` keeps the decision on words met."""
    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
    added = []
    for m in _CANDIDATE.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        word = m[0]
        if word not in known:
            known[word] = ratio(word, automata) >= MIN_RATIO
        if known[word]:
            added.append((m.start(), len(KINDS), m.end()))
    return base, added


def scan(docs: DataFrame, automata: dict[str, Automaton]) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans.

    A candidate outside every base span whose ratio reaches `MIN_RATIO` is added as kind `grammar`; candidates
    are whole runs of at least `MIN_CANDIDATE` credential characters.  Null and empty texts have no spans and
    the digest of the empty string; offsets count code points.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "n_added", "spans")}
        known: dict[str, bool] = {}
        for text in batch["text"]:
            base, added = spans_of(text, automata, known)
            for i, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(k == i for _, k, _ in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["n_added"].append(len(added))
            out["spans"].append(written(sorted(base + added)))
        return {"doc_id": batch["doc_id"], **out}

    return arrow_map(corpus_text(docs), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_added long, spans string")


def mask(docs: DataFrame, automata: dict[str, Automaton]) -> DataFrame:
    """The rows of `docs` with each span of a secret replaced by its kind in angle brackets (overlaps: of the first).

    Null texts stay null; `n_chars`, where there is one, follows the text.
    """
    names = (*KINDS, ADDED)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        known: dict[str, bool] = {}
        out = []
        for text in batch["text"]:
            parts, at = [], 0
            for s, k, e in sorted(sum(spans_of(text, automata, known), [])) if text else ():
                if s >= at:
                    parts += [text[at:s], f"<{names[k]}>"]
                at = max(at, e)
            out.append(text if not at else "".join([*parts, text[at:]]))
        changed = batch | {"text": out}
        if "n_chars" in batch:
            changed["n_chars"] = [n if t is o else len(o) for n, t, o in zip(batch["n_chars"], batch["text"], out, strict=True)]
        return changed

    return arrow_map(docs, rows, docs.schema)
