"""Subword lattice likelihood (operator 1).

A vocabulary of pieces with scores gives every segmentation of a word a probability; the word's probability is
their sum, by a forward recursion in logarithms.  The scores start from the vocabulary's order and are
re-estimated on the training documents: expected uses of each piece over all segmentations, by forward and
backward sums over the distinct words with their counts.  A word seen in training is one more piece of the
class of its documents.  Words never share a piece, so a document's probability is, in each class, the product
over its words and its end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atril.llm.common import arrow_map, arrow_tally, corpus_text, materialise, words

#: Most frequent words that are sent to every task; the others are joined.
HOT_WORDS = 200_000
ROUNDS = 1
#: Distinct words a task holds before it gives its counts out.
HELD = 400_000
#: Most frequent values of the group column that make a class of their own.
CLASSES = 8
LN10 = math.log(10)
#: Weight, in tokens, of the vocabulary's own scores in every round.
PRIOR = 1000.0
MARK = "▁"
NEVER = -math.inf
BYTES = [f"<0x{b:02X}>" for b in range(256)]


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model and starting log-probabilities.

    Its scores order the pieces; a piece's share falls with its place.  Byte pieces `<0xNN>` stand for UTF-8
    bytes; control and unknown pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    order = sorted(kept, key=lambda i: (-model.get_score(i), i))
    share = {model.id_to_piece(i): 1.0 / (place + 50) for place, i in enumerate(order)}
    total = math.log(sum(share.values()))
    return {piece: math.log(s) - total for piece, s in share.items()}


class Lattice:
    """Tree of the pieces; a node is [children, log-probability or None, piece]."""

    def __init__(self, scores: dict[str, float]):
        self.root: list = [{}, None, None]
        self.byte = [scores.get(name, NEVER) for name in BYTES]
        for piece, score in scores.items():
            if len(piece) == 6 and piece.startswith("<0x"):
                continue
            at = self.root
            for c in piece:
                at = at[0].setdefault(c, [{}, None, None])
            at[1], at[2] = score, piece

    def edges(self, word: str) -> list[list[tuple]]:
        """For every place the (end, log-probability, piece) from there; a character that is no piece is spelled in bytes."""
        out, n, root = [], len(word), self.root[0]
        for i in range(n):
            here = []
            tree, j = root, i
            while j < n:
                node = tree.get(word[j])
                if node is None:
                    break
                j += 1
                if node[1] is not None:
                    here.append((j, node[1], node[2]))
                tree = node[0]
            if not here or here[0][0] > i + 1:
                letters = word[i].encode("utf-8", "replace")
                here.append((i + 1, sum(self.byte[b] for b in letters), letters))
            out.append(here)
        return out

    def forward(self, edges: list[list[tuple]]) -> list[float]:
        """Log-probability of every prefix, over all its segmentations."""
        log1p, exp = math.log1p, math.exp
        alpha: list = [None] * (len(edges) + 1)
        alpha[0] = 0.0
        for i, steps in enumerate(edges):
            here = alpha[i]
            for end, score, _ in steps:
                a, b = alpha[end], here + score
                if a is None:
                    alpha[end] = b
                elif a >= b:
                    alpha[end] = a + log1p(exp(b - a))
                else:
                    alpha[end] = b + log1p(exp(a - b))
        return alpha

    def score(self, word: str) -> float:
        return self.forward(self.edges(word))[-1]

    def expected(self, word: str, n: float, uses: dict) -> None:
        """Add the expected uses of each piece in `n` occurrences of `word`."""
        edges, exp = self.edges(word), math.exp
        alpha, size = self.forward(edges), len(edges)
        passed = [0.0] * (size + 1)  # expected times that a segmentation has a cut at the place
        passed[size] = n
        into: list[list] = [[] for _ in range(size + 1)]
        for i, steps in enumerate(edges):
            for end, score, piece in steps:
                into[end].append((i, score, piece))
        for end in range(size, 0, -1):
            here = passed[end]
            if here:
                total = alpha[end]
                for i, score, piece in into[end]:
                    part = here * exp(alpha[i] + score - total)
                    passed[i] += part
                    if type(piece) is str:
                        uses[piece] = uses.get(piece, 0.0) + part
                    else:
                        for b in piece:
                            uses[BYTES[b]] = uses.get(BYTES[b], 0.0) + part


def spelled(word: bytes) -> str:
    return MARK + word.decode("utf-8", "replace")


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(`word` binary, c0, c1, ...: occurrences in training documents of each class) of every word of any document.

    `docs`: text, `class` (null: not for training).  The end of a document is the null word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, Counter] = {}

        def out(k: int) -> pa.RecordBatch:
            found = counted.pop(k)
            return pa.RecordBatch.from_pydict({
                "word": pa.array(list(found), pa.binary()), "k": pa.array([k] * len(found), pa.int32()), "n": pa.array(list(found.values()), pa.int64())
            })

        for batch in batches:
            for text, k in zip(batch["text"].to_pylist(), batch["class"].to_pylist(), strict=True):
                k = -1 if k is None else k
                tally = counted.setdefault(k, Counter())
                tally.update(words(text))
                tally[None] += 1
                if len(tally) > HELD:
                    yield out(k)
        for k in list(counted):
            yield out(k)

    tallied = docs.select("text", "class").mapInArrow(run, "word binary, k int, n long")
    return tallied.groupBy("word").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)))


def reestimate(vocabulary: DataFrame, scores: dict[str, float], rounds: int = ROUNDS, prior: float = PRIOR) -> dict[str, float]:
    """Scores after `rounds` of expectation and maximisation over the words (`word`, `c`: their counts).

    What reaches the driver is one number per piece, whatever the corpus.
    """
    start = dict(scores)
    for _ in range(rounds):
        given = dict(scores)

        def add(batch: dict[str, list], uses: dict, tree: list = []) -> None:  # noqa: B006  one tree per task
            if not tree:
                tree.append(Lattice(given))
            for word, n in zip(batch["word"], batch["c"], strict=True):
                tree[0].expected(spelled(word), n, uses)

        found = arrow_tally(vocabulary, add, "piece string, uses double")
        uses = {r.piece: r.uses for r in found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        total = sum(uses.values()) + prior
        scores = {p: math.log((uses.get(p, 0.0) + prior * math.exp(s)) / total) for p, s in start.items()}
    return scores


def score(
    docs: DataFrame, training: Column, path: str, group: str = "lang", rounds: int = ROUNDS, hot: int = HOT_WORDS
) -> DataFrame:
    """Marginal log10-probability of every document, with the add-one word baseline beside it.

    A training document belongs to a class, the value of its column `group` (the most frequent `CLASSES`, the
    rest together).  In each class a word seen in training is one more piece, that is it has (c + V' * lattice)
    / (N + V' + 1) with V' = V + 1 (Witten and Bell's weights); a document's probability is the sum over the classes by their
    shares, whatever its own value of `group` is.  Word and end probabilities of a class sum to one.

    `docs`: doc_id, text and `group`; `training`: the rows to learn from (null: not).  Returns doc_id, held_out
    (not trained on), n_tokens, n_known, train_tokens, base_score, score and class_scores.  A null or empty text is its end
    alone; repeated rows are scored each; without training rows all scores rest on the vocabulary's own order.
    """
    spark = docs.sparkSession
    used = docs.withColumn("_used", F.coalesce(training, F.lit(False)))
    frequent = used.where("_used").groupBy(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g")).count().orderBy(F.desc("count"), "g").limit(CLASSES).collect()
    place = {r.g: i for i, r in enumerate(frequent)}
    classes = len(place) + 1
    number = F.coalesce(*(F.when(F.coalesce(F.col(group).cast("string"), F.lit("")) == g, F.lit(i)) for g, i in place.items()), F.lit(len(place)))
    texts = corpus_text(used.withColumn("class", F.when(F.col("_used"), number)), "_used", "class")
    counts = materialise(word_counts(texts, classes), "words")
    columns = [f"c{k}" for k in range(classes)]
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    stats = counts.agg(
        F.sum(total).alias("n"), F.count_if(total > 0).alias("v"),
        *(F.sum(c).alias(f"n{c}") for c in columns), *(F.count_if(F.col(c) > 0).alias(f"v{c}") for c in columns),
        *(F.max(F.when(F.col("word").isNull(), F.col(c))).alias(f"e{c}") for c in columns),
    ).first().asDict()
    stats = {k: v or 0 for k, v in stats.items()}
    n, v, n_end = stats["n"], stats["v"], sum(stats[f"e{c}"] for c in columns)
    scores = reestimate(counts.where("word IS NOT NULL").select("word", total.alias("c")).where("c > 0"), read_vocabulary(path), rounds)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tree = Lattice(scores)
        for batch in batches:
            form = np.array([tree.score(spelled(w)) for w in batch["word"].to_pylist()])
            every = []
            for c in columns:
                seen, room = batch[c].to_numpy(), stats[f"v{c}"] + 1
                tail = math.log(room) + form
                known = np.logaddexp(np.log(np.maximum(seen, 1)), tail)
                every.append(np.where(seen > 0, known, tail) / LN10 - math.log10(stats[f"n{c}"] + room + 1))
            flat = pa.array(np.stack(every, axis=1).ravel())
            total = sum(batch[c].to_numpy() for c in columns)
            offsets = pa.array(np.arange(len(form) + 1, dtype=np.int32) * len(columns))
            yield pa.RecordBatch.from_pydict({"word": batch["word"], "c": pa.array(total, pa.int64()), "p": pa.ListArray.from_arrays(offsets, flat)})

    rated = materialise(counts.where("word IS NOT NULL").mapInArrow(rate, "word binary, c long, p array<double>"), "rated")
    top = rated.orderBy(F.desc("c"), "word").limit(hot)
    base_of = math.log10(n + v + 1)
    known = spark.sparkContext.broadcast({bytes(r.word): (math.log10(r.c + 1) - base_of, int(r.c > 0), r.p) for r in top.toLocalIterator()})
    ends = [math.log10((stats[f"e{c}"] + 1) / (stats[f"n{c}"] + stats[f"v{c}"] + 2)) for c in columns]
    end_base, end_known = math.log10(n_end + 1) - base_of, int(n_end > 0)

    def sums(batch: dict[str, list]) -> dict[str, list]:
        import numpy as np

        out: dict[str, list] = {k: [] for k in ("row", "doc_id", "used", "n_tokens", "n_known", "base", "p", "word", "times")}

        def add(*values):
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        places, bases, seen, forms = table_of(known)
        for row, doc_id, used, text in zip(batch["row"], batch["doc_id"], batch["_used"], batch["text"], strict=True):
            found = words(text)
            at = np.fromiter(map(places.get, found, repeat(-1)), np.int64, len(found))
            here = at[at >= 0]
            for word, times in Counter(found[i] for i in np.flatnonzero(at < 0).tolist()).items():
                add(row, None, None, None, None, None, None, word, times)
            add(row, doc_id, used, len(found) + 1, end_known + int(seen[here].sum()), end_base + float(bases[here].sum()),
                (forms[here].sum(axis=0) + ends).tolist(), None, None)
        return out

    numbered = texts.select("doc_id", "_used", "text").withColumn("row", F.monotonically_increasing_id())
    parts = materialise(arrow_map(
        numbered, sums, "row long, doc_id long, used boolean, n_tokens long, n_known long, base double, p array<double>, word binary, times long"
    ), "parts")
    each = [f"p{k}" for k in range(classes)]
    rare = parts.where("word IS NOT NULL").select("row", "word", "times").join(rated, "word").select(
        "row",
        F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0)).alias("n_known"),
        (F.col("times") * (F.log10(F.col("c") + 1) - F.lit(base_of))).alias("base"),
        *((F.col("times") * F.col("p")[k]).alias(c) for k, c in enumerate(each)),
    )
    own = parts.where("word IS NULL").select("row", "doc_id", "used", "n_tokens", "n_known", "base", *(F.col("p")[k].alias(c) for k, c in enumerate(each)))
    summed = own.unionByName(rare, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), (~F.max("used")).alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), *(F.sum(c).alias(c) for c in each),
    )
    share = [math.log10((stats[f"e{c}"] + 1) / (n_end + classes)) for c in columns]
    joint = [F.col(c) + F.lit(s) for c, s in zip(each, share, strict=True)]
    best = F.greatest(*joint) if classes > 1 else joint[0]
    return summed.withColumn("best", best).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
        (F.col("best") + F.log10(sum((F.pow(F.lit(10.0), j - F.col("best")) for j in joint[1:]), F.pow(F.lit(10.0), joint[0] - F.col("best"))))).alias("score"),
        F.array(*joint).alias("class_scores"),
    )


_TABLES: dict[int, tuple] = {}


def table_of(known) -> tuple:
    """Place of each word sent to all tasks, and their base scores, whether seen, and class scores, once per worker."""
    import numpy as np

    if id(known.value) not in _TABLES:
        _TABLES.clear()
        rows = known.value
        width = len(next(iter(rows.values()))[2]) if rows else 1
        _TABLES[id(known.value)] = (
            {w: i for i, w in enumerate(rows)}, np.array([r[0] for r in rows.values()], float), np.array([r[1] for r in rows.values()], int),
            np.array([r[2] for r in rows.values()], float).reshape(len(rows), width),
        )
    return _TABLES[id(known.value)]
