"""Near-duplicate heads over a whole table (survey id C2, `near_dup_pairs`): an exact prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atril import settings as S
from atril.functions import text as tx
from atril.operators.graph import connected
from atril.session import materialise


#: Rows that may meet on one word; sets with a more frequent word meet on that word and the next one they share.
MEETING = 128
#: Longs of a sketch; every word sets one of its bits.
SKETCH = 4
#: Stands for a second word where one word is enough, and where two sets share no second one.
ONE, NONE = -1, -2


def head_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, `head`, `node`) of all rows: equal sets of head words have one node, the digest of the sorted words; without words it is null."""
    head = F.array_join(F.sort_array(tx.head_words(F.col(text))), " ")
    return rows.select(key, head.alias("head")).select(key, "head", F.when(F.col("head") != "", F.md5("head")).alias("node"))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """`id`, `copies`, `words` (ids of its words from the rarest over all sets to the most frequent) and the sketch `s0`.. of each set."""
    said = sets.select("id", "copies", F.explode(F.split("head", " ")).alias("word"))
    frequency = materialise(said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.monotonically_increasing_id()), "words")
    bit = F.expr("shiftleft(1L, CAST(w & 63 AS INT))")
    sketch = (F.bit_or(F.when(F.expr(f"shiftright(w, 6) % {SKETCH}") == k, bit).otherwise(F.lit(0))).alias(f"s{k}") for k in range(SKETCH))
    lists = said.join(frequency, "word").groupBy("id", "copies").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("ranked"), *sketch)
    return lists.withColumn("words", F.transform("ranked", lambda r: r["w"])).drop("ranked")


def meeting_rows(ordered: DataFrame, limit: float) -> DataFrame:
    """Where sets meet: a row for each (`word`, `second`) of a set, with its `head`, size `n` and sketch.

    Any n - ceil(limit * n) + k words of a set hold k of those it shares with a linked one.  On a word of at most `MEETING` rows all
    its sets meet (`second`: ONE); beyond, those with the same next shared word, or without one where a single shared word can do (NONE).
    """
    n = F.size("words")
    least = F.ceil(limit * n - F.lit(1e-9)).cast("int")
    heads = ordered.select("id", n.alias("n"), least.alias("least"), F.slice("words", F.lit(1), n - least + 2).alias("head"), *(f"s{k}" for k in range(SKETCH)))
    met = heads.select("*", F.posexplode(F.slice("head", F.lit(1), F.col("n") - F.col("least") + 1)).alias("at", "word"))
    often = met.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > MEETING).select("word", F.lit(True).alias("often"))
    further = F.concat(F.slice("head", F.col("at") + 2, F.size("head")), F.when(F.col("least") < 2, F.array(F.lit(NONE).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    second = F.explode(F.when(F.col("often"), further).otherwise(F.array(F.lit(ONE).cast("long"))))
    return met.join(often, "word", "left").withColumn("second", second).drop("least", "at", "often")


def near_dup_links(sets: DataFrame, limit: float = S.NEAR_DUP_JACCARD) -> DataFrame:
    """(`a`, `b`, `copies_a`, `copies_b`) of different sets (by `id`) whose Jaccard similarity is above `limit`.

    Sets meet in `meeting_rows` with sizes that can reach the limit, and only where they share their first word (and the second),
    so a pair is neither repeated nor collected.  A bit of one sketch that the other lacks stands for a word the other lacks:
    that bounds the shared words, and only pairs within the bound fetch their words, which decide.
    """
    ordered = materialise(ordered_sets(sets), "ordered-sets")
    met = meeting_rows(ordered, limit)
    own = ("id", "n", "head", *(f"s{k}" for k in range(SKETCH)))
    left = met.select("word", "second", *(F.col(c).alias(f"{c}_a") for c in own))
    right = met.select("word", "second", *(F.col(c).alias(f"{c}_b") for c in own))

    def lacked(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"s{k}_{x}").bitwiseAND(F.bitwise_not(F.col(f"s{k}_{y}")))) for k in range(SKETCH)), F.lit(0))

    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    most = F.least(F.col("n_a") - lacked("a", "b"), F.col("n_b") - lacked("b", "a"))
    able = (F.col("id_a") < F.col("id_b")) & (low >= limit * high - 1e-9) & (most / (F.col("n_a") + F.col("n_b") - most) > limit)
    shared = F.array_intersect("head_a", "head_b")
    first = (F.try_element_at(shared, F.lit(1)) == F.col("word")) & (
        (F.col("second") == ONE) | (F.coalesce(F.try_element_at(shared, F.lit(2)), F.lit(NONE).cast("long")) == F.col("second")))
    pairs = left.join(right, ["word", "second"]).where(able & first).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    for end in ("a", "b"):
        pairs = pairs.join(ordered.select(F.col("id").alias(end), F.col("copies").alias(f"copies_{end}"), F.col("words").alias(f"words_{end}")), end)
    return pairs.where(tx.jaccard(F.col("words_a"), F.col("words_b")) > limit).select("a", "b", "copies_a", "copies_b")


def near_dup_classes(rows: DataFrame, key: str, text: str, limit: float = S.NEAR_DUP_JACCARD) -> DataFrame:
    """Per row: `key`, `class_id` (smallest key reachable over links, its own included) and `n_links`.

    Two rows are linked when the Jaccard similarity of their head words is above `limit`.  Rows with equal head words are
    one set with a number of copies; only sets are compared, and links are counted with their copies, never
    expanded.  Rows without words (null or blank text) have no links.
    """
    heads = materialise(head_sets(rows, key, text), "heads")
    counted = heads.where("node IS NOT NULL").groupBy("node", "head").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("least"))
    sets = materialise(counted.withColumn("id", F.monotonically_increasing_id()), "sets")
    links = materialise(near_dup_links(sets, limit), "near-links")
    around = links.select(F.col("a").alias("id"), F.col("copies_b").alias("n")).unionByName(
        links.select(F.col("b").alias("id"), F.col("copies_a").alias("n"))
    ).groupBy("id").agg(F.sum("n").alias("others"))
    parts = connected(links).withColumnRenamed("node", "id")
    named = sets.select("id", "node", "copies", "least").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("class_id"))
    of_set = named.join(smallest, "component").join(around, "id", "left").select(
        "node", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = heads.select(key, "node").join(of_set, "node").select(key, "class_id", "n_links")
    wordless = heads.where("node IS NULL")
    return known.unionByName(wordless.select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links")))
