"""Stages of the corpus pipeline: (spark, docs, sf_dir) to DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atril.llm import packing, secret_scan, setjoin, suffixes, toxicity
from atril.llm.common import hold_batches, materialise, put_back, set_aside
from atril.llm.queries import toxic_lexicon

#: Columns the toxicity score adds.
RESULT = {"score", "n_hits", "predicted"}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity score doesn't reject; the lexicon is learnt from the rows operator 2 may use.

    Null and empty texts, which have no hits, stay; each of several equal rows is judged alike; an empty table stays
    empty; all columns are returned as they are, also those named like the score's own.
    """
    hold_batches(spark)
    aside, before = set_aside(docs, RESULT)
    return put_back(toxicity.score(aside, toxic_lexicon(spark, sf_dir, docs)).where("predicted = 0"), before, RESULT)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: the smallest doc_id, of several texts under it the one of the
    smallest hash, of equal rows any.

    A null doc_id stands only for a class without others; texts without words are in no class and all stay.
    """
    hold_batches(spark)
    own = "_" * (1 + max(map(len, docs.columns)))  # no column has this name
    stand_in = materialise(setjoin.stand_ins(docs).withColumnRenamed("row", own), "stand-ins")
    wordless = F.length(F.trim(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     "))) == 0
    # The join and the choice among equal rows share one exchange of the texts.
    kept = docs.where(~wordless).withColumn(own, setjoin.row_hash()).join(stand_in, own, "left_semi")
    return kept.dropDuplicates([own, "doc_id"]).select(*docs.columns).unionByName(docs.where(wordless))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; characters cut in two are left out, documents left empty go.

    Null, empty and short texts stay as they are; equal rows of at least 200 bytes repeat each other and all go; an
    empty table stays empty; `n_chars`, where there is one, follows a changed text; other columns are returned as
    they are, also those named like the operator's own.
    """
    hold_batches(spark)
    aside, before = set_aside(docs, suffixes.ADDED)
    cut = suffixes.cut_repeats(aside, characters=True)
    changed = F.col("n_removed") > 0
    shorter = cut.withColumn("text", F.when(changed, F.decode("kept", "UTF-8")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        shorter = shorter.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return put_back(shorter.where("n_bytes = 0 OR octet_length(kept) > 0"), before, suffixes.ADDED)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span replaced by `<kind>`.

    Null and empty texts stay as they are; equal rows are masked alike; an empty table stays empty; `n_chars`
    follows the text, and other columns are returned as they are.
    """
    hold_batches(spark)
    return secret_scan.mask(docs, secret_scan.train(docs)).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids, as operator 3 packs them (see there for nulls, empty texts
    and repeated rows); other columns are ignored."""
    hold_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
