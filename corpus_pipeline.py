"""Corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atril.llm import stages
from atril.llm.common import materialise, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard", stages.one_per_group),
    ("suffix_array", stages.cut_repeats),
    ("secrets", stages.mask_secrets),
    ("packing", stages.pack),
]

#: None: learnt lexicons, automata and tokenizers can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
