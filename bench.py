"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "hybrid_search", "vector_search", "vector_topk", "keyword_topk", "answer_cache_lookup", "chunk_prose", "chunk_rows",
    "clean_text", "embed_texts", "ingest_documents", "usage_totals", "top_queries", "previous_user_turn", "history_window",
    "rolling_token_usage_minute", "content_hash_duplicates", "detect_ambiguity", "detect_program_filter",
    "score_retrieval", "generation_summary", "grid_sections", "page_with_total", "stream_token_budget",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from atril.plans import registry

    registry.load()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.atril.spread", CPUS)  # the given files hold one row group each
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("sum(length(text))").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
