"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the noop sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "chunks",
    "chapters_by_heading",
    "sections_marked",
    "embed_hash",
    "postings_stats",
    "bm25_top10",
    "bm25_synonyms",
    "knn_top10",
    "knn_cells",
    "hybrid_weighted_saturation",
    "hybrid_rrf",
    "hybrid_rerank",
    "hits_collapsed",
    "chapters_assembled",
    "context_sources",
    "messages",
    "entity_profiles",
    "corpus_upsert",
    "corpus_jsonl",
    # the ways of large inputs
    "bm25_joined",
    "bm25_indexed",
    "hit_counts",
    "knn_approx",
    "corpus_table",
    "bm25_upserted",
    "embed_lsa",
    "ingest_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strata-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload.queries import REGISTRY

    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
