"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names).
"""

from __future__ import annotations

import json
import os
import time

from quotelake.catalog import QUERIES
from quotelake.session import build_session

HEADLINE = [
    "detection_records", "search_reranked", "knn_top10", "document_windows", "sentence_windows",
    "rule_scores", "keyword_tokens", "route_utterances", "exact_lookup", "greedy_lines",
    "validate_rows", "stratified_split", "cue_accumulation", "asof_anchor", "queue_state",
    "activation_outcomes", "live_detections", "chunk_sliding",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["band_counts"](spark, sf).collect()  # start the executors and the Python workers
    QUERIES["l2_normalise"](spark, sf).limit(1).collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    result = {
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }
    if "search_reranked" in times:
        n = spark.read.parquet(f"{sf}/conversations.parquet").count()
        result["searches_per_sec"] = round(n / times["search_reranked"], 1)
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
