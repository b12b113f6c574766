"""Time the headline queries (or all of them with --all) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tandemlens.plans import registered
from tandemlens.session import local_session
from tandemlens.sources.tables import table

# Query and the table whose rows give its throughput.
HEADLINE = {
    "complementarity_block": "labels",
    "experiment_complementarity": "labels",
    "binary_metrics": "labels",
    "roc_auc": "labels",
    "ir_metrics_at_k": "lineitem",
    "ir_map": "lineitem",
    "topk_per_query": "lineitem",
    "text_length_profile": "documents",
    "qa_profile": "conversations",
    "qa_pairs": "conversations",
    "qa_features": "conversations",
    "answer_clean": "documents",
    "span_detokenise": "documents",
    "ir_pairs": "lineitem",
    "kg_vocab": "orders",
    "kg_encode": "orders",
    "kg_labels_default": "orders",
    "entity_linking": "documents",
    "gcn_message_pass": "orders",
    "null_byte_filter": "documents",
    "html_sniff": "pages",
    "auto_step": "events",
    "best_value_marks": "events",
    "batch_assignment": "orders",
    "jsonl_rejects": "events",
    "kg_gzip_roundtrip": "orders",
    "cross_attention_fusion": "embeddings",
    "gating_fusion": "embeddings",
    "bilinear_fusion": "embeddings",
    "contrastive_fusion": "embeddings",
    "streaming_binary_metrics": "events",
}


def drain(df) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main(argv: list[str]) -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered().queries
    names = list(queries) if "--all" in argv else list(HEADLINE)
    seconds, rates = {}, {}
    for name in names:
        if "--all" not in argv:
            drain(queries[name](spark, root))  # warm-up: compile and load
        start = time.perf_counter()
        drain(queries[name](spark, root))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        if name in HEADLINE:
            rows = table(spark, root, HEADLINE[name]).count()
            rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
