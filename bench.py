"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is run to completion into Spark's no-op sink, so every output row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from slotweave.plans.registry import catalogue
from slotweave.session import local_session

HEADLINE = [
    "text_keys", "text_key_groups", "pad_truncate_ids", "contaminated_lines", "cascade_counts", "split_audit",
    "scan_annotated_jsonl", "scan_part_json", "scan_annotation_log", "log_pairing", "tag_spans",
    "slot_freq", "topk_vocab", "corpus_summary", "augment_cartesian", "augment_by_template", "augment_report", "topk_sweep",
    "nn1_cosine", "nn1_metrics", "topk_vote", "prototype_nn", "mix_sweep", "uniformity", "align_intent_sets",
    "infonce_losses", "token_pooling", "package_rows", "package_round_trip", "content_digest", "seed_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, 8, app="bench")
    known = catalogue()
    known["text_keys"](spark, folder).limit(1).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
