"""Run the headline queries and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import time

from changelens.plans import registry
from changelens.plans.session import local_session

HEADLINE = [
    "exemplar_topk_by_label", "three_channel_fusion", "mmr_diverse", "multilabel_micro_prf", "paired_track_delta", "per_type_confusion",
    "cooccurrence_npmi", "association_rules", "vote_candidates", "type_avg_size_filter", "citation_overlap", "best_line_window",
    "ordered_dedupe", "group_split", "type_sample", "chat_transcript", "greedy_char_budget", "resume_anti_join", "run_pairing",
    "token_rename_votes", "signal_blocks", "structural_delta", "reply_two_step", "ingest_layouts", "python_cleanup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("changelens-bench", cores)
    registry.QUERIES["chat_transcript"](spark, sf_dir).count()  # start the JVM's first job outside the timings
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
