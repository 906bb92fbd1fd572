"""Benchmark: prints one JSON line with seconds per headline query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Times are
medians of warm runs; the index is built first and timed as its own entry.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioquery.catalog import answers, evaluation, logs, markdown, retrieval  # noqa: E402, F401
from folioquery.catalog.base import QUERIES as REGISTERED  # noqa: E402
from folioquery.operators.sparse import build_index  # noqa: E402
from folioquery.plans.build import build_store  # noqa: E402
from folioquery.providers import offline  # noqa: E402
from folioquery.session import local_session, new_table_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def build_sparse(spark, sf):
    return build_index(retrieval.table(spark, sf, "documents")).write(new_table_path(spark, "bench-index")).stats


def build_all(spark, sf):
    return build_store(markdown.documents(spark, sf), offline(), new_table_path(spark, "bench-store")).chunks


QUERIES = {
    "build_sparse_index": build_sparse,
    "build_store": build_all,
    **{name: REGISTERED[name] for name in (
        "document_chunks", "report_chunks", "ref_ids", "bm25_top12", "knn_l2", "rrf_fusion", "rerank_lexical", "answer_plan",
        "history_window_1000", "eval_rollup", "log_pairing", "latency_p80")},
}


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, fn in QUERIES.items():
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            run(fn(spark, SF_DIR))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr)
    questions = retrieval.questions(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "headline queries, sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""), "cpus": CPUS,
        "questions": questions, "fused_retrieval_sec_per_question": round(seconds["rrf_fusion"] / questions, 5)}))


if __name__ == "__main__":
    main()
