"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
BENCH_QUERIES may hold a comma-separated list of query names, or 'all'.
"""

import json
import os
import sys
import time

from checks import collect
from docweave.testing import local_session

HEADLINE = [
    "t1_split_sentences", "t2_clean_text", "t5_html_to_text", "k1_keywords",
    "c2_recursive_chunks", "c3_fixed_windows", "c5_adjacent_similarity", "c7_pairwise_similarity", "c8_similarity_profile",
    "c10_cluster_density", "c16_pack_chunks", "c23_semantic_chunks_sequential", "c23_semantic_chunks_clustered", "e1_tfidf",
    "e6_resize_redistribute", "e7_resize_dct", "r1_semantic_search", "r2_keyword_search", "r10_bm25", "r13_retrieve",
    "p1_build_context", "h1_recent_messages", "h2_history", "l2_update_text", "l17_rollup_descriptions",
    "q3_hit_stats", "v7_bleu", "v10_rouge_l", "v15_evaluate", "v16_metric_stats", "d1_flatten_qa", "d7_explode_paper_qa",
    "g5_resolve_config", "w1_ingest_stream", "w3_conversation_stream",
]


def main():
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    queries = collect()[0]
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cores)
    spark.read.parquet(f"{directory}/region.parquet").count()
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
