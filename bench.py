"""Headline-query benchmark.

Runs a representative query of every operator family at $BENCH_SF_DIR
(default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one JSON
line. Each query is executed completely (noop sink), not just planned.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "genre_evolution", "budget_revenue_fit", "roi_by_genre", "rating_by_genre", "kpi_summary",
    "financial_correlation", "etl_funnel", "clean_catalog", "browse_popular", "search_title",
    "link_records", "profile_top_per_group", "tfidf_weights", "similar_items", "embedding_knn",
    "precision_at_k", "hybrid_recommend", "svd_singular_values", "recommend_users",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from marquee.plans.registry import load_all
    from marquee.session import checkpoint_dir, local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="marquee-bench")
    checkpoint_dir(spark)
    reg = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in reg]
    times = {}
    t_all = time.time()
    for name in names:
        fn, _ = reg[name]
        t0 = time.time()
        fn(spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - t_all, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_time", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
