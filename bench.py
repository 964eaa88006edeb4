"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vektorium.operators import index, kmeans, search  # noqa: E402
from vektorium.plans import queries as plans  # noqa: E402
from vektorium.sources import fixtures  # noqa: E402
from vektorium.storage import scratch, stored  # noqa: E402

HEADLINE = ["features", "parse_json", "route_requests", "knn_verdict", "kmeans_step", "kmeans_assign", "ivf_build", "bbox_prune", "eval_p99", "label_stats"]
#: Searches over stored vectors and a written index, against brute force over the same vectors.
SEARCHES = ["search_exact", "search_fast", "search_full", "search_adaptive"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(query) -> tuple[float, int]:
        began = time.perf_counter()
        n = len(query(spark, sf_dir).toArrow())
        took = time.perf_counter() - began
        spark.catalog.clearCache()
        return took, n

    timed(plans.features)  # starts the JVM's and the workers' engines
    found = {name: timed(plans.queries()[name])[0] for name in HEADLINE}

    points = stored(fixtures.vectors(spark, sf_dir))
    queries, folder = stored(fixtures.queries_of(points)), scratch(spark)
    began = time.perf_counter()
    index.write(*index.build(points, kmeans.step(points, kmeans.lowest_rows(points, plans.K))), folder)
    found["index_write"] = time.perf_counter() - began
    held = index.Index(spark, folder)
    work = {name: (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)) for name in ("search_full", "search_adaptive")}
    runs = {
        "search_exact": lambda: search.votes(search.knn_exact(queries, points), queries),
        "search_fast": lambda: search.index_votes(held, queries, plans.FAST),
        "search_full": lambda: search.index_votes(held, queries, plans.FULL),
        "search_adaptive": lambda: search.index_adaptive(held, queries, plans.FAST, plans.FULL),
    }
    votes = {}
    for name in SEARCHES:
        runs[name]().toArrow()  # warm, all alike
        began = time.perf_counter()
        rows = runs[name]().toArrow().to_pylist()
        found[name] = time.perf_counter() - began
        votes[name] = {r["query_id"]: r["votes"] for r in rows}
    near = search.index_neighbours(held, queries, plans.FULL, work=work["search_full"]).select("query_id", "row_id").collect()
    search.index_adaptive(held, queries, plans.FAST, plans.FULL, work=work["search_adaptive"]).toArrow()
    true = {tuple(r) for r in search.knn_exact(queries, points).select("query_id", "row_id").collect()}
    exact = votes.pop("search_exact")
    agree = {k: {"same_count": sum(v[q] == exact[q] for q in exact) / len(exact), "same_verdict": sum((v[q] < 3) == (exact[q] < 3) for q in exact) / len(exact)} for k, v in votes.items()}
    rate = {k: round(len(exact) / found[k], 1) for k in SEARCHES}
    skipped = {k: round(1 - done.value / max(every.value, 1), 3) for k, (done, every) in work.items()}
    recall = len(true & {tuple(r) for r in near}) / len(true)
    total = sum(found.values())
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(total, 3), "unit": "sec", "queries": {k: round(t, 3) for k, t in found.items()}, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "queries_per_second": rate, "agreement": agree, "recall_at_5": round(recall, 4), "skipped_squares": skipped}))
    spark.stop()


if __name__ == "__main__":
    main()
