"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query's rows are produced in full (noop sink), after one warm-up run that compiles its code; the value is the
total of the timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = (
    "tpch_q1 tpch_q3 tpch_q4 tpch_q5 tpch_q6 tpch_q7 tpch_q8 tpch_q10 tpch_q13 tpch_q14 tpch_q15 tpch_q17 tpch_q18 tpch_q19 tpch_q21 tpch_q22 "
    "aggregate_global aggregate_having rollup join_multiway join_left window_aggregates top_k_per_group cte_multiple subquery_correlated "
    "dml_merge vector_search_filtered vector_knn text_search graph_bfs window_tumbling"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from basalt.plans.all import OPERATORS
    from basalt.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "basalt-bench", spark__driver__memory="8g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        for timed in (False, True):
            began = time.perf_counter()
            OPERATORS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
