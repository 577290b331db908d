"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ("t18_fixed_split", "k3_postings", "k3_bm25_top_k", "k4_token_overlap", "k1_dense_knn", "d1_weighted_rrf", "t1_elements", "t9_adaptive_split", "t15_parent_child", "t6_profile", "sc4_html_text", "sc13_upsert", "j3_base_rollup", "t16_assign_parents", "g2_trails", "st3_task_transitions", "e1_e6_case_scores")


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from corvane.plans import catalog

    queries, took = catalog.queries(), {}
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    queries["d1_weighted_rrf"](spark, small if os.path.isdir(small) else sf).write.format("noop").mode("overwrite").save()  # starts Python workers
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
