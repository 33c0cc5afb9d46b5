"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "nw_score_global", "local_score", "semiglobal_score_both", "distance_matrix", "guide_tree_average", "preprofile_global",
    "preprofile_local", "msa_tree", "msa_adhoc", "msa_multitrack", "position_frequencies", "profile_probabilities", "consensus",
    "position_scores", "conservation", "match_score_grid", "fasta_read", "fasta_write", "hit_filter_limit_then_filter",
)


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from symloom.plans import catalog

    queries = {n: catalog.QUERIES[n] for n in HEADLINE}
    try:
        from symloom.llm import entries

        queries |= entries.QUERIES
    except ImportError:
        pass
    catalog.QUERIES["encode_symbols"](spark, sf_dir).count()  # starts the JVM's and Python's workers
    took = {}
    for name, query in queries.items():
        start = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
