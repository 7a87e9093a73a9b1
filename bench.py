"""Time the headline queries in a warm session and print one JSON line.

Each time is the median of three runs; a query is not run again once it took ``ENOUGH`` seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import registry  # noqa: E402

RUNS, ENOUGH = 3, 12.0
HEADLINE = [
    "segments_with_markers", "clean_text", "latin_text", "script_census", "translit_documents",
    "grounded_markdown", "grounded_books", "assemble_pages", "lane_routing", "running_lines",
    "cleaned_pages", "probe_script", "pages_todo", "page_warnings", "bibliography",
    "material_context", "audit_context", "material_stats", "content_tree", "material_facets",
    "daily_uploads", "duplicates", "current_status", "retry_plan", "orphans",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    # Start the JVM's and Python's workers outside the timed part.
    registry.run("nfc_text", spark, folder).limit(10).count()
    seconds = {}
    for name in HEADLINE:
        runs = []
        while len(runs) < RUNS and sum(runs) < ENOUGH:
            started = time.time()
            registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
