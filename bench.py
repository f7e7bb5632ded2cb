"""Time the headline queries and print one JSON line: the median of some runs of each, after a run that warms up."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from treeloom.plans import catalog

HEADLINE = (
    "html_tag_counts html_roundtrip_md5 html_link_targets html_max_nesting_elem css_decls_from_pages css_roundtrip_md5 js_groups "
    "json_lint_events json_path_events json_tape_kinds json_members_orders json_elems_lineitem md_text_lines_documents yaml_entries cfg_entries vds_precedence"
).split()
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    median, best = {}, {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        median[name], best[name] = round(statistics.median(took[1:]), 3), round(min(took), 3)
    total = round(sum(median.values()), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": total, "unit": "sec", "queries": median, "best": best, "runs": RUNS, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
