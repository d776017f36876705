"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of local threads.  The
graph is built first and timed as ``load``, its edge table as ``edges``; the other queries reuse them, as a session would.  Each result is counted in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from arbora.operators.traverse import typed_bfs  # noqa: E402
from arbora.plans.catalog import QUERIES  # noqa: E402
from arbora.plans.warehouse import ROOT, warehouse  # noqa: E402
from arbora.session import release  # noqa: E402

HEADLINE = (
    "normalize_links",
    "org_depth",
    "report_subtree",
    "person_all_orgs",
    "hierarchy_levels",
    "levels_from_roots",
    "multi_root_merge",
    "subgraph_hidden",
    "subgraph_diff",
    "parse_attributes",
    "merge_attributes",
    "active_attributes_per_person",
    "search_nodes",
    "resolve_node",
    "display_label",
    "org_legend",
    "group_hull",
    "hulls_at_point",
    "person_detail",
    "graph_stats",
    "attribute_stream",
)


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("arbora-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    w = warehouse(spark, sf_dir)
    w.ask("SELECT count(*) FROM {customer}").collect()
    seconds = {"load": timed(lambda: w.graph.links)}
    seconds["edges"] = timed(lambda: w.graph.edges("both").df)
    for depth in (2, 3, 4, 6):
        seconds[f"typed_bfs_depth{depth}"] = timed(lambda d=depth: typed_bfs(w.graph, w.roots(ROOT), d, "both"))
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: QUERIES[n](spark, sf_dir))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
