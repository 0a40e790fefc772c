"""Times the headline queries: one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local cores; BENCH_RUNS: runs a query, of which the median counts, after one that doesn't."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from plumbline.plans import catalogue
from plumbline.tsql.frontend import Extractor

#: Scripts that the extractor is timed on, each a table, a view and a procedure.
FILES = 20
SCRIPT = """CREATE TABLE S.dbo.t{n} (id INT NOT NULL, x INT, at DATETIME, note NVARCHAR(50));
GO
CREATE VIEW S.dbo.v{n} AS SELECT t.id, t.x * 2 AS twice, YEAR(t.at) AS year, UPPER(t.note) AS note FROM S.dbo.t{n} AS t WITH (NOLOCK) WHERE t.x > 0;
GO
CREATE PROCEDURE M.dbo.p{n} AS BEGIN SELECT v.year, SUM(v.twice) AS total INTO #s FROM S.dbo.v{n} AS v GROUP BY v.year; INSERT INTO M.dbo.f{n} (year, total) SELECT s.year, s.total FROM #s AS s; END
"""

HEADLINE = [
    "stg_orders", "fct_sales", "agg_sales_by_day", "vw_order_details_star", "vw_customer_order_analysis", "vw_customer_order_ranking", "vw_sales_analytics", "usp_customer_metrics", "usp_top_products", "demo_tvf_proc",
    "merge_upsert", "set_intersect", "pivot_status", "graph_edges", "impact_downstream", "impact_depth2", "graph_degree_rank", "topo_waves", "diff_columns", "registry_resolve",
]


def main() -> None:
    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
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
    queries, took = catalogue.queries(), {}
    for name in HEADLINE:
        times = []
        for run in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:  # the first compiles
                times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 3)
    began = time.perf_counter()
    found = Extractor(spark)
    for n in range(FILES):
        found.script(SCRIPT.format(n=n))
    files = FILES / (time.perf_counter() - began)
    spark.stop()
    print(json.dumps({"metric": "seconds, all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2], "extract_files_per_sec": round(files, 1)}))


if __name__ == "__main__":
    main()
