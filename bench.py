"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from fieldmill.checks import all_checks
from fieldmill.checks.base import Tables
from fieldmill.session import build_session

# From each part of the inventory the queries that read the most data.
HEADLINE = (
    "b1_harvest_links", "b2_extract_fields", "b4_page_text", "c4_funding_category", "c11_context_entities",
    "d1_clean_text", "e1_split_sections", "e2_split_recursive", "f2_eligible_counts", "f5_knn", "f7_bm25_terms",
    "f8_bm25_topk", "f10_rrf", "f15_match", "g4_upsert_merge", "g6_chat_history", "h2_completeness",
    "h3_duplicate_lineitems", "h4_top_values", "h12_distribution_lineitem", "h21_size_stats", "h21_describe_lineitem",
    "i4_dashboard", "m1_master_table",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    tables, checks = Tables(spark, folder), all_checks()
    # start-up, of Python workers too, is not part of any query
    tables.documents.count()
    spark.range(64).repartition(int(cpus)).mapInPandas(lambda frames: frames, "id long").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        checks[name].run(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
