"""Seconds of the headline queries, as one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from plexweave.plans.catalogue import QUERIES

HEADLINE = ("ibu_sort", "ibu_reads", "ibu_count", "count_by_gene", "umi_correct", "whitelist_hd1", "whitelist_remap", "map_gex", "map_crispr", "pipeline_gex", "pipeline_crispr", "guide_assign", "guide_assign_mixture", "droplet_filter", "empty_drops")
LLM = ("op1_toxicity", "op2_near_dedup", "op3_neighbours", "op4_language", "op5_html_text", "op6_mix", "op7_substring_dedup", "op8_licences", "op9_exact_dedup", "op10_bpe", "op11_byte_bpe", "op12_spelling", "op13_filter_audit")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINE}
    try:
        from plexweave.llm.queries import QUERIES as more

        queries |= {name: more[name] for name in LLM}
    except ImportError:  # without the training-data operators
        pass
    seconds = {}
    for name, query in queries.items():
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
