"""Wall time of the headline queries: prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from corpusaudit.plans.registry import QUERIES  # noqa: E402
from corpusaudit.session import configure  # noqa: E402

HEADLINE = (
    "token_multiset",
    "text_loss_totals",
    "text_loss",
    "candidate_states",
    "artifact_names",
    "page_links_by_kind",
    "page_words",
    "page_verdicts",
    "tree_constructs",
    "link_stripping",
    "package_links",
    "package_problems",
    "rewritten_text",
    "rewritten_loss",
    "transform_log",
    "recovered_notes",
    "corpus_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]"))
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["word_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark_version = spark.version
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark_version,
                "shuffle_partitions": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
