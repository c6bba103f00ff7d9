"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

The session is warmed up first, and the lexicon that the matching queries share is built first, timed as ``lexicon_build``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lautwerk.plans.queries import open_lexicon, queries, words

HEADLINE = (
    "normalize_tokens", "skeleton_keys", "cologne_keys", "merge_records", "lexicon_rank", "ngram_counts", "candidates",
    "match_topk", "probability", "hydrate", "similarity", "search_prefix", "lexicon_stats",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = queries(), {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)

    words(spark, folder).count()  # warm up
    timed("lexicon_build", lambda: open_lexicon(spark, folder))
    for name in HEADLINE:
        timed(name, lambda: found[name](spark, folder).write.format("noop").mode("overwrite").save())  # noqa: B023
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
