"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default: sf0.1), BENCH_CPUS the local cores (default: all). One query runs
untimed first, so that the times do not include the start of the session; each timed query runs once.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.plans import standin
from basketry.plans.queries import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
HEADLINES = (
    "item_popularity",
    "item_dimension",
    "holdout_rank",
    "cooccurrence_pairs_orders",
    "cooccurrence_pairs",
    "cooccurrence_pairs_events",
    "recommend_popular",
    "recommend_cooccurrence",
    "end_to_end",
)


def raw_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cooccurrence_pairs_orders computes, as a plain join of the rows with themselves."""
    rows = standin.order_items(spark, sf_dir)
    popular = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    other = rows.withColumnRenamed("track_id", "candidate").join(popular.withColumnRenamed("track_id", "candidate"), "candidate")
    pairs = rows.join(other, "pid").where(F.col("track_id") != F.col("candidate"))
    return pairs.groupBy("track_id", "candidate", "n").agg(F.count(F.lit(1)).alias("support")).where("support >= 3")


def timed(frame_of, spark: SparkSession) -> float:
    start = time.perf_counter()
    frame_of(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()
    timed(registry["item_popularity_events"], spark)
    seconds = {name: timed(registry[name], spark) for name in HEADLINES}
    compared = {"raw_self_join_orders": timed(raw_self_join, spark)}
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "compared_with": compared,
                "sf": float(scale.group(1)) if scale else SF_DIR,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
