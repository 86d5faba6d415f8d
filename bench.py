"""Times every report at one scale and prints one JSON line.

BENCH_SF_DIR names the table directory, BENCH_CPUS the local cores. Each report
is run in full into Spark's no-op sink; the best of BENCH_RUNS runs counts.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ferrybook.plans.reports import reports  # noqa: E402
from ferrybook.plans.settings import session_settings  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    size = sum(f.stat().st_size for f in Path(sf_dir).glob("*.parquet"))

    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in session_settings(shuffle_bytes=4 * size, cores=cpus).items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(report) -> float:
        began = time.perf_counter()
        report(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    named = reports()
    run(named["totals"])  # starts the JVM's compilers, not counted
    times = {name: min(run(report) for _ in range(runs)) for name, report in named.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "all reports, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in times.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
