"""Rates of reading recordings: million events a second by format, of 1, 4 and 16 equal recordings, and of one in splits of 1 MB by
an index that was built before; prints one JSON line.

Peak and mean of $BENCH_REPEATS (5) runs after a warm-up; the files are in the page cache and the JVM is up. Counts are compared
with what was written. $BENCH_EVENTS (2,000,000) uniform events a recording, $BENCH_CPUS (8) cores.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from photonlake.sources import codecs, datasource, recordings, splits

FORMATS = os.environ.get("BENCH_FORMATS", "evt2,evt21,evt3,evt4,dat").split(",")


def rate(rows: DataFrame, n: int, repeats: int) -> dict[str, float]:
    if rows.count() != n:
        raise RuntimeError("rows were lost")
    times = []
    for _ in range(repeats):
        start = time.time()
        rows.write.format("noop").mode("overwrite").save()
        times.append(time.time() - start)
    return {"peak": round(n / min(times) / 1e6, 2), "mean": round(n * repeats / sum(times) / 1e6, 2)}


def main() -> None:
    n, repeats, cpus = (int(os.environ.get(k, v)) for k, v in (("BENCH_EVENTS", 2_000_000), ("BENCH_REPEATS", 5), ("BENCH_CPUS", 8)))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "1m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    datasource.register(spark)
    r = np.random.default_rng(1)
    columns = np.sort(r.integers(0, n, n)), r.integers(0, 1280, n), r.integers(0, 720, n), r.integers(0, 2, n)
    rates, folder = {}, tempfile.mkdtemp(prefix="rates-")
    try:
        for fmt in FORMATS:
            data = codecs.encode(fmt, *columns)
            for copies in (1, 4, 16):
                at = f"{folder}/{fmt}-{copies}"
                os.mkdir(at)
                for k in range(copies):
                    with open(f"{at}/{k}.{fmt}", "wb") as out:
                        out.write(data)
                rates[f"{fmt} x{copies}"] = rate(recordings.read_events(spark, at), n * copies, repeats)
            splits.build_index(spark, f"{folder}/{fmt}-1", size=1 << 20).write.parquet(f"{folder}/{fmt}-index")
            rates[f"{fmt} x1, index"] = rate(spark.read.format("event_recordings").option("index", f"{folder}/{fmt}-index").load(f"{folder}/{fmt}-1"), n, repeats)
    finally:
        shutil.rmtree(folder)
        spark.stop()
    print(json.dumps({"metric": "decode rate", "unit": "M events/s", "events a recording": n, "cores": cpus, "rates": rates}))


if __name__ == "__main__":
    main()
