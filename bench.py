"""Headline queries on a written plane layout against the raw column; prints one JSON line.

The table of the scale factor is a megabyte, where jobs cost more than scans; so the same queries also run on generated
rows ($BENCH_ROWS, none for 0), whose values rise slowly, as measurements do, so that segments differ.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.operators import aggregates as A
from sigplane.operators import paths
from sigplane.operators import predicate as P
from sigplane.plans import layout
from sigplane.sources import raw as raw_source


def folder_bytes(path: str, columns: list[str]) -> int:
    """Compressed bytes of some columns of a Parquet table: what a scan of them reads."""
    import glob

    import pyarrow.parquet as pq

    total = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema in columns:
                    total += column.total_compressed_size
    return total


def headline(spark: SparkSession, raw: DataFrame, out: str, prefix: str, timed) -> None:
    began = time.perf_counter()
    layout.write(layout.encode(raw, precision=4, segment=layout.SEGMENT), out, "values")
    TIMES[f"{prefix}encode_and_write"] = round(time.perf_counter() - began, 4)
    p = layout.read(spark, out)
    stored = spark.read.parquet(f"{out}/planes").select("row_id", "v")
    cut = stored.approxQuantile("v", [0.1, 0.5, 0.9], 0.001)
    for share, t in zip((90, 50, 10), cut, strict=True):
        timed(f"{prefix}raw_filter_sum_s{share}", lambda t=t: stored.where(F.col("v") > t).agg(F.count("*"), F.sum("v")))
        for k in range(1, p.planes + 1):
            timed(f"{prefix}filter_sum_k{k}_s{share}", lambda t=t, k=k: A.filter_sum(p, t, k))
    for k in range(1, p.planes + 1):
        timed(f"{prefix}count_qdu_k{k}", lambda k=k: P.count_interval(p, cut[1], k))
        timed(f"{prefix}progressive_sum_k{k}", lambda k=k: A.progressive_sum(p, k))
    timed(f"{prefix}raw_sum", lambda: stored.agg(F.sum("v")))
    wide = paths.columns(stored)
    plan = stored.where("row_id % 9973 = 0").select("row_id", F.lit(7).cast("long").alias("plane"), F.lit(0).cast("long").alias("replica"), F.lit(1).cast("long").alias("mask"))
    copies = [1, 1, 1, 1, 1, 1, 3, 3]
    timed(f"{prefix}vote_r3_filter_sum", lambda: paths.fused(paths.with_masks(wide, plan, copies), copies, cut[1], 8, "vote"), 1)
    BYTES[f"{prefix}raw"] = folder_bytes(f"{out}/planes", ["v"])
    for k in range(1, p.planes + 1):
        BYTES[f"{prefix}k{k}"] = folder_bytes(f"{out}/planes", [*layout.SEGMENT_NUMBERS, *(f"b{i}" for i in range(k))])


TIMES: dict[str, float] = {}
BYTES: dict[str, int] = {}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_ROWS", "20000000"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="sigplane-bench-")
    try:

        def timed(name, make, repeat: int = 3) -> None:
            make().collect()  # compiles and warms
            found = []
            for _ in range(repeat):
                began = time.perf_counter()
                make().collect()
                found.append(time.perf_counter() - began)
            TIMES[name] = round(sorted(found)[repeat // 2], 4)

        headline(spark, spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("row_id"), F.col("value").alias("v")), f"{out}/events", "", timed)
        if rows:
            noise = raw_source.generate(spark, "uniform", rows)
            headline(spark, noise.select("row_id", (F.col("row_id") / (rows / 1000.0) + F.col("v") / 50).alias("v")), f"{out}/generated", "large_", timed)
        total = round(sum(v for n, v in TIMES.items() if n.startswith("filter_sum")), 4)
        print(json.dumps({"metric": "fused filter and sum on k planes, all selectivities", "value": total, "unit": "sec", "queries": TIMES, "column_bytes": BYTES, "generated_rows": rows, "sf": sf}))
    finally:
        spark.stop()
        shutil.rmtree(out, ignore_errors=True)


if __name__ == "__main__":
    main()
