"""Raw columns: headerless binary files, generators, and cleaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, dtype: str = "<f8") -> DataFrame:
    """(file, row_id, v) of headerless little-endian files; a file is one row of Spark's binary source."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) % width:
                    raise ValueError(f"{name}: {len(content)} bytes are no multiple of {width}")
                values = np.frombuffer(content, dtype).astype(float)
                for low in range(0, len(values), 100_000):
                    part = values[low : low + 100_000]
                    yield pd.DataFrame({"file": name, "row_id": np.arange(low, low + len(part)), "v": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row_id long, v double")


def clean(raw: DataFrame, mode: str = "clip") -> DataFrame:
    """Values made non-negative: cut off at 0, or moved by the least value."""
    if mode == "clip":
        return raw.withColumn("v", F.greatest("v", F.lit(0.0)))
    low = raw.agg(F.min("v").alias("low"))
    return raw.crossJoin(F.broadcast(low)).withColumn("v", F.col("v") - F.least("low", F.lit(0.0))).drop("low")  # one row


def profile(raw: DataFrame) -> DataFrame:
    """Counts of what cleaning meets, and the range."""
    v = F.col("v")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return raw.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(finite & (v < 0)).alias("negative"), F.min(F.when(finite, v)).alias("least"), F.max(F.when(finite, v)).alias("most"))


def _uniform(seed: int, salt: int):
    """A value in [0, 1) from the row's number alone, so that partitions don't matter."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def generate(spark: SparkSession, kind: str, rows: int, seed: int = 42) -> DataFrame:
    """(row_id, v): "uniform" of 0 to 1000, "heavy_tailed" lognormal, "zipfian" ranks, "sensor" mean-reverting."""
    ids = spark.range(rows)
    u, w = _uniform(seed, 1), _uniform(seed, 2)
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * w)
    if kind == "uniform":
        v = u * 1000
    elif kind == "heavy_tailed":
        v = F.exp(5 * normal)
    elif kind == "zipfian":
        # The inverse of the continuous distribution of exponent 1.2 over 8192 ranks.
        rank = F.floor(F.pow(1 - u * (1 - 8193.0**-0.2), F.lit(-5.0)))
        v = F.when(_uniform(seed, 3) < 1e-4, 1e6 + 1e6 * w).otherwise(rank + 0.001 * w)
    elif kind == "sensor":
        return _sensor(spark, rows, seed)
    else:
        raise ValueError(f"unknown kind {kind}")
    return ids.select(F.col("id").alias("row_id"), v.alias("v"))


def _sensor(spark: SparkSession, rows: int, seed: int, block: int = 8192) -> DataFrame:
    """Each block of rows reverts to a target of its own from a start of its own, so blocks are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                r = np.random.default_rng([seed, int(b)])
                n = min(block, rows - b * block)
                target, x, noise = 15 + 20 * r.random(), 15 + 20 * r.random(), 0.05 * r.standard_normal(n)
                out = np.empty(n)
                for i in range(n):
                    x += 0.01 * (target - x) + noise[i]
                    out[i] = x
                yield pd.DataFrame({"row_id": np.arange(b * block, b * block + n), "v": np.clip(out, 15, 35)})

    return spark.range(-(-rows // block)).mapInPandas(run, "row_id long, v double")
