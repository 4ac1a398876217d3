"""Gates and summaries of repeated runs: paired differences, factor criteria, duplicate reads, timings, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigplane.operators.reliability import ci95


def interval(df: DataFrame, x: str, *by: str) -> DataFrame:
    """(by, n, mean, low, high): the 95 % interval of a mean; zeros around a single value."""
    mean, half = ci95(x)
    a = df.groupBy(*by).agg(F.count(x).alias("n"), mean, half)
    return a.select(*by, "n", "mean", (F.col("mean") - F.col("half_width")).alias("low"), (F.col("mean") + F.col("half_width")).alias("high"))


def paired_gate(runs: DataFrame, first: str, second: str, least: float = 1e-7, most: float = 1e-5) -> DataFrame:
    """(rate, n, mean, low, high, wins) of error(second) - error(first) for runs (policy, rate, seed, error), paired by rate and seed."""
    a = runs.where(F.col("policy") == first).select("rate", "seed", F.col("error").alias("e1"))
    b = runs.where(F.col("policy") == second).select("rate", "seed", F.col("error").alias("e2"))
    delta = a.join(b, ["rate", "seed"]).where(F.col("rate").between(least, most)).withColumn("delta", F.col("e2") - F.col("e1"))
    return interval(delta, "delta", "rate").withColumn("wins", F.col("low") > 0)


#: Modes that should stand a kind of fault; all others are the other group.
GOOD_MODES = {"cluster": ("D1", "D3"), "temporal": ("D2", "D3")}


def factor_criterion(rates: DataFrame) -> DataFrame:
    """(fault, rate, good_low, bad_high, passes) of (fault, mode, rate, seed, value): the good group's interval lies above the other's."""
    good = F.lit(False)
    for fault, modes in GOOD_MODES.items():
        good = good | ((F.col("fault") == fault) & F.col("mode").isin(*modes))
    both = interval(rates.withColumn("good", good), "value", "fault", "rate", "good")
    a = both.where("good").select("fault", "rate", F.col("low").alias("good_low"))
    b = both.where("NOT good").select("fault", "rate", F.col("high").alias("bad_high"))
    return a.join(b, ["fault", "rate"]).withColumn("passes", F.col("good_low") > F.col("bad_high"))


def duplicate_reads(planes: DataFrame, other: DataFrame) -> DataFrame:
    """(plane, mismatches) of two reads of the same planes; a byte that one lacks is a mismatch."""
    both = planes.join(other.withColumnRenamed("byte", "again"), ["plane", "row_id"], "full")
    return both.groupBy("plane").agg(F.count_if(~F.col("byte").eqNullSafe(F.col("again"))).alias("mismatches"))


def timing(runs: DataFrame, x: str, *by: str) -> DataFrame:
    """Median, deciles, mean, extremes and population deviation of each group."""
    return runs.groupBy(*by).agg(
        F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.1).alias("p10"), F.percentile(x, 0.9).alias("p90"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.stddev_pop(x).alias("deviation"),
    )


def drift_verdict(points: Column) -> Column:
    """By the drift of a selectivity in percentage points."""
    drift = F.abs(points)
    return F.when(drift <= 0.1, "acceptable").when(drift <= 1.0, "caution").otherwise("catastrophic")


def index_threshold(raw: DataFrame, selectivities: list[float]) -> DataFrame:
    """(selectivity, threshold): the value of place floor(n (1 - s)) in the order of all values, for thresholds that a share s exceeds.

    Values are counted first, so the order is found among distinct values by running totals of range buckets.
    """
    counts = raw.groupBy("v").agg(F.count("*").alias("c"))
    n = raw.count()
    places = raw.sparkSession.createDataFrame([(float(s), min(max(int(n * (1.0 - s)), 0), max(n - 1, 0))) for s in selectivities], "selectivity double, place long")
    # Buckets by a quantile sketch bound what one window sees; their totals are a handful of rows.
    cuts = sorted(set(raw.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.001)))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("v") > c).cast("int")
    counts = counts.withColumn("bucket", bucket)
    before, total = [], 0
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("c")).orderBy("bucket").collect():  # 64 rows at most
        before.append((r["bucket"], total))
        total += r["c"]
    starts = raw.sparkSession.createDataFrame(before, "bucket int, before long")
    from pyspark.sql.window import Window

    run = counts.join(F.broadcast(starts), "bucket").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("bucket").orderBy("v")))
    found = run.join(F.broadcast(places), (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))  # a handful of places
    return found.select("selectivity", F.col("v").alias("threshold"))
