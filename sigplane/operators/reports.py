"""Tables of measured runs: joins with reference runs, throughput and traffic, and summaries of a layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent_bucket(selectivity: Column) -> Column:
    """The reported selectivity in percent; null stays null."""
    return F.when(selectivity < 0.15, 10).when(selectivity < 0.55, 50).when(selectivity.isNotNull(), 90)


def precision_power(label: Column) -> Column:
    """The number in a label such as ``p4``; null without one."""
    found = F.regexp_extract(label, r"p(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def megabytes(size: Column) -> Column:
    """``1.5 Gbyte``, ``20 Mbyte`` or a plain number of megabytes; null for other texts."""
    text = F.trim(size)
    number = F.trim(F.regexp_replace(text, "[GM]byte$", "")).try_cast("double")
    return number * F.when(text.endswith("Gbyte"), 1024.0).otherwise(1.0)


def _one_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.  Few rows share a key, since keys name runs."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def with_throughput(best: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("dataset", "artifact")) -> DataFrame:
    """``best`` (keys, k_star) with the columns of the run of that depth, or nulls; a second run of a key is an error."""
    counted = runs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "k")))
    checked = counted.withColumn("k_star", F.when(F.col("_n") == 1, F.col("k")).otherwise(F.raise_error(F.lit("two runs of one key")).cast("int")))
    return best.join(checked.drop("_n", "k"), [*keys, "k_star"], "left")


def match_reference(runs: DataFrame, reference: DataFrame, *, near: float = 0.05) -> DataFrame:
    """Each run (run_id, dataset, k, threshold, selectivity) with its reference run, as ref_id and by_threshold_only.

    A reference run has the same dataset and depth and a threshold within a millionth.  Selectivities may be
    percentages, or the complement; runs within ``near`` come first, by closeness, else the closest threshold
    counts.  Runs without a partner are left out.
    """
    ref = reference.select("ref_id", "dataset", "k", F.col("threshold").alias("_t"), F.when(F.col("selectivity") > 1, F.col("selectivity") / 100).otherwise(F.col("selectivity")).alias("_s"))
    away = F.abs(F.col("_t") - F.col("threshold"))
    straight, turned = F.abs(F.col("_s") - F.col("selectivity")), F.abs(1 - F.col("_s") - F.col("selectivity"))
    scale = F.greatest(F.abs("threshold"), F.abs("_t"))

    def cell(t: Column) -> Column:
        """Thresholds within the tolerance lie in the same or adjoining cells, whatever their size."""
        return F.floor(F.asinh(t * 1e6) / 2e-6)

    mine = runs.withColumn("_cell", cell(F.col("threshold")))
    near_by = ref.withColumn("_cell", F.explode(F.array(*(cell(F.col("_t")) + i for i in (-1, 0, 1)))))
    pairs = mine.join(near_by, ["dataset", "k", "_cell"]).where(away <= F.greatest(F.lit(1e-12), scale * 1e-6))
    pairs = pairs.withColumn("_far", F.when(turned <= near, turned).otherwise(straight)).withColumn("by_threshold_only", F.coalesce(F.col("_far") > near, F.lit(True)))
    order = [F.col("by_threshold_only"), F.when(F.col("by_threshold_only"), away).otherwise(F.col("_far")), F.col("ref_id")]
    return _one_per_key(pairs, ["run_id"], order).select("run_id", "ref_id", "by_threshold_only")


def with_native(generic: DataFrame, native: DataFrame, value: str = "seconds") -> DataFrame:
    """Generic runs beside the first native run of the same dataset, selectivity and depth, and the speed-up."""
    keys = ["dataset", "selectivity", "k"]
    first = _one_per_key(native, keys, [F.col("run_id")]).select(*keys, F.col(value).alias(f"native_{value}"))
    return generic.join(first, keys).withColumn("native_speedup", F.col(value) / F.nullif(F.col(f"native_{value}"), F.lit(0.0)))


def replace_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New runs, and the old ones of datasets that were not run again; columns missing on one side are null."""
    return old.join(new.select("dataset").distinct(), "dataset", "left_anti").unionByName(new, allowMissingColumns=True)


def ratios_to_raw(runs: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """(by, k, metric, value, raw_value, ratio_to_raw, reduction) of each run and metric; the raw run has k = 'raw'."""
    long = runs.select(*by, "k", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(*by, "k", "x.*")
    raw = long.where("k = 'raw'").select(*by, "metric", F.col("value").alias("raw_value"))
    zero = F.lit(0.0)
    return long.join(raw, [*by, "metric"]).withColumn("ratio_to_raw", F.col("value") / F.nullif(F.col("raw_value"), zero)).withColumn("reduction", F.col("raw_value") / F.nullif(F.col("value"), zero))


def break_even(runs: DataFrame) -> DataFrame:
    """Fused runs at half selectivity with their region and the inverse of the traffic ratio."""
    fused = runs.where("selectivity_label = 's50' AND kernel = 'fused'")
    region = F.when(F.col("k") >= 3, "fallback").otherwise("dispatch_window")
    return fused.withColumn("policy_region", region).withColumn("dram_reduction", 1 / F.nullif(F.col("dram_ratio"), F.lit(0.0)))


def layout_summary(segments: DataFrame) -> DataFrame:
    """One row about all segments: counts, plane counts and the stored bytes per row."""
    return segments.withColumn("_p", F.col("active").cast("long")).agg(
        F.count("*").alias("segments"), F.sum("row_count").alias("rows"), F.min("_p").alias("planes_min"), F.max("_p").alias("planes_max"), F.avg("_p").alias("planes_mean"),
        (F.sum(F.col("_p") * F.col("row_count")) / F.sum("row_count")).alias("bytes_per_row"),
    )
