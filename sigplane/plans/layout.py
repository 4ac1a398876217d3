"""The plane layout: a table of rows with one column per plane, and a table of segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.functions import codec

SEGMENT = 4096
#: Bytes of a row group: small ones let conditions on a segment's numbers leave out more.
ROW_GROUP = 16 << 20
#: What a row carries of its segment.
SEGMENT_NUMBERS = ("base", "fl", "vmin", "vmax")


@dataclass
class Planes:
    """``rows``: row_id, seg, v, the segment's base, fl, vmin and vmax, b0..; ``meta``: one row a segment.

    The segment's numbers lie beside its rows, where run-length encoding makes them nearly free: a scan needs no
    join, and conditions on them reach the file's row groups.
    """

    rows: DataFrame
    meta: DataFrame
    precision: int
    segment: int
    planes: int

    @property
    def f(self) -> int:
        return codec.FRACTION_BITS[self.precision]

    def with_meta(self, *columns: str) -> DataFrame:
        """Rows with their segment's numbers; only the columns asked for reach the scan."""
        return self.rows.select(*dict.fromkeys(["row_id", "seg", *SEGMENT_NUMBERS, *columns]))

    def first(self, k: int, *more: str) -> DataFrame:
        """Rows decoded from their first k planes: lo and hi bound the difference to the base."""
        k = min(k, self.planes)
        df = self.with_meta(*(f"b{p}" for p in range(k)), *more)
        lo = codec.from_planes(F.col("fl"), k)
        return df.withColumn("lo", lo).withColumn("hi", F.col("lo") + codec.tail(F.col("fl"), k))


def validate_input(raw: DataFrame) -> float:
    """The largest value; raises if one is null, negative or not finite."""
    v = F.col("v")
    found = raw.agg(F.count_if(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))).alias("bad"), F.max("v").alias("largest")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} values are null, negative or not finite")
    return found["largest"] or 0.0


def codes(raw: DataFrame, precision: int, segment: int) -> DataFrame:
    """(row_id, seg, v, code) of (row_id, v)."""
    return raw.select("row_id", F.floor(F.col("row_id") / segment).alias("seg"), "v", codec.code(F.col("v"), precision).alias("code"))


def segment_meta(coded: DataFrame, precision: int) -> DataFrame:
    """Everything a query needs to know of a segment; built with a partial aggregation."""
    f = codec.FRACTION_BITS[precision]
    agg = coded.groupBy("seg").agg(
        F.min("row_id").alias("row_offset"), F.count("*").alias("row_count"), F.min("code").alias("base"), F.max("code").alias("top"),
        F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.sum(F.col("code").cast("decimal(38,0)")).alias("code_sum"),
    )
    fl = codec.bit_width(F.col("top") - F.col("base"))
    return agg.withColumn("fl", fl).withColumn("active", codec.plane_count(F.col("fl"))).withColumn("integer_bits", F.greatest(F.col("fl") - f, F.lit(0)).cast("long")).drop("top")


def encode(raw: DataFrame, *, precision: int | None = 4, segment: int = SEGMENT, planes: int | None = None) -> Planes:
    """Planes of (row_id, v).  ``precision`` None takes the finest that fits the largest value.

    ``planes`` None finds the number of planes with one pass over the data; fewer than a segment needs are an
    error.  Values are checked in the same way: they must be finite and not negative, and fit the precision.
    """
    largest = validate_input(raw)
    precision = codec.resolve_precision(precision, largest)
    coded = codes(raw, precision, segment)
    meta = segment_meta(coded, precision)
    if planes is None or planes < codec.MAX_PLANES:
        needed = int(meta.agg(F.max("active")).first()[0] or 0)
        if needed > (codec.MAX_PLANES if planes is None else planes):
            raise ValueError(f"{needed} planes are needed")
        planes = needed if planes is None else planes
    joined = coded.join(meta.select("seg", *SEGMENT_NUMBERS), "seg")
    d = F.col("code") - F.col("base")
    rows = joined.select("row_id", "seg", "v", *SEGMENT_NUMBERS, *(codec.plane(d, F.col("fl"), p).alias(f"b{p}") for p in range(planes)))
    return Planes(rows, meta, precision, segment, planes)


def write(p: Planes, path: str, name: str, source: str = "") -> None:
    """Rows ranged by segment, so that a segment's rows lie together and footers prune; segments; manifest."""
    spark = p.rows.sparkSession
    p.meta.write.mode("overwrite").parquet(f"{path}/segment_meta")
    p.rows.repartitionByRange("seg").sortWithinPartitions("seg", "row_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/planes")
    m = spark.read.parquet(f"{path}/segment_meta")
    totals = m.agg(F.sum("row_count").alias("value_count"), F.count("*").alias("segment_count"), F.max("active").alias("max_plane_count"), F.min("active").alias("segment_plane_count_min"), F.max("active").alias("segment_plane_count_max"), (F.sum("code_sum") / F.lit(2.0**p.f)).cast("double").alias("exact_sum"))
    totals.select(F.lit("sigplane-1").alias("format"), F.lit(name).alias("dataset"), F.lit(source).alias("source_path"), F.lit(p.segment).cast("long").alias("segment_size"), F.lit(p.precision).alias("precision"), F.lit(p.planes).alias("planes"), "*").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> Planes:
    m = spark.read.json(f"{path}/manifest").first()
    return Planes(spark.read.parquet(f"{path}/planes"), spark.read.parquet(f"{path}/segment_meta"), int(m["precision"]), int(m["segment_size"]), int(m["planes"]))


def contract(p: Planes) -> DataFrame:
    """(check, violations): the invariants of an artifact; all counts are 0 for a sound one."""
    joined = p.rows.drop(*SEGMENT_NUMBERS).join(p.meta, "seg", "left")
    decoded = codec.from_planes(F.col("fl"), p.planes)
    value = (F.col("base") + decoded) / F.lit(2.0**p.f)
    row_checks = {
        "rows_without_segment": F.col("base").isNull(),
        "row_outside_segment": ~F.col("row_id").between(F.col("row_offset"), F.col("seg") * p.segment + p.segment - 1),
        "reconstruction_error": F.abs(F.col("v") - value) > codec.quantum(p.precision) + 2.0**-p.f,
        "plane_beyond_active": F.lit(False),
        "byte_out_of_range": F.lit(False),
    }
    for i in range(p.planes):
        row_checks["plane_beyond_active"] = row_checks["plane_beyond_active"] | (F.col(f"b{i}").isNotNull() & (F.col("active") <= i))
        row_checks["byte_out_of_range"] = row_checks["byte_out_of_range"] | F.coalesce(~F.col(f"b{i}").between(0, 255), F.lit(False))
    a = joined.agg(*(F.count_if(c).alias(n) for n, c in row_checks.items()))
    b = p.meta.agg(F.count_if(F.col("active") > codec.MAX_PLANES).alias("too_many_planes"), F.count_if(F.col("vmin") > F.col("vmax")).alias("bounds_crossed"), F.count_if(F.col("row_count") > p.segment).alias("segment_too_long"))
    wide = a.crossJoin(b)  # one row each
    return wide.unpivot([], wide.columns, "check", "violations")
