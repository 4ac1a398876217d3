"""Files of other tools: the container of encoded segments, plane files, segment tables as CSV, results as JSON or CSV.

A container or plane file is one stream in row order.  Segments are packed on the executors; the driver only passes
their bytes on, one segment at a time.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.functions import codec
from sigplane.plans.layout import Planes
from sigplane.sources import raw as raw_source

# The container's first bytes, its header (values, segment size, segments), a segment's (values, precision,
# fractional bits, integer bits, fixed length, bytes of the base, planes), all little-endian; columns of a segment table.
MAGIC = b"BUFF64\x00\x03"
HEADER, SEGMENT_HEADER = "<QQQ", "<QIIIIII"
META_COLUMNS = ("segment_index", "row_offset", "row_count", "active_plane_count", "fractional_bits", "integer_offset_bits", "integer_base_hex", "segment_base")
META_OPTIONAL = ("raw_fractional_bits", "precision_cap_bits", "effective_fractional_bits")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors share; a local one only where one machine runs all."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sigplane-')}"
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{context.applicationId}-{name}"


class _Sink:
    """A file of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def __enter__(self):
        return self

    def write(self, data: bytes) -> None:
        self.out.write(bytearray(data))

    def __exit__(self, *_):
        self.out.close()


def _packed(p: Planes) -> DataFrame:
    """(seg, row_count, fl, integer_bits, base, active, planes): the bytes of each plane of each segment, at most a segment's rows a group."""
    names = [f"b{i}" for i in range(p.planes)]
    rows = p.rows.groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("row_id", *names))).alias("x"))

    def plane(name: str):
        return F.unhex(F.array_join(F.transform("x", lambda r: F.lpad(F.hex(F.coalesce(r[name], F.lit(0))), 2, "0")), ""))

    planes = [plane(name) for name in names]
    return rows.select("seg", F.array(*planes).alias("planes")).join(p.meta.select("seg", "row_count", "fl", "integer_bits", "base", "active"), "seg")


def write_container(p: Planes, path: str) -> None:
    spark = p.rows.sparkSession
    total = p.meta.agg(F.sum("row_count").alias("n"), F.count("*").alias("s")).first()
    with _Sink(spark, path) as out:
        out.write(MAGIC + struct.pack(HEADER, total["n"] or 0, p.segment, total["s"]))
        for r in _packed(p).orderBy("seg").toLocalIterator():
            out.write(struct.pack(SEGMENT_HEADER, r["row_count"], p.precision, p.f, r["integer_bits"], r["fl"], 8, r["active"]) + struct.pack("<q", r["base"]))
            for plane in r["planes"][: r["active"]]:
                out.write(bytes(plane))


def _checked(data: bytes) -> tuple[int, int, int]:
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + struct.calcsize(HEADER):
        raise ValueError("not a container of encoded segments")
    return struct.unpack_from(HEADER, data, len(MAGIC))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(total_values, segment_size, segment_count) of each container."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_checked(bytes(c)) for c in batch["content"]], columns=["total_values", "segment_size", "segment_count"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "total_values long, segment_size long, segment_count long")


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """(seg, precision, f, fl, base, row_id, code) of every value of a container; raises if values are missing."""
    head = struct.calcsize(SEGMENT_HEADER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = bytes(content)
                total, _, count = _checked(data)
                at, row = len(MAGIC) + struct.calcsize(HEADER), 0
                for seg in range(count):
                    n, precision, f, _, fl, width, planes = struct.unpack_from(SEGMENT_HEADER, data, at)
                    at += head
                    base = int.from_bytes(data[at : at + width], "little", signed=True)
                    at += width
                    delta = np.zeros(n, np.int64)
                    for i in range(planes):
                        byte = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
                        at += n
                        delta = delta << min(8, fl - 8 * i) | byte
                    yield pd.DataFrame({"seg": seg, "precision": precision, "f": f, "fl": fl, "base": base, "row_id": np.arange(row, row + n), "code": base + delta})
                    row += n
                if row != total:
                    raise ValueError(f"{row} of {total} values")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "seg long, precision long, f long, fl long, base long, row_id long, code long")


def write_plane_files(p: Planes, folder: str) -> None:
    """One file a plane, a byte a row, zeros where a segment lacks the plane."""
    spark = p.rows.sparkSession
    sinks = [_Sink(spark, f"{folder}/plane_{i:03d}.bin") for i in range(p.planes)]
    for r in _packed(p).orderBy("seg").toLocalIterator():
        for sink, plane in zip(sinks, r["planes"], strict=True):
            sink.write(bytes(plane))
    for sink in sinks:
        sink.__exit__()


def read_plane_files(spark: SparkSession, folder: str, planes: int) -> DataFrame:
    """(row_id, b0..); files of different lengths are an error."""
    every = raw_source.read_binary(spark, f"{folder}/plane_*.bin", "u1").withColumn("plane", F.regexp_extract("file", r"plane_(\d+)\.bin", 1).cast("int"))
    wide = every.groupBy("row_id").agg(F.count("*").alias("files"), *(F.max(F.when(F.col("plane") == i, F.col("v").cast("long"))).alias(f"b{i}") for i in range(planes)))
    whole = F.when(F.col("files") == planes, F.col("row_id")).otherwise(F.raise_error(F.lit("plane files differ in length")).cast("long"))
    return wide.select(whole.alias("row_id"), *(f"b{i}" for i in range(planes)))


def segment_table(p: Planes) -> DataFrame:
    """The segments as other tools list them: the base in hexadecimal, and the place value of each plane."""
    f = p.f
    basis = [F.when(F.col("fl") > 8 * i, F.pow(F.lit(2.0), F.greatest(F.col("fl") - 8 * (i + 1), F.lit(0)) - f)).otherwise(0.0).alias(f"plane_basis_{i}") for i in range(p.planes)]
    bits = [F.lit(f).cast("long").alias(c) for c in META_OPTIONAL]
    return p.meta.select(
        F.col("seg").alias("segment_index"), "row_offset", "row_count", F.col("active").alias("active_plane_count"), F.lit(f).cast("long").alias("fractional_bits"), F.col("integer_bits").alias("integer_offset_bits"),
        F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("base"), 16, "0"))).alias("integer_base_hex"), (F.col("base") / F.lit(2.0**f)).alias("segment_base"), *bits, *basis,
    )


def write_segment_csv(p: Planes, path: str) -> None:
    segment_table(p).repartitionByRange("segment_index").sortWithinPartitions("segment_index").write.mode("overwrite").option("header", True).csv(path)


def read_segment_csv(spark: SparkSession, path: str) -> DataFrame:
    """The segment table; columns that may be absent follow the fractional bits, a missing other one is an error, as are gaps between segments."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in META_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    whole = [c for c in (*META_COLUMNS, *META_OPTIONAL) if c not in ("integer_base_hex", "segment_base")]
    for c in META_OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.col("fractional_bits"))
    basis = [c for c in df.columns if c.startswith("plane_basis_")]
    df = df.select(*(F.col(c).cast("long").alias(c) for c in whole), "integer_base_hex", F.col("segment_base").cast("double").alias("segment_base"), *(F.col(c).cast("double").alias(c) for c in basis))
    after = df.select((F.col("segment_index") + 1).alias("segment_index"), (F.col("row_offset") + F.col("row_count")).alias("begin"))
    gaps = df.join(after, "segment_index", "left").where(F.coalesce("begin", F.lit(0)) != F.col("row_offset")).count()
    if gaps:
        raise ValueError(f"{gaps} segments do not follow the one before")
    return df


def base_of_hex(text):
    """The base that the hexadecimal digits hold."""
    return F.conv(F.substring(text, 3, 16), 16, 10).cast("long")


def append_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """Rows of results beside those written before, as JSON lines or CSV with a header."""
    writer = results.write.mode("append")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def precision_probe(raw: DataFrame, segment: int) -> DataFrame:
    """(precision, planes, bytes_per_row, fits, chosen) of every precision in one pass; chosen is the finest with fewer than 8 planes and bytes."""
    each = []
    coded = raw.select(F.floor(F.col("row_id") / segment).alias("seg"), "v")
    for p, f in codec.FRACTION_BITS.items():
        code = F.expr(f"try_cast(floor(v * {2.0**f!r}D) AS BIGINT)")
        each += [(F.max(code) - F.min(code)).alias(f"span{p}")]
    segments = coded.groupBy("seg").agg(F.count("*").alias("n"), F.max("v").alias("largest"), *each)
    rows = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("precision"), F.col(f"span{p}").alias("span"), (F.col("largest") * 2.0**f <= float(codec.CODE_MAX)).alias("fits")) for p, f in codec.FRACTION_BITS.items())))
    long = segments.select("n", rows.alias("x")).select("n", "x.*").withColumn("planes", codec.plane_count(codec.bit_width(F.col("span"))))
    found = long.groupBy("precision").agg(F.max("planes").alias("planes"), (F.sum(F.col("planes") * F.col("n")) / F.sum("n")).alias("bytes_per_row"), F.bool_and("fits").alias("fits"))
    good = found.where(F.col("fits") & (F.col("planes") < 8) & (F.col("bytes_per_row") < 8)).agg(F.max("precision").alias("best"))
    return found.crossJoin(good).withColumn("chosen", F.col("precision").eqNullSafe(F.col("best"))).drop("best")  # one row
