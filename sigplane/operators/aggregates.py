"""Sums, extrema, means and variances on the first k planes, with bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigplane.functions import codec
from sigplane.operators.predicate import ALL_Q, Q, segment_modes, states, threshold
from sigplane.plans.layout import Planes


def exact(x: Column) -> Column:
    """Sum of integer codes: the same in any order of the rows."""
    return F.sum(x.cast("decimal(38,0)"))


def progressive_sum(p: Planes, k: int) -> DataFrame:
    """Code sums of the lower and upper bounds; divided by 2^f they bound the encoded sum."""
    a = p.first(k).agg(exact(F.col("base") + F.col("lo")).alias("lower"), exact(F.col("base") + F.col("hi")).alias("upper"), F.count("*").alias("n"))
    scale = F.lit(2.0**p.f)
    return a.select("n", F.col("lower").cast("long").alias("lower_code"), F.col("upper").cast("long").alias("upper_code"), (F.col("lower").cast("double") / scale).alias("sum_lower"), (F.col("upper").cast("double") / scale).alias("sum_upper"), (F.col("lower").cast("double") / scale / F.col("n")).alias("avg_lower"))


def extrema(p: Planes, k: int) -> DataFrame:
    lo, hi = F.col("base") + F.col("lo"), F.col("base") + F.col("hi")
    return p.first(k).agg(F.min(lo).alias("min_lower"), F.min(hi).alias("min_upper"), F.max(lo).alias("max_lower"), F.max(hi).alias("max_upper"))


def extremum_candidates(p: Planes, k: int, scope: str = "segment") -> DataFrame:
    """Rows that may hold the least or greatest value, of their segment or of all."""
    df = p.first(k).select("seg", (F.col("base") + F.col("lo")).alias("l"), (F.col("base") + F.col("hi")).alias("h"))
    if scope == "segment":
        bounds = df.groupBy("seg").agg(F.min("h").alias("least"), F.max("l").alias("most"))
        df = df.join(bounds, "seg")
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.min("h").alias("least"), F.max("l").alias("most"))))  # one row
    return df.agg(F.count_if(F.col("l") <= F.col("least")).alias("min_candidates"), F.count_if(F.col("h") >= F.col("most")).alias("max_candidates"))


def analytic_bounds(p: Planes, k: int) -> DataFrame:
    """Bounds of SUM, AVG, MIN/MAX and VAR from the segments' bounds alone."""
    f = p.f
    m = p.meta.select("*", codec.value_bound(F.col("fl"), k, p.precision).alias("b"), ((F.col("base") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("fl").cast("int")) - 1) / F.lit(2.0**f)).alias("largest"))
    a = m.agg(F.sum(F.col("row_count") * F.col("b")).alias("sum_bound"), F.sum("row_count").alias("n"), F.max("b").alias("extremum_bound"), F.sum(2 * F.col("row_count") * F.col("largest") * F.col("b")).alias("s"), (F.sum("code_sum").cast("double") / F.lit(2.0**f)).alias("total"))
    delta = F.col("sum_bound") / F.col("n")
    return a.select("sum_bound", delta.alias("avg_bound"), "extremum_bound", (F.col("s") / F.col("n") + (2 * F.col("total") / F.col("n") + delta) * delta).alias("var_bound"))


def moments(p: Planes, k: int) -> DataFrame:
    """Mean and population variance of the decoded values, from exact integer sums of codes."""
    c = F.col("base") + F.col("lo")
    a = p.first(k).agg(F.count("*").alias("n"), exact(c).alias("s"), F.sum(c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).alias("ss"))
    scale = F.lit(2.0**p.f)
    mean = F.col("s").cast("double") / F.col("n") / scale
    return a.select("n", mean.alias("avg"), (F.col("ss").cast("double") / F.col("n") / scale / scale - mean * mean).alias("var"))


def errors(p: Planes) -> DataFrame:
    """(k, exact, approx, abs_error, rel_error) of the sum for each k, in one scan."""
    df = p.first(p.planes)
    sums = []
    for k in range(1, p.planes + 1):
        om = codec.omitted(F.col("fl"), k)
        sums.append(exact(F.col("base") + F.call_function("shiftleft", F.call_function("shiftright", F.col("lo"), om), om)).alias(f"s{k}"))
    # The exact sum is that of the codes, kept with the segments, whatever planes are there.
    wide, scale = df.agg(*sums).crossJoin(p.meta.agg(F.sum("code_sum").alias("full"))), F.lit(2.0**p.f)  # one row each
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), (F.col("full").cast("double") / scale).alias("exact"), (F.col(f"s{k}").cast("double") / scale).alias("approx")) for k in range(1, p.planes + 1))))
    gap = F.abs(F.col("exact") - F.col("approx"))
    return wide.select(each.alias("x")).select("x.*").select("k", "exact", "approx", gap.alias("abs_error"), (gap / F.greatest(F.abs("exact"), F.lit(1e-30))).alias("rel_error"))


def kstar(p: Planes, eps: list[float], column: str = "rel_error") -> DataFrame:
    """The least k within each error; null where none is."""
    asked = p.rows.sparkSession.createDataFrame([(float(e),) for e in eps], "eps double")
    return errors(p).crossJoin(F.broadcast(asked)).groupBy("eps").agg(F.min(F.when(F.col(column) <= F.col("eps"), F.col("k"))).alias("kstar"))  # a handful of rows each


def choose_k(p: Planes, eps: float, most: int = 3) -> int | None:
    """Planes to read for a relative error, None for the raw column: beyond ``most`` planes raw is faster."""
    k = kstar(p, [eps]).first()["kstar"]
    return None if k is None or k > most else int(k)


def filter_sum(p: Planes, t: float, k: int) -> DataFrame:
    """Fused filter and sum: segments decided by their bounds are answered by metadata, the rest by k planes.

    ``count_q`` and ``sum_code`` keep the qualified rows only; the interval adds what is unresolved.
    """
    modes = segment_modes(p, t)
    known = modes.where(F.col("mode") == ALL_Q).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n1"), F.coalesce(F.sum("code_sum"), F.lit(0)).alias("c1"))
    # Plain conditions on the segment's numbers, so that they reach the scan.
    df = p.first(k).where((F.col("vmin") <= float(t)) & (F.col("vmax") > float(t))).withColumn("t_code", threshold(p, t))
    q, maybe = F.col("lo") > F.col("t_code"), F.col("hi") > F.col("t_code")
    low, high = F.col("base") + F.col("lo"), F.col("base") + F.col("hi")
    scan = df.agg(F.count_if(q).alias("n2"), F.count_if(maybe & ~q).alias("u"), F.coalesce(exact(F.when(q, low)), F.lit(0)).alias("c2"), F.coalesce(exact(F.when(maybe, high)), F.lit(0)).alias("h2"))
    both = known.crossJoin(scan)  # one row each
    return both.select((F.col("n1") + F.col("n2")).alias("count_q"), "u", (F.col("c1") + F.col("c2")).cast("long").alias("sum_code"), (F.col("c1") + F.col("h2")).cast("long").alias("sum_code_upper"))


def deferred_gather(p: Planes, raw: DataFrame, t: float, k: int) -> DataFrame:
    """Qualified ids first, then their raw values: count and sum of raw."""
    ids = states(p, t, k).where(F.col("state") == Q).select("row_id")
    return ids.join(raw, "row_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("decimal(28,8)")).cast("double"), 4).alias("raw_sum"))


def plane_statistics(p: Planes) -> DataFrame:
    """(plane, n, distinct, zeros, least, most, entropy) of the bytes of each plane."""
    every = p.rows.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("plane"), F.col(f"b{i}").cast("long").alias("byte")) for i in range(p.planes)))).alias("x")).select("x.*").where("byte IS NOT NULL")
    counts = every.groupBy("plane", "byte").agg(F.count("*").alias("c"))
    counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy("plane")))  # at most 256 bytes a plane
    share = F.col("c") / F.col("n")
    return counts.groupBy("plane").agg(F.sum("c").alias("n"), F.count("*").alias("distinct_bytes"), F.sum(F.when(F.col("byte") == 0, F.col("c")).otherwise(0)).alias("zeros"), F.min("byte").alias("least"), F.max("byte").alias("most"), F.round(F.sum(-share * F.log2(share)), 6).alias("entropy"))


def plane_histogram(p: Planes) -> DataFrame:
    """(active, segments, first_segment) by number of planes; more than eight would be told by its first segment."""
    return p.meta.groupBy("active").agg(F.count("*").alias("segments"), F.min("seg").alias("first_segment"))

