"""``v > t`` on the first k planes: qualified, disqualified or unresolved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigplane.functions import codec
from sigplane.plans.layout import Planes

D, Q, U = 0, 1, 2
MIXED, ALL_Q, ALL_D = 0, 1, 2


def threshold(p: Planes, t: Column | float) -> Column:
    """The threshold's code within the segment."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.floor(t * F.lit(2.0**p.f)).cast("long") - F.col("base")


def segment_modes(p: Planes, t: float) -> DataFrame:
    """Zone map: segments that a threshold leaves undecided, and those decided by their bounds alone."""
    mode = F.when(F.lit(float(t)) < F.col("vmin"), ALL_Q).when(F.lit(float(t)) >= F.col("vmax"), ALL_D).otherwise(MIXED)
    return p.meta.select("*", mode.cast("long").alias("mode"), threshold(p, t).alias("t_code"))


def states(p: Planes, t: float, k: int, *more: str, domain: str = "encoded") -> DataFrame:
    """Rows with ``state``; ``domain`` "encoded" compares codes, "value" bounds the raw value."""
    df = p.first(k, *more)
    if domain == "encoded":
        T = threshold(p, t)
        state = F.when(F.col("lo") > T, Q).when(F.col("hi") <= T, D).otherwise(U)
    else:
        df = df.withColumn("x", (F.col("base") + F.col("lo")) / F.lit(2.0**p.f)).withColumn("bound", codec.value_bound(F.col("fl"), k, p.precision))
        state = F.when(F.col("x") > t, Q).when(F.col("x") + F.col("bound") <= t, D).otherwise(U)
    return df.withColumn("state", state)


def count_interval(p: Planes, t: float, k: int, domain: str = "encoded") -> DataFrame:
    """q, d, u; the count lies in [q, q + u]."""
    s = F.col("state")
    a = states(p, t, k, domain=domain).agg(F.count_if(s == Q).alias("q"), F.count_if(s == D).alias("d"), F.count_if(s == U).alias("u"))
    return a.select("q", "d", "u", F.col("q").alias("count_lower"), (F.col("q") + F.col("u")).alias("count_upper"))


def batch_counts(p: Planes, requests: list[tuple[int, float, int]]) -> DataFrame:
    """Intervals of many requests (id, threshold, k) in one scan; the requests are a handful of literals."""
    df = p.first(p.planes)
    ks = sorted({k for _, _, k in requests})
    for k in ks:
        om = codec.omitted(F.col("fl"), k)
        cut = F.call_function("shiftleft", F.call_function("shiftright", F.col("lo"), om), om)
        df = df.withColumn(f"lo{k}", cut).withColumn(f"hi{k}", cut + codec.tail(F.col("fl"), k))
    aggs = []
    for r, t, k in requests:
        T = threshold(p, t)
        aggs += [F.count_if(F.col(f"lo{k}") > T).alias(f"q{r}"), F.count_if(F.col(f"hi{k}") <= T).alias(f"d{r}")]
    wide = df.agg(F.count("*").alias("n"), *aggs)
    out = F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("request"), F.lit(float(t)).alias("threshold"), F.lit(k).cast("long").alias("k"), F.col(f"q{r}").alias("q"), F.col(f"d{r}").alias("d"), (F.col("n") - F.col(f"q{r}") - F.col(f"d{r}")).alias("u")) for r, t, k in requests)))
    return wide.select(out.alias("x")).select("x.*")


def survival(p: Planes, t: float) -> DataFrame:
    """Rows resolved in each round, reading one plane more a round: (round, resolved_q, resolved_d)."""
    df = p.first(p.planes)
    T = threshold(p, t)
    rounds = F.lit(p.planes + 1)
    for k in range(p.planes, 0, -1):
        om = codec.omitted(F.col("fl"), k)
        rounds = F.when(F.call_function("shiftright", F.col("lo"), om) != F.call_function("shiftright", T, om), F.lit(k)).otherwise(rounds)
    df = df.withColumn("round", rounds.cast("long"))
    return df.groupBy("round").agg(F.count_if(F.col("lo") > T).alias("resolved_q"), F.count_if(F.col("lo") <= T).alias("resolved_d"))


def refine_direct(p: Planes, t: float, k: int) -> DataFrame:
    """Unresolved rows tested on the raw value in the same scan."""
    s = F.col("state")
    a = states(p, t, k, "v").agg(F.count_if(s == Q).alias("q"), F.count_if(s == U).alias("u"), F.count_if((s == U) & (F.col("v") > t)).alias("hits"))
    return a.withColumn("refined_count", F.col("q") + F.col("hits"))


def refine_compact(p: Planes, raw: DataFrame, t: float, k: int, domain: str = "value") -> DataFrame:
    """Only the ids of unresolved rows are joined to the raw values; in the value domain the count is exact."""
    s = states(p, t, k, domain=domain)
    hits = s.where(F.col("state") == U).select("row_id").join(raw, "row_id").agg(F.count_if(F.col("v") > t).alias("hits"), F.count("*").alias("u"))
    return s.agg(F.count_if(F.col("state") == Q).alias("q")).crossJoin(hits).withColumn("refined_count", F.col("q") + F.col("hits"))  # one row each
