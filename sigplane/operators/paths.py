"""Filter and sum over replicated fixed planes, and what an answer costs in truth.

Planes are columns here: faults are joined as one row of masks for each row that is hit, copies exist only as
expressions, and vote, digest, filter and sum are one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigplane.operators.reliability import PLANES

PATHS = ("baseline", "digest", "vote", "vote_digest", "raw")


def columns(raw: DataFrame, scale: int = 100) -> DataFrame:
    """(row_id, v, b0..b7) of round(v * scale), half to even."""
    code = F.bround(F.col("v") * scale, 0).cast("long")
    return raw.select("row_id", "v", *(F.shiftright(code, 8 * (PLANES - 1 - p)).bitwiseAND(255).cast("long").alias(f"b{p}") for p in range(PLANES)))


def with_masks(wide: DataFrame, plan: DataFrame, replicas: list[int]) -> DataFrame:
    """``wide`` and a column m{plane}_{replica} of what each copy's faults flip; rows without a fault flip nothing."""
    pairs = [(p, r) for p in range(PLANES) for r in range(replicas[p])]
    masks = plan.groupBy("row_id").agg(*(F.bit_xor(F.when((F.col("plane") == p) & (F.col("replica") == r), F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(f"m{p}_{r}") for p, r in pairs))
    return wide.join(masks, "row_id", "left").na.fill(0, [f"m{p}_{r}" for p, r in pairs])


def copy(p: int, r: int) -> Column:
    return F.col(f"b{p}").bitwiseXOR(F.col(f"m{p}_{r}"))


def voted(p: int, replicas: list[int]) -> Column:
    """One copy as it is, of two the larger, of three or more the most frequent byte, the largest of a tie."""
    copies = [copy(p, r) for r in range(replicas[p])]
    if len(copies) == 1:
        return copies[0]
    if len(copies) == 2:
        return F.greatest(*copies)
    if len(copies) == 3:
        a, b, c = copies
        return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.greatest(a, b, c))
    each = F.array(*copies)
    score = F.transform(each, lambda x: F.size(F.filter(each, lambda y: y == x)) * 256 + x)
    return F.array_max(score) % 256


def eager(copies: list[Column]) -> Column:
    """Votes that read all copies: of two the first without a comparison, of five the middle of the sorted ones if three agree."""
    if len(copies) < 3:
        return copies[0]
    middle = F.get(F.sort_array(F.array(*copies)), F.lit(len(copies) // 2))
    agree = F.size(F.filter(F.array(*copies), lambda x: x == middle))
    return F.when(agree * 2 > len(copies), middle).otherwise(F.greatest(*copies))


def _prefix(get, k: int) -> Column:
    """The first k bytes at their places."""
    return sum((F.call_function("shiftleft", get(p), F.lit(8 * (PLANES - 1 - p))) for p in range(k)), F.lit(0).cast("long"))


def fused(wide: DataFrame, replicas: list[int], t: float, k: int, path: str, scale: int = 100) -> DataFrame:
    """One row (n, total, digest) of rows whose first k planes exceed the threshold's: baseline and digest read the first copy.

    ``wide`` has masks (:func:`with_masks`).  "raw" compares and sums the values, at the scale of the codes.  Places
    are whole up to 2^55, which fixed codes of values below 3.6e14 keep; a byte flipped above that is masked by the vote or shows in the digest.
    """
    if path == "raw":
        hit = F.col("v") > t
        return wide.agg(F.count_if(hit).alias("n"), F.sum(F.when(hit, (F.col("v") * scale).cast("decimal(38,6)"))).cast("double").alias("total"), F.lit(None).cast("long").alias("digest"))
    byte = (lambda p: voted(p, replicas)) if path.startswith("vote") else (lambda p: copy(p, 0))
    rows = wide.select(*(byte(p).alias(f"x{p}") for p in range(k)))
    cut = int(t * scale) >> 8 * (PLANES - k) << 8 * (PLANES - k)
    value = _prefix(lambda p: F.col(f"x{p}"), k)
    digest = (F.sum(sum((F.col(f"x{p}") for p in range(k)), F.lit(0))) % F.lit(1 << 32)).cast("long") if path.endswith("digest") else F.lit(None).cast("long")
    hit = value > cut
    return rows.agg(F.count_if(hit).alias("n"), F.sum(F.when(hit, value).cast("decimal(38,0)")).cast("double").alias("total"), digest.alias("digest"))


def all_paths(wide: DataFrame, replicas: list[int], t: float, k: int) -> DataFrame:
    """(path, n, total, digest) of every read path."""
    found = None
    for path in PATHS:
        one = fused(wide, replicas, t, k, path).select(F.lit(path).alias("path"), "n", "total", "digest")
        found = one if found is None else found.unionByName(one)
    return found


def three_answers(clean: DataFrame, faulted: DataFrame, replicas: list[int], t: float, ks: list[int]) -> DataFrame:
    """(k, truth, clean_k, faulted_k and their errors): the raw answer, that of k clean planes, and that of k faulted planes after the vote.

    Errors are relative beyond an answer of 1, absolute below.
    """
    found = None
    for k in ks:
        a = fused(clean, [1] * PLANES, t, k, "raw").select(F.col("total").alias("truth"))
        b = fused(clean, [1] * PLANES, t, k, "baseline").select(F.col("total").alias("clean_k"))
        c = fused(faulted, replicas, t, k, "vote").select(F.col("total").alias("faulted_k"))
        one = a.crossJoin(b).crossJoin(c).withColumn("k", F.lit(k).cast("long"))  # one row each
        found = one if found is None else found.unionByName(one)

    def error(to: str) -> Column:
        gap = F.abs(F.col("faulted_k") - F.col(to))
        return F.when(F.abs(to) > 1, gap / F.abs(to)).otherwise(gap)

    return found.select("k", "truth", "clean_k", "faulted_k", error("truth").alias("error_to_truth"), error("clean_k").alias("error_to_clean"))


def bounds(planes: DataFrame) -> DataFrame:
    """(plane, active, worst, aware): half widths of a plane's damage if any byte, or any byte that isn't zero, may be wrong."""
    w = F.pow(F.lit(256.0), F.lit(PLANES - 1) - F.col("plane"))
    a = planes.groupBy("plane").agg(F.count("*").alias("n"), F.count_if(F.col("byte") != 0).alias("active"))
    return a.select("plane", "active", (255.0 * w * F.col("n")).alias("worst"), (255.0 * w * F.col("active")).alias("aware"))


def damage(planes: DataFrame, delivered: DataFrame) -> DataFrame:
    """(clean, delivered, signed, absolute, normalised) of the encoded sums, exact in 38 digits."""
    w = F.pow(F.lit(256.0), F.lit(PLANES - 1) - F.col("plane")).cast("decimal(20,0)")
    total = lambda df, name: df.agg(F.sum((F.col("byte") * w).cast("decimal(38,0)")).alias(name))
    both = total(planes, "clean").crossJoin(total(delivered, "delivered"))  # one row each
    signed = F.col("delivered") - F.col("clean")
    return both.select("clean", "delivered", signed.alias("signed"), F.abs(signed).alias("absolute"), (F.abs(signed).cast("double") / F.greatest(F.abs("clean").cast("double"), F.lit(1.0))).alias("normalised"))
