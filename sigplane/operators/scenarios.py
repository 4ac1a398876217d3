"""Structured faults on replicated planes: scenarios, controls, diversity of placement, and what a vote makes of them.

Places of faults follow from the numbers of scenario and seed by integer arithmetic, so a plan is a DataFrame
made where it is used and any engine can make the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.operators.reliability import PLANES, net_masks, weight

# Copies of each plane by policy.
POLICIES = {
    "naive_same_region_replication_r3": [3, 1, 1, 1, 1, 1, 1, 1],
    "logical_striping_diversity_r3": [3, 1, 1, 1, 1, 1, 1, 1],
    "graded_nmr_B11": [3, 2, 1, 1, 1, 1, 1, 1],
    "uniformish_B11": [2, 1, 2, 1, 2, 1, 1, 1],
    "certified_degradation_fallback": [1, 1, 1, 1, 1, 1, 1, 1],
}
# Scenario, plane, bytes, stride of the bytes, mask, copies that are hit.
SCENARIOS = [
    (0, "single_domain_burst", 0, 4, 1, 255, "domain"),
    (1, "regional_multi_byte", 0, 64, 1, 255, "domain"),
    (2, "column_like_repeated_offset", 0, 8, 4096, 255, "domain"),
    (3, "plane_localized_msb", 0, 8, 1, 255, "one"),
    (4, "plane_localized_lsb", 7, 8, 1, 255, "one"),
    (5, "same_fault_all_correlated_control", 0, 4, 1, 255, "all"),
    (6, "mixed_independent_plus_correlated", 0, 4, 1, 255, "all"),
    (6, "mixed_independent_plus_correlated", 7, 4, 1, 85, "one"),
]
# Control, plane (-1: any), copies that are hit at most.
CONTROLS = [
    (10, "single_replica_independent_plane0", 0, 1),
    (11, "single_replica_independent_plane1", 1, 1),
    (12, "single_replica_independent_random_plane", -1, 1),
    (13, "same_fault_all_replicas_plane0", 0, PLANES),
    (14, "uniformish_r0_2_non_majority_fallback", 0, 2),
    (15, "clean_no_fault", 0, 0),
]
#: Policies whose copies lie in one region, so that a fault of a region hits them all.
ONE_REGION = ("naive_same_region_replication_r3",)


def policies(spark: SparkSession) -> DataFrame:
    """(policy, plane, replicas)."""
    return spark.createDataFrame([(n, p, r) for n, rs in POLICIES.items() for p, r in enumerate(rs)], "policy string, plane long, replicas long")


def _draw(x: Column, salt: int, size: Column) -> Column:
    """A number below ``size`` that follows from x; both are small, so nothing overflows."""
    return F.pmod((x + salt) * 48271 % 2147483647, size)


def scenario_plan(spark: SparkSession, rows: int, seeds: list[int], controls: bool = False) -> DataFrame:
    """(policy, scenario, seed, plane, replica, row_id, mask) of every scenario, or control, under every policy."""
    if controls:
        some = [(i, n, p, 1, 1, 255, most) for i, n, p, most in CONTROLS]
        known = spark.createDataFrame(some, "id long, scenario string, plane long, length long, stride long, mask long, most long").withColumn("hits", F.lit("first"))
    else:
        known = spark.createDataFrame(SCENARIOS, "id long, scenario string, plane long, length long, stride long, mask long, hits string").withColumn("most", F.lit(PLANES).cast("long"))
    known = known.crossJoin(spark.createDataFrame([(s,) for s in seeds], "seed long"))  # a handful of rows each
    x = F.col("seed") * 1000 + F.col("id")
    known = known.withColumn("plane", F.when(F.col("plane") < 0, _draw(x, 5, F.lit(PLANES))).otherwise(F.col("plane")))
    places = F.when(F.col("stride") == 1, F.greatest(F.lit(rows) - F.col("length") + 1, F.lit(1))).otherwise(F.least(F.col("stride"), F.lit(rows)))
    known = known.withColumn("low", _draw(x + F.col("plane") * 77, 11, places)).join(F.broadcast(policies(spark)), "plane")
    one = _draw(x + F.col("plane") * 77, 23, F.col("replicas"))
    hit = (
        F.when(F.col("hits") == "one", F.array(one)).when((F.col("hits") == "domain") & ~F.col("policy").isin(*ONE_REGION), F.array(one))
        .when(F.least("replicas", "most") > 0, F.sequence(F.lit(0).cast("long"), F.least("replicas", "most") - 1)).otherwise(F.array().cast("array<bigint>"))
    )
    each = known.withColumn("replica", F.explode(hit)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    return each.select("policy", "scenario", "seed", "plane", "replica", (F.col("low") + F.col("i") * F.col("stride")).alias("row_id"), "mask").where(F.col("row_id") < rows)


def plan_summary(plan: DataFrame, *by: str) -> DataFrame:
    """Entries, planes and copies hit, and the largest share of a plane's copies that is lost at once."""
    counts = policies(plan.sparkSession)
    per = plan.groupBy(*by, "plane").agg(F.count("*").alias("entries"), F.count_distinct("replica").alias("hit")).join(F.broadcast(counts), ["policy", "plane"])
    return per.groupBy(*by).agg(
        F.sum("entries").alias("entries"), F.count("*").alias("planes_hit"), F.sum("hit").alias("replicas_hit"), F.bool_or(F.col("plane") == 0).alias("high_significance_hit"),
        F.max(F.col("hit") / F.col("replicas")).alias("loss_correlation"),
    )


def outcomes(plan: DataFrame, planes: DataFrame, rows: int) -> DataFrame:
    """(policy, scenario, seed, detected, bound_width, damage, contains_truth, outcome) of each plan.

    Replicate, inject, vote (the larger of a tie), compare each plane's byte sum with the clean one, and widen
    the answer by the planes that differ.  Only bytes that are hit are replicated: all others are the clean ones.
    """
    key = ["policy", "scenario", "seed"]
    masks = plan.groupBy(*key, "plane", "replica", "row_id").agg(F.bit_xor("mask").alias("mask"))
    counts = policies(plan.sparkSession).withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), F.col("replicas") - 1)))
    hit = masks.select(*key, "plane", "row_id").distinct().join(planes, ["plane", "row_id"])
    copies = hit.join(F.broadcast(counts), ["policy", "plane"]).join(masks, [*key, "plane", "replica", "row_id"], "left")
    copies = copies.withColumn("now", F.col("byte").bitwiseXOR(F.coalesce("mask", F.lit(0).cast("long"))))
    seen = copies.groupBy(*key, "plane", "row_id", "byte", "now").agg(F.count("*").alias("n"))
    voted = seen.groupBy(*key, "plane", "row_id", "byte").agg(F.max_by("now", F.struct("n", "now")).alias("voted"))
    off = F.sum(F.col("voted") - F.col("byte"))
    per_plane = voted.groupBy(*key, "plane").agg((F.pmod(off, F.lit(1 << 32)) != 0).alias("differs"), (off * weight(F.col("plane"))).cast("decimal(38,0)").alias("off"))
    width = F.sum(F.when(F.col("differs"), F.lit(255 * rows) * weight(F.col("plane"))).otherwise(0)).cast("decimal(38,0)")
    out = per_plane.groupBy(*key).agg(F.bool_or("differs").alias("detected"), width.alias("bound_width"), F.sum("off").cast("decimal(38,0)").alias("damage"))
    out = out.withColumn("contains_truth", ~F.col("detected") | (F.abs("damage") * 2 <= F.col("bound_width")))
    return out.withColumn("outcome", F.when(~F.col("detected"), "vote_recovered").when(F.col("contains_truth"), "bounded_degraded").otherwise("cert_bound_failure"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: whether the runs support the model; a failed bound, silent error or false recovery doesn't, nor do under three families."""
    a = found.agg(
        F.count_distinct("scenario").alias("families"), F.count("*").alias("runs"), F.count_if(F.col("outcome") == "cert_bound_failure").alias("bound_failures"),
        F.count_if(~F.col("contains_truth")).alias("truth_failures"), F.count_if(~F.col("detected") & (F.col("damage") != 0)).alias("silent_wrong"),
    )
    bad = (F.col("families") < 3) | (F.col("bound_failures") > 0) | (F.col("truth_failures") > 0) | (F.col("silent_wrong") > 0)
    return a.withColumn("verdict", F.when(bad, "NEEDS_FIXES").otherwise("SUPPORTED"))


#: Where copies lie: (region, stage) of each by diversity mode.
DIVERSITY = {"D0": (0, 0), "D1": (1, 0), "D2": (0, 1), "D3": (1, 1)}


def placements(spark: SparkSession, copies: int = 3) -> DataFrame:
    """(mode, replica, region, stage): each copy in a region, or a stage, of its own where the mode says so."""
    return spark.createDataFrame([(m, r, a * r, b * r) for m, (a, b) in DIVERSITY.items() for r in range(copies)], "mode string, replica long, region long, stage long")


def diversity_faults(spark: SparkSession, plane_bytes: int, rates: list[float], seeds: list[int]) -> DataFrame:
    """(fault, mode, rate, seed, replica, hit): copies that a cluster of bytes, or a fault of a stage, reaches.

    A cluster is a run of ceil(rate * bytes) bytes; region i is the i-th third of the bytes.  A temporal fault
    hits one of three stages.
    """
    cells = spark.createDataFrame([(f, float(r), s) for f in ("cluster", "temporal") for r in rates for s in seeds], "fault string, rate double, seed long")
    width = F.greatest(F.ceil(F.col("rate") * plane_bytes), F.lit(1))
    low = _draw(F.col("seed"), 31, F.lit(plane_bytes) - width + 1)
    third = plane_bytes // 3
    touches = (low < (F.col("region") + 1) * third) & (low + width > F.col("region") * third)
    hit = F.when(F.col("fault") == "cluster", touches).otherwise(F.col("stage") == _draw(F.col("seed"), 41, F.lit(3)))
    return cells.crossJoin(placements(spark)).select("fault", "mode", "rate", "seed", "replica", hit.alias("hit"))  # small frames both


def skip_faults(rows: DataFrame, rate: float, replicas: int, seed: int) -> DataFrame:
    """(replica, row_id) of bytes hit independently with the rate in each copy: what geometric skips give, without an order."""
    x = rows.select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicas - 1).cast("long"))).alias("replica"))
    draw = F.pmod((F.col("row_id") * 31 + F.col("replica") * 17 + seed) * 48271 % 2147483647 * 69621 % 2147483647, F.lit(1_000_000))
    return x.where(draw < int(rate * 1_000_000)).select("replica", "row_id")


def net_plan(plan: DataFrame) -> DataFrame:
    """The masks of one run's plan (plane, replica, row_id, mask) after cancellation."""
    return net_masks(plan).where("mask <> 0")
