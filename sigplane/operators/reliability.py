"""Replicated planes: policies, faults, votes, digests, bounds and outcomes.

A plane table here is long: (plane, row_id, byte).  Replicas are rows too, so a policy, a fault plan and a
vote are joins and aggregations on (plane, row_id), which pre-aggregate and split like any others.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLANES = 8
UNIT = 4096
EXTRAS = 2


def _fixed_code(scale: int) -> Column:
    return F.bround(F.col("v") * scale, 0).cast("long")


def fixed_codes(raw: DataFrame, scale: int = 100) -> DataFrame:
    """(row_id, code): round(v * scale), half to even."""
    return raw.select("row_id", _fixed_code(scale).alias("code"))


def fixed_planes(raw: DataFrame, scale: int = 100) -> DataFrame:
    """(plane, row_id, byte) of round(v * scale), half to even, as 8 bytes."""
    code = _fixed_code(scale)
    each = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("plane"), F.shiftright(code, 8 * (PLANES - 1 - p)).bitwiseAND(255).cast("long").alias("byte")) for p in range(PLANES))))
    return raw.select("row_id", each.alias("x")).select("x.plane", "row_id", "x.byte")


def weight(plane: Column) -> Column:
    """Place value of a plane's bytes."""
    return F.pow(F.lit(256.0), F.lit(PLANES - 1) - plane).cast("decimal(20,0)")


def uniform_policy(budget: int) -> list[int]:
    """Extra replicas of each plane, spread evenly, what is left to the first."""
    return [budget // PLANES + (p < budget % PLANES) for p in range(PLANES)]


def graded_policy(budget: int) -> list[int]:
    """Extra replicas, the most significant plane filled first."""
    out = []
    for _ in range(PLANES):
        out.append(min(EXTRAS, budget))
        budget -= out[-1]
    return out


def catalogue() -> list[tuple[str, str, int, list[int]]]:
    """The 20 policies: three uniform and graded ones of 0 to 16 extras."""
    uniform = [(f"uniform_r{r + 1}", "uniform", 8 * r, uniform_policy(8 * r)) for r in range(3)]
    return uniform + [(f"graded_b{b}", "graded", b, graded_policy(b)) for b in range(17)]


def policies(spark: SparkSession) -> DataFrame:
    rows = [(n, kind, b, p, 1 + e) for n, kind, b, extras in catalogue() for p, e in enumerate(extras)]
    return spark.createDataFrame(rows, "policy string, kind string, budget long, plane long, replicas long")


def replicate(planes: DataFrame, replicas: list[int]) -> DataFrame:
    """(plane, replica, row_id, byte): so many copies of each plane."""
    count = F.element_at(F.array(*(F.lit(r) for r in replicas)), (F.col("plane") + 1).cast("int"))
    return planes.select("plane", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("replica"), "row_id", "byte")


def net_masks(plan: DataFrame) -> DataFrame:
    """Faults (plane, replica, row_id, mask) that hit one byte several times cancel or add by xor."""
    return plan.groupBy("plane", "replica", "row_id").agg(F.bit_xor("mask").alias("mask"))


def inject(copies: DataFrame, plan: DataFrame) -> DataFrame:
    joined = copies.join(net_masks(plan), ["plane", "replica", "row_id"], "left")
    return joined.withColumn("byte", F.col("byte").bitwiseXOR(F.coalesce("mask", F.lit(0).cast("long")))).drop("mask")


def vote(copies: DataFrame, tie: str = "none") -> DataFrame:
    """(plane, row_id, byte, agreed) by majority; ``tie``: "none" gives null, "max", "min" or "first" a copy."""
    seen = copies.groupBy("plane", "row_id", "byte").agg(F.count("*").alias("n"), F.min("replica").alias("first"))
    most = seen.groupBy("plane", "row_id").agg(F.sum("n").alias("r"), F.max("n").alias("top"), F.max_by("byte", F.struct("n", "byte")).alias("largest"), F.max_by("byte", F.struct("n", -F.col("byte"))).alias("smallest"), F.min_by("byte", "first").alias("original"))
    agreed = F.col("top") * 2 > F.col("r")
    other = {"none": F.lit(None).cast("long"), "max": F.col("largest"), "min": F.col("smallest"), "first": F.col("original")}[tie]
    return most.select("plane", "row_id", F.when(agreed, F.col("largest")).otherwise(other).alias("byte"), agreed.alias("agreed"))


def vote3(a: Column, b: Column, c: Column, tie: Column | None = None) -> Column:
    """The same for three columns, within a row."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(tie if tie is not None else F.lit(None))


def sum32_bytes(byte: Column) -> Column:
    return (F.sum(byte) % F.lit(1 << 32)).cast("long")


def sum32_words(byte: Column, row_id: Column) -> Column:
    """Sum of little-endian 32-bit words modulo 2^32; a short last word is padded with zeros."""
    place = F.element_at(F.array(*(F.lit(256**i) for i in range(4))), (F.pmod(row_id, F.lit(4)) + 1).cast("int")).cast("long")
    return (F.sum((byte * place).cast("decimal(38,0)")) % F.lit(1 << 32)).cast("long")


def digests(planes: DataFrame) -> DataFrame:
    """Linear digests of each plane: byte sum, word sum, xor, even and odd words, position weighted."""
    even = F.pmod(F.floor(F.col("row_id") / 4), F.lit(2)) == 0
    zero = F.lit(0).cast("long")
    return planes.groupBy("plane").agg(
        sum32_bytes(F.col("byte")).alias("sum32"), sum32_words(F.col("byte"), F.col("row_id")).alias("words32"), F.sum("byte").cast("long").alias("sum64"), F.bit_xor("byte").alias("xor8"),
        sum32_words(F.when(even, F.col("byte")).otherwise(zero), F.col("row_id")).alias("even32"), sum32_words(F.when(even, zero).otherwise(F.col("byte")), F.col("row_id")).alias("odd32"),
        (F.sum((F.col("byte") * (F.col("row_id") + 1)).cast("decimal(38,0)")) % F.lit(1 << 32)).cast("long").alias("weighted32"),
    )


def _unit_bytes(planes: DataFrame, unit: int) -> DataFrame:
    """(plane, unit, bytes): at most ``unit`` rows a group, so a group fits any task."""
    packed = planes.groupBy("plane", F.floor(F.col("row_id") / unit).alias("unit")).agg(F.sort_array(F.collect_list(F.struct("row_id", "byte"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: F.lpad(F.hex(r["byte"]), 2, "0")), "")
    return packed.select("plane", "unit", F.unhex(text).alias("bytes"))


def crc32_units(planes: DataFrame, unit: int = UNIT) -> DataFrame:
    return _unit_bytes(planes, unit).select("plane", "unit", F.crc32("bytes").alias("crc32"))


def _crc32c_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)
    return table


def crc32c(data: bytes) -> int:
    """Castagnoli CRC, reflected."""
    table, c = crc32c.table, 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ table[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


crc32c.table = _crc32c_table()


def crc32c_units(planes: DataFrame, unit: int = UNIT) -> DataFrame:
    @F.pandas_udf("long")
    def each(data: pd.Series) -> pd.Series:
        return data.map(crc32c).astype("int64")

    return _unit_bytes(planes, unit).select("plane", "unit", each("bytes").alias("crc32c"))


def ordered_digests(data: bytes) -> tuple[int, int]:
    """(xor-rotate, Fletcher) of the bytes in order, 32 bits each; one sequential definition."""
    x = a = b = 0
    for byte in data:
        x = (x << 5 | x >> 27) & 0xFFFFFFFF ^ byte
        a = (a + byte) % 65535
        b = (b + a) % 65535
    return x, b << 16 | a


def ordered_digest_units(planes: DataFrame, unit: int = UNIT) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ordered_digests(d) for d in batch["bytes"]]
            yield batch[["plane", "unit"]].assign(xor_rotate=[x for x, _ in found], fletcher=[y for _, y in found])

    return _unit_bytes(planes, unit).mapInPandas(run, "plane long, unit long, xor_rotate long, fletcher long")


def repair(copies: DataFrame, reference: DataFrame, unit: int = UNIT) -> DataFrame:
    """(plane, unit, status) of lazily repaired units.

    Only units whose first copy has another CRC than ``reference`` (plane, unit, crc32) are voted on; the
    CRC of the voted unit is checked again, so a common fault goes to the fallback.
    """
    first = crc32_units(copies.where("replica = 0"), unit).withColumnRenamed("crc32", "found")
    flagged = first.join(reference, ["plane", "unit"]).select("plane", "unit", "crc32", (F.col("found") != F.col("crc32")).alias("bad"))
    bad = flagged.where("bad").select("plane", "unit")
    voted = vote(copies.withColumn("unit", F.floor(F.col("row_id") / unit)).join(bad, ["plane", "unit"], "left_semi"))
    whole = voted.groupBy("plane", F.floor(F.col("row_id") / unit).alias("unit")).agg(F.bool_and("agreed").alias("whole"))
    again = crc32_units(voted.where("agreed"), unit).withColumnRenamed("crc32", "voted")
    out = flagged.join(whole, ["plane", "unit"], "left").join(again, ["plane", "unit"], "left")
    status = F.when(~F.col("bad"), "clean").when(F.col("whole") & (F.col("voted") == F.col("crc32")), "repaired").otherwise("fallback")
    return out.select("plane", "unit", status.alias("status"))


def encoded_sum(planes: DataFrame) -> DataFrame:
    return planes.agg(F.sum((F.col("byte") * weight(F.col("plane"))).cast("decimal(38,0)")).alias("total"))


def certified_bound(detected: DataFrame, rows: int) -> DataFrame:
    """Half width of the sum's interval for the planes (plane) known to be damaged."""
    return detected.agg(F.coalesce(F.sum((F.lit(255 * rows) * weight(F.col("plane"))).cast("decimal(38,0)")), F.lit(0)).alias("bound"))


def outcome(detected: Column, correct: Column, contains: Column) -> Column:
    """What a reader gets who detects and bounds."""
    return F.when(correct, "exact_correct").when(~detected, "silent_wrong").when(contains, "certified_degraded").otherwise("uncertified")


def plane_outcome(replicas: Column, damaged: Column, differs: Column, voted_right: Column) -> Column:
    """EC exact, MR majority repaired, DU detected, SW silently wrong; a wrong value voted for is delivered, so it is silent."""
    return F.when(~damaged, "EC").when(replicas == 1, "SW").when(replicas == 2, F.when(differs, "DU").otherwise("SW")).when(voted_right, "MR").otherwise("SW")


def combined_outcome(outcome: Column) -> Column:
    """The worst of the planes' outcomes."""
    rank = F.when(outcome == "SW", 3).when(outcome == "DU", 2).when(outcome == "MR", 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, ("EC", "MR", "DU", "SW"))), F.max(rank) + 1)


FAMILIES = ("independent", "short_burst", "long_run", "column_offset", "dense_region", "region_burst", "twin", "mixed")
#: The 11 severities of the families, by parameters of ``fault_plan``.
SEVERITIES: dict[str, list[dict]] = {
    "independent": [{}], "short_burst": [{"burst_min": 2, "burst_max": 2}, {"burst_min": 4, "burst_max": 4}], "long_run": [{"run_length": 8}, {"run_length": 512}],
    "column_offset": [{"affected_row_fraction": 0.1}, {"affected_row_fraction": 1.0}], "dense_region": [{"density": 0.5, "region_size": 4096}], "region_burst": [{"burst_events": 10, "region_size": 1024}],
    "twin": [{"target_replicas": [0, 1]}], "mixed": [{"f1_ratio": 0.5, "target_replicas": [0, 1]}],
}


#: Bursts, runs and regions that are drawn together; a plan has as many such blocks as it needs.
BLOCK = 100


def _wanted(rate: float, rows: int) -> int:
    return max(1, int(rows * rate)) if rate > 0 else 0


def _bursts(family: str, rate: float, rows: int, how: dict) -> int:
    """Bursts, runs or regions of a plan; families of single events have none."""
    if family == "dense_region":
        return how.get("n_regions", _wanted(rate, rows))
    return _wanted(rate, rows) if family in ("short_burst", "long_run") else 0


def plan_blocks(family: str, rate: float, rows: int, severity: dict | None = None) -> int:
    """Blocks that a plan is drawn in, each by itself."""
    return max(1, -(-_bursts(family, rate, rows, severity or {}) // BLOCK))


def fault_plan(family: str, rate: float, seed: int, rows: int, replicas: list[int], segment: int = UNIT, severity: dict | None = None, block: int | None = None) -> list[tuple[int, int, int, int]]:
    """(plane, replica, row_id, mask) events of a family, seeded; their number follows rate times rows.

    Events hit the first copy; those of twins hit the named copies that there are, with one mask.  With ``block`` only
    the events of that one of the plan's ``plan_blocks``.
    """
    how = severity or {}
    if block is None:
        blocks = range(plan_blocks(family, rate, rows, severity))
        return [e for b in blocks for e in fault_plan(family, rate, seed, rows, replicas, segment, severity, b)]
    if family == "mixed":
        share = how.get("f1_ratio", 0.5)
        return fault_plan("independent", rate * share, seed, rows, replicas, segment) + fault_plan("twin", rate * (1 - share), seed + 1, rows, replicas, segment, how)
    r, wanted = random.Random(f"{family}:{seed}"), _wanted(rate, rows)
    length = r.randint(how.get("burst_min", 2), how.get("burst_max", 4)) if family == "short_burst" else how.get("run_length", 64)
    if block:
        r = random.Random(f"{family}:{seed}:{block}")
    bursts = range(block * BLOCK, min((block + 1) * BLOCK, _bursts(family, rate, rows, how)))

    def mask() -> int:
        return r.randint(1, 255)

    def run() -> list[tuple[int, int, int, int]]:
        p, low = r.randrange(PLANES), r.randint(0, max(0, rows - length))
        return [(p, 0, low + i, mask()) for i in range(min(length, rows))]

    if family == "independent":
        return [(r.randrange(PLANES), 0, r.randrange(rows), mask()) for _ in range(wanted)]
    if family in ("short_burst", "long_run"):
        return [e for _ in bursts for e in run()]
    if family == "column_offset":
        segments = -(-rows // segment)
        p, m, at = r.randrange(PLANES), mask(), r.randint(0, 255)
        hit = r.sample(range(segments), max(1, int(segments * how.get("affected_row_fraction", 0.1))))
        return [(p, 0, x * segment + at, m) for x in hit if x * segment + at < rows]
    if family == "dense_region":
        size = min(how.get("region_size", segment), rows)
        n = max(1, int(size * how.get("density", min(0.1, rate * 1000))))
        out = []
        for _ in bursts:
            p, low = r.randrange(PLANES), r.randint(0, rows - size)
            out += [(p, 0, x, mask()) for x in r.sample(range(low, low + size), min(n, size))]
        return out
    if family == "region_burst":
        size = min(how.get("region_size", 1024), rows)
        p, low = r.randrange(PLANES), r.randint(0, rows - size)
        return [(p, 0, low + r.randrange(size), mask()) for _ in range(how.get("burst_events", max(1, int(rate * 1e6))))]
    if family == "twin":
        hits = [(r.randrange(PLANES), r.randrange(rows), mask()) for _ in range(wanted)]
        return [(p, c, at, m) for p, at, m in hits for c in how.get("target_replicas", [0, 1]) if c < replicas[p]]
    raise ValueError(f"unknown family {family}")


def plan_frame(spark: SparkSession, plan: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(plan, "plane long, replica long, row_id long, mask long")


def validate_plan(plan: DataFrame, replicas: list[int], rows: int) -> None:
    """Raise on an event outside the planes, their replicas or rows."""
    count = F.coalesce(F.get(F.array(*map(F.lit, replicas)), F.col("plane").cast("int")), F.lit(0))
    bad = plan.where((F.col("plane") < 0) | (F.col("replica") < 0) | (F.col("replica") >= count) | ~F.col("row_id").between(0, rows - 1) | ~F.col("mask").between(1, 255)).count()
    if bad:
        raise ValueError(f"{bad} events lie outside the planes")


def exposure(plan: DataFrame, segment: int = UNIT) -> DataFrame:
    """Counters of a plan: events, bits, bytes, planes, segments, impact by place value, cancelled bytes."""
    net = net_masks(plan)
    a = plan.agg(F.count("*").alias("events"), F.sum(F.bit_count("mask")).cast("long").alias("bit_flips"), F.count_distinct("plane").alias("planes"), F.count_distinct(F.floor(F.col("row_id") / segment)).alias("segments"))
    b = net.agg(F.count("*").alias("bytes"), F.count_if(F.col("mask") == 0).alias("cancelled"), F.sum(F.when(F.col("mask") != 0, F.pow(F.lit(2.0), 8 * (PLANES - 1 - F.col("plane")))).otherwise(0.0)).alias("impact"))
    return a.crossJoin(b)  # one row each


# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T_QUANTILES = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045229642132703, 2.042]


def ci95(x: str) -> list[Column]:
    """Mean and half width with the t quantile of n - 1 degrees; zeros for fewer than two values."""
    n = F.count(x)
    at = F.element_at(F.array(*map(F.lit, T_QUANTILES)), F.greatest(F.least(n - 1, F.lit(30)), F.lit(1)).cast("int"))
    return [F.avg(x).alias("mean"), F.when(n < 2, 0.0).otherwise(at * F.stddev_samp(x) / F.sqrt(n)).alias("half_width")]


def indexed_quantile(x: str, q: float) -> Column:
    """The element of place int(n q) of the sorted values; for the small groups of a campaign."""
    values = F.sort_array(F.collect_list(x))
    return F.element_at(values, F.least(F.floor(F.size(values) * F.lit(q)) + 1, F.size(values)).cast("int"))


ALLOCATIONS = ("graded", "uniform_detect", "uniform_repair")


def allocation(units: DataFrame, kind: str, budget: int, planes: int, plane_bytes: int, unit: int = UNIT) -> DataFrame:
    """``units`` (plane, unit) with ``replicas`` by a budget of so many whole planes.

    "graded" fills plane 0 to three copies, then plane 1, a copy of the whole plane at a time.  The uniform kinds
    give the first units in the order (unit, plane) a second copy, or two more, as far as the budget goes.
    """
    if kind == "graded":
        extra = F.when(F.col("plane") < 2, F.greatest(F.least(F.lit(budget) - 2 * F.col("plane"), F.lit(2)), F.lit(0))).otherwise(0)
        return units.withColumn("replicas", (1 + extra).cast("long"))
    copies = {"uniform_detect": 1, "uniform_repair": 2}[kind]
    # A unit's place in the order follows from its numbers, so nothing is sorted.
    chosen = F.col("unit") * planes + F.col("plane") < budget * plane_bytes // (copies * unit)
    return units.withColumn("replicas", F.when(chosen, F.lit(1 + copies)).otherwise(1).cast("long"))


def coverage(allocated: DataFrame, plane_bytes: int, unit: int = UNIT) -> DataFrame:
    """Bytes by what their copies allow: repair of three, detection of two, fallback only; and the extra bytes."""
    size = F.least(F.lit(unit), F.lit(plane_bytes) - F.col("unit") * unit)
    of = lambda n: F.coalesce(F.sum(F.when(F.col("replicas") == n, size)), F.lit(0)).cast("long")
    return allocated.agg(of(3).alias("repair_bytes"), of(2).alias("detect_bytes"), of(1).alias("fallback_bytes"), F.sum((F.col("replicas") - 1) * size).cast("long").alias("extra_bytes"))


def grid(rates: list[float], seeds: list[int]) -> list[tuple[str, str, int, float, int]]:
    """Cells (policy, family, severity, rate, seed) of all policies, families and severities."""
    return [(n, f, v, rate, seed) for n, *_ in catalogue() for f in FAMILIES for v in range(len(SEVERITIES[f])) for rate in rates for seed in seeds]


def plan_events(spark: SparkSession, plans: list[tuple[str, int, float, int]], rows: int) -> DataFrame:
    """(plan, plane, replica, row_id, mask): the events of plans (family, severity, rate, seed), each numbered by its place.

    A plan is drawn for the most copies.  A policy with fewer has the same events without those of the copies it lacks,
    so one plan serves all policies.
    """
    blocks = [(i, *x, b) for i, x in enumerate(plans) for b in range(plan_blocks(x[0], x[2], rows, SEVERITIES[x[0]][x[1]]))]
    names = spark.createDataFrame(blocks, "plan long, family string, severity long, rate double, seed long, block long")

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples():
                plan = fault_plan(x.family, x.rate, x.seed, rows, [1 + EXTRAS] * PLANES, severity=SEVERITIES[x.family][x.severity], block=x.block)
                yield pd.DataFrame(plan, columns=["plane", "replica", "row_id", "mask"]).assign(plan=x.plan)

    # The plans are drawn by the executors, a block at a time, so their events never meet on the driver nor all in one task.
    return names.repartition(max(8, len(blocks) // 8), "plan", "block").mapInPandas(events, "plan long, plane long, replica long, row_id long, mask long")


def campaign(spark: SparkSession, codes: DataFrame, rows: int, cells: list[tuple[str, str, int, float, int]]) -> DataFrame:
    """One row per cell (policy, family, severity by its place, rate, seed): answers, bound, outcome; all cells in one job.

    ``codes`` (row_id, code) are the numbers whose bytes are the planes.  What a plan does to a plane is worked out
    once for each number of copies; a cell takes of each plane what its policy's number gives.
    """
    replicas = {n: [1 + x for x in e] for n, _, _, e in catalogue()}
    names = spark.createDataFrame([(c, *x) for c, x in enumerate(cells)], "cell long, policy string, family string, severity long, rate double, seed long")
    number = {x: i for i, x in enumerate(dict.fromkeys(x[1:] for x in cells))}
    # Only bytes that some fault hits differ from the clean ones; dealt by row, they are netted and joined in one exchange.
    masks = [F.coalesce(F.bit_xor(F.when(F.col("replica") == c, F.col("mask"))), F.lit(0).cast("long")).alias(f"m{c}") for c in range(1 + EXTRAS)]
    net = plan_events(spark, list(number), rows).repartition("row_id").groupBy("row_id", "plan", "plane").agg(*masks).where("m0 <> 0 OR m1 <> 0 OR m2 <> 0")
    byte = F.call_function("shiftright", F.col("code"), (8 * (PLANES - 1 - F.col("plane"))).cast("int")).bitwiseAND(255)
    hit = net.join(codes.where("code IS NOT NULL"), "row_id").withColumn("byte", byte)
    a, b, c = (F.col("byte").bitwiseXOR(F.col(f"m{i}")) for i in range(1 + EXTRAS))
    # Two copies are compared, not voted on; of three without a majority the smallest is given.
    given = {1: a, 2: a, 3: vote3(a, b, c, F.least(a, b, c))}
    struck, kinds = F.col("m0") != 0, F.lit(False)
    found = []
    for r, value in given.items():
        if r > 1:
            struck, kinds = struck | (F.col(f"m{r - 1}") != 0), kinds | (F.col("m0") != F.col(f"m{r - 1}"))
        off = F.when(struck, value - F.col("byte"))
        found.append(F.struct(F.lit(r).cast("long").alias("r"), F.count(off).alias("n"), F.sum(off).alias("off"), F.bool_or(struck & kinds).alias("detected"), F.bool_and(F.coalesce(off, F.lit(0)) == 0).alias("right")))
    by_copies = hit.groupBy("plan", "plane").agg(F.array(*found).alias("x")).select("plan", "plane", F.explode("x").alias("x")).select("plan", "plane", "x.*").where("n > 0")
    by_copies = by_copies.withColumns({"damage": F.col("off").cast("decimal(38,0)") * weight(F.col("plane")), "digest_differs": F.col("off") % F.lit(1 << 32) != 0})
    counts = spark.createDataFrame([(n, p, r) for n, rs in replicas.items() for p, r in enumerate(rs)], "policy string, plane long, r long")
    own = spark.createDataFrame([(i, x[0], number[x[1:]]) for i, x in enumerate(cells)], "cell long, policy string, plan long")
    per_plane = own.join(F.broadcast(counts), "policy").join(by_copies, ["plan", "plane", "r"])
    kind = plane_outcome(F.col("r"), F.lit(True), F.col("detected"), F.col("right"))
    # A reader without copies compares digests of the planes and widens the answer by those that differ.
    width = F.sum(F.when(F.col("digest_differs"), F.lit(255 * rows) * weight(F.col("plane"))).otherwise(0)).cast("decimal(38,0)")
    per_cell = per_plane.groupBy("cell").agg(F.sum("damage").cast("decimal(38,0)").alias("damage"), width.alias("bound"), F.bool_or("digest_differs").alias("detected"), F.sort_array(F.collect_set("plane")).alias("faulted_planes"), combined_outcome(kind).alias("outcome"))
    # The planes hold a code's bits without a sign.
    unsigned = F.col("code").cast("decimal(20,0)") + F.when(F.col("code") < 0, F.lit(str(256**PLANES))).otherwise("0").cast("decimal(20,0)")
    clean = codes.agg(F.sum(unsigned.cast("decimal(38,0)")).cast("decimal(38,0)").alias("clean_answer"))
    none, off = F.lit(0).cast("decimal(38,0)"), F.lit(False)
    cells = names.join(per_cell, "cell", "left").crossJoin(F.broadcast(clean))  # one row: the clean sum
    cells = cells.withColumns({"damage": F.coalesce("damage", none), "bound": F.coalesce("bound", none), "detected": F.coalesce("detected", off), "outcome": F.coalesce("outcome", F.lit("EC")), "faulted_planes": F.coalesce("faulted_planes", F.array().cast("array<bigint>"))})
    error = F.abs(F.col("damage"))
    cells = cells.withColumns({
        "delivered_answer": F.col("clean_answer") + F.col("damage"), "abs_error": error, "relative_error": error.cast("double") / F.greatest(F.abs("clean_answer").cast("double"), F.lit(1.0)),
        "contains_truth": error <= F.col("bound"), "decision_flip": error.cast("double") > 0.05 * F.abs("clean_answer").cast("double"),
    })
    vectors = spark.createDataFrame([(n, rs, sum(rs) - PLANES) for n, rs in replicas.items()], "policy string, r_vector array<long>, extra_copies long")
    return cells.withColumn("bounded_outcome", outcome(F.col("detected"), F.col("damage") == 0, F.col("contains_truth"))).join(F.broadcast(vectors), "policy")


def cell_metrics(cells: DataFrame, *by: str) -> DataFrame:
    """Rates and quantiles of campaign cells for each group; quantiles take the element of place int(n q)."""
    is_ = lambda *names: F.avg(F.col("outcome").isin(*names).cast("int"))
    bounded = lambda *names: F.avg(F.col("bounded_outcome").isin(*names).cast("int"))
    return cells.groupBy(*by).agg(
        F.count("*").alias("cells"), is_("EC").alias("exact_rate"), is_("MR").alias("recovered_rate"), is_("DU").alias("unavailable_rate"), is_("SW").alias("silent_wrong_rate"),
        is_("EC", "MR").alias("correct_answer_rate"), (1 - is_("SW")).alias("safe_answer_rate"), bounded("exact_correct", "certified_degraded").alias("accepted_answer_rate"),
        F.avg((F.col("relative_error") > 1).cast("int")).alias("catastrophic_rate"), F.avg(F.col("decision_flip").cast("int")).alias("decision_flip_rate"), F.avg(F.col("contains_truth").cast("int")).alias("contains_truth_rate"),
        F.avg("relative_error").alias("mean_relative_error"), *(indexed_quantile("relative_error", q).alias(f"relative_error_p{n}") for q, n in ((0.5, 50), (0.99, 99), (0.999, 999))), F.max("relative_error").alias("max_relative_error"),
        indexed_quantile("bound", 0.5).alias("bound_median"), F.avg("extra_copies").alias("extra_copies"),
    )
