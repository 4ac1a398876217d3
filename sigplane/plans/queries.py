"""Registered queries of the engine, each with its DuckDB twin in the integer code domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.functions import codec
from sigplane.operators import aggregates as A
from sigplane.operators import predicate as P
from sigplane.operators import reliability as R
from sigplane.operators import reports
from sigplane.plans import layout
from sigplane.sources import raw as raw_source

Query = Callable[[SparkSession, str], DataFrame]

PRECISION, SEGMENT, PLANES, THRESHOLD = 4, 256, codec.MAX_PLANES, 100.0
DEPTHS = range(1, PLANES + 1)
SCALE = float(1 << codec.FRACTION_BITS[PRECISION])


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("row_id"), F.col("value").alias("v"))


def planes(spark: SparkSession, sf: str) -> layout.Planes:
    return layout.encode(raw(spark, sf), precision=PRECISION, segment=SEGMENT, planes=PLANES)


_BASE = f"""WITH enc AS (SELECT event_id AS row_id, event_id // {SEGMENT} AS seg, value AS v, CAST(floor(value * {SCALE}) AS BIGINT) AS code FROM events),
meta AS (SELECT seg, min(row_id) AS row_offset, count(*) AS row_count, min(code) AS base, max(code) - min(code) AS span, min(v) AS vmin, max(v) AS vmax, CAST(sum(code) AS BIGINT) AS code_sum FROM enc GROUP BY seg),
m AS (SELECT *, CAST(CASE WHEN span = 0 THEN 0 ELSE length(bin(span)) END AS BIGINT) AS fl FROM meta),
e AS (SELECT row_id, enc.seg, v, code, code - base AS d, base, fl, vmin, vmax FROM enc JOIN m ON enc.seg = m.seg)"""


def _cut(k: int) -> str:
    """Rows with the bounds that k planes give."""
    return f"""{_BASE},
b AS (SELECT *, (d >> CAST(om AS INTEGER)) << CAST(om AS INTEGER) AS lo, ((d >> CAST(om AS INTEGER)) << CAST(om AS INTEGER)) + (CAST(1 AS BIGINT) << CAST(om AS INTEGER)) - 1 AS hi, CAST(floor({THRESHOLD} * {SCALE}) AS BIGINT) - base AS t
      FROM (SELECT *, greatest(fl - {8 * k}, 0) AS om FROM e))"""


def _byte(p: int) -> str:
    low = f"CAST(greatest(fl - {8 * (p + 1)}, 0) AS INTEGER)"
    return f"CASE WHEN fl > {8 * p} THEN (d >> {low}) & ((CAST(1 AS BIGINT) << CAST(least(fl - {8 * p}, 8) AS INTEGER)) - 1) END"


def _bound(k: int) -> str:
    return f"({codec.quantum(PRECISION)!r} + CASE WHEN greatest(fl - {8 * k}, 0) > 0 THEN pow(2.0, greatest(fl - {8 * k}, 0) - 15) ELSE 0.0 END)"


_FIXED = """WITH c AS (SELECT event_id AS row_id, CAST(round_even(value * 100, 0) AS BIGINT) AS code FROM events),
f AS (SELECT p AS plane, row_id, (code >> CAST(8 * (7 - p) AS INTEGER)) & 255 AS byte FROM c, (SELECT unnest(range(8)) AS p))"""

# A fault plan that SQL can state: one bit of every 97th byte of plane 6 and of every 89th of plane 7.
_PLAN_SQL = """plan AS (SELECT 6 AS plane, 0 AS replica, row_id, 1 AS mask FROM f WHERE plane = 6 AND row_id % 97 = 0
 UNION ALL SELECT 7, 1, row_id, 128 FROM f WHERE plane = 7 AND row_id % 89 = 0
 UNION ALL SELECT 7, 2, row_id, 128 FROM f WHERE plane = 7 AND row_id % 178 = 0)"""


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return R.fixed_planes(raw(spark, sf))


def _plan(f: DataFrame) -> DataFrame:
    def part(plane: int, replica: int, step: int, mask: int) -> DataFrame:
        return f.where((F.col("plane") == plane) & (F.col("row_id") % step == 0)).select("plane", F.lit(replica).cast("long").alias("replica"), "row_id", F.lit(mask).cast("long").alias("mask"))

    return part(6, 0, 97, 1).unionByName(part(7, 1, 89, 128)).unionByName(part(7, 2, 178, 128))


def _voted(spark: SparkSession, sf: str) -> DataFrame:
    f = _fixed(spark, sf)
    return R.vote(R.inject(R.replicate(f, [3] * 8), _plan(f)))


def _qdu(k: int, domain: str = "encoded") -> Query:
    return lambda spark, sf: P.count_interval(planes(spark, sf), THRESHOLD, k, domain)


def _qdu_sql(q: str, d: str, k: int) -> str:
    return f"{_cut(k)} SELECT count(*) FILTER ({q}) AS q, count(*) FILTER ({d}) AS d, count(*) FILTER (NOT ({q}) AND NOT ({d})) AS u, count(*) FILTER ({q}) AS count_lower, count(*) FILTER (NOT ({d}) OR ({q})) AS count_upper FROM b"


_MODE = f"CASE WHEN {THRESHOLD} < vmin THEN 1 WHEN {THRESHOLD} >= vmax THEN 2 ELSE 0 END"
_X = f"(base + lo) / {SCALE}"

_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _ALL[name] = (query, sql)


def _register() -> None:
    t, s = THRESHOLD, SCALE
    # Ingest and layout
    _add("raw_scan", lambda sp, sf: raw(sp, sf), "SELECT event_id AS row_id, value AS v FROM events")
    _add("raw_profile", lambda sp, sf: raw_source.profile(sp.read.parquet(f"{sf}/customer.parquet").select(F.col("c_acctbal").alias("v"))), "SELECT count(*) AS n, count(*) FILTER (c_acctbal IS NULL) AS nulls, count(*) FILTER (isnan(c_acctbal)) AS nans, count(*) FILTER (isinf(c_acctbal)) AS infinite, count(*) FILTER (c_acctbal < 0) AS negative, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer")
    for mode, expr in (("clip", "greatest(c_acctbal, 0.0)"), ("offset", "c_acctbal - least((SELECT min(c_acctbal) FROM customer), 0.0)")):
        _add(f"clean_{mode}", lambda sp, sf, m=mode: raw_source.clean(sp.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("v")), m), f"SELECT c_custkey AS row_id, {expr} AS v FROM customer")
    _add("encode_codes", lambda sp, sf: layout.codes(raw(sp, sf), PRECISION, SEGMENT), f"{_BASE} SELECT row_id, seg, v, code FROM enc")
    _add("segment_meta", lambda sp, sf: planes(sp, sf).meta.withColumn("code_sum", F.col("code_sum").cast("long")), f"{_BASE} SELECT seg, row_offset, row_count, base, vmin, vmax, code_sum, fl, CAST(ceil(fl / 8.0) AS BIGINT) AS active, greatest(fl - 15, 0) AS integer_bits FROM m")
    _add("plane_bytes", lambda sp, sf: planes(sp, sf).rows.select("row_id", *(F.col(f"b{i}").cast("long").alias(f"b{i}") for i in range(PLANES))), f"{_BASE} SELECT row_id, " + ", ".join(f"{_byte(i)} AS b{i}" for i in range(PLANES)) + " FROM e")
    for k in (1, 2, 3):
        _add(f"decode_k{k}", lambda sp, sf, k=k: planes(sp, sf).first(k).select("row_id", ((F.col("base") + F.col("lo")) / F.lit(s)).alias("x")), f"{_cut(k)} SELECT row_id, {_X} AS x FROM b")
        _add(f"error_bound_k{k}", lambda sp, sf, k=k: planes(sp, sf).meta.select("seg", codec.value_bound(F.col("fl"), k, PRECISION).alias("bound")), f"{_BASE} SELECT seg, {_bound(k)} AS bound FROM m")
    _add("artifact_checks", lambda sp, sf: layout.contract(planes(sp, sf)), "SELECT unnest(['rows_without_segment', 'row_outside_segment', 'reconstruction_error', 'plane_beyond_active', 'byte_out_of_range', 'too_many_planes', 'bounds_crossed', 'segment_too_long']) AS \"check\", CAST(0 AS BIGINT) AS violations")
    _add("head_rows", lambda sp, sf: raw(sp, sf).where(F.col("row_id") < 1000), "SELECT event_id AS row_id, value AS v FROM events WHERE event_id < 1000")
    # Predicates
    _add("raw_count_gt", lambda sp, sf: raw(sp, sf).agg(F.count_if(F.col("v") > t).alias("n")), f"SELECT count(*) FILTER (value > {t}) AS n FROM events")
    _add("segment_modes", lambda sp, sf: P.segment_modes(planes(sp, sf), t).select("seg", "mode", "t_code"), f"{_BASE} SELECT seg, CAST({_MODE} AS BIGINT) AS mode, CAST(floor({t} * {s}) AS BIGINT) - base AS t_code FROM m")
    for k in (1, 2, 3):
        _add(f"count_gt_qdu_k{k}", _qdu(k), _qdu_sql("lo > t", "hi <= t", k))
        _add(f"count_gt_value_k{k}", _qdu(k, "value"), _qdu_sql(f"{_X} > {t}", f"{_X} + {_bound(k)} <= {t}", k))
    _add("row_states_k2", lambda sp, sf: P.states(planes(sp, sf), t, 2).select("row_id", F.col("state").cast("long").alias("state")), f"{_cut(2)} SELECT row_id, CAST(CASE WHEN lo > t THEN 1 WHEN hi <= t THEN 0 ELSE 2 END AS BIGINT) AS state FROM b")
    requests = [(1, 50.0, 1), (2, 100.0, 2), (3, 200.0, 3)]
    part = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS request, CAST({x} AS DOUBLE) AS threshold, CAST({k} AS BIGINT) AS k, q, d, u FROM (SELECT count(*) FILTER (lo > t) AS q, count(*) FILTER (hi <= t) AS d, count(*) FILTER (lo <= t AND hi > t) AS u FROM (SELECT CAST(floor({x} * {s}) AS BIGINT) - base AS t, (d >> CAST(om AS INTEGER)) << CAST(om AS INTEGER) AS lo, ((d >> CAST(om AS INTEGER)) << CAST(om AS INTEGER)) + (CAST(1 AS BIGINT) << CAST(om AS INTEGER)) - 1 AS hi FROM (SELECT *, greatest(fl - {8 * k}, 0) AS om FROM e)))" for r, x, k in requests)
    _add("batch_counts", lambda sp, sf: P.batch_counts(planes(sp, sf), requests), f"{_BASE} {part}")
    rounds = "CASE " + " ".join(f"WHEN (d >> CAST(greatest(fl - {8 * k}, 0) AS INTEGER)) <> (t >> CAST(greatest(fl - {8 * k}, 0) AS INTEGER)) THEN {k}" for k in DEPTHS) + f" ELSE {PLANES + 1} END"
    _add("survival_by_round", lambda sp, sf: P.survival(planes(sp, sf), t), f"{_cut(3)} SELECT CAST({rounds} AS BIGINT) AS round, count(*) FILTER (d > t) AS resolved_q, count(*) FILTER (d <= t) AS resolved_d FROM b GROUP BY 1")
    _add("refine_direct_k1", lambda sp, sf: P.refine_direct(planes(sp, sf), t, 1), f"{_cut(1)} SELECT count(*) FILTER (lo > t) AS q, count(*) FILTER (lo <= t AND hi > t) AS u, count(*) FILTER (lo <= t AND hi > t AND v > {t}) AS hits, count(*) FILTER (lo > t OR (hi > t AND v > {t})) AS refined_count FROM b")
    _add("refine_compact_k1", lambda sp, sf: P.refine_compact(planes(sp, sf), raw(sp, sf), t, 1), f"{_cut(1)}, y AS (SELECT v, {_X} > {t} AS q, {_X} <= {t} AND {_X} + {_bound(1)} > {t} AS u FROM b) SELECT count(*) FILTER (q) AS q, count(*) FILTER (u AND v > {t}) AS hits, count(*) FILTER (u) AS u, count(*) FILTER (v > {t}) AS refined_count FROM y")
    # Aggregates
    _add("raw_sum_gt", lambda sp, sf: raw(sp, sf).where(F.col("v") > t).agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("decimal(28,8)")).cast("double"), 4).alias("raw_sum")), f"SELECT count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE), 4) AS raw_sum FROM events WHERE value > {t}")
    for k in (1, 2, 3):
        _add(f"progressive_sum_k{k}", lambda sp, sf, k=k: A.progressive_sum(planes(sp, sf), k), f"{_cut(k)} SELECT count(*) AS n, CAST(sum(base + lo) AS BIGINT) AS lower_code, CAST(sum(base + hi) AS BIGINT) AS upper_code, CAST(sum(base + lo) AS DOUBLE) / {s} AS sum_lower, CAST(sum(base + hi) AS DOUBLE) / {s} AS sum_upper, CAST(sum(base + lo) AS DOUBLE) / {s} / count(*) AS avg_lower FROM b")
        _add(f"extrema_k{k}", lambda sp, sf, k=k: A.extrema(planes(sp, sf), k), f"{_cut(k)} SELECT min(base + lo) AS min_lower, min(base + hi) AS min_upper, max(base + lo) AS max_lower, max(base + hi) AS max_upper FROM b")
        _add(f"filter_sum_k{k}", lambda sp, sf, k=k: A.filter_sum(planes(sp, sf), t, k), f"{_cut(k)}, y AS (SELECT *, {_MODE} AS mode FROM b) SELECT count(*) FILTER (mode = 1 OR mode = 0 AND lo > t) AS count_q, count(*) FILTER (mode = 0 AND lo <= t AND hi > t) AS u, CAST(coalesce(sum(CASE WHEN mode = 1 THEN code WHEN mode = 0 AND lo > t THEN base + lo END), 0) AS BIGINT) AS sum_code, CAST(coalesce(sum(CASE WHEN mode = 1 THEN code WHEN mode = 0 AND hi > t THEN base + hi END), 0) AS BIGINT) AS sum_code_upper FROM y")
    for scope, by in (("segment", "OVER (PARTITION BY seg)"), ("global", "OVER ()")):
        _add(f"extremum_candidates_{scope}", lambda sp, sf, x=scope: A.extremum_candidates(planes(sp, sf), 1, x), f"{_cut(1)}, y AS (SELECT base + lo AS l, base + hi AS h, min(base + hi) {by} AS least, max(base + lo) {by} AS most FROM b) SELECT count(*) FILTER (l <= least) AS min_candidates, count(*) FILTER (h >= most) AS max_candidates FROM y")
    _add("variance_full", lambda sp, sf: A.moments(planes(sp, sf), PLANES).select("n", F.round("avg", 6).alias("avg"), F.round("var", 4).alias("var")), f"{_BASE} SELECT count(*) AS n, round(avg(code / {s}), 6) AS avg, round(var_pop(code / {s}), 4) AS var FROM enc")
    _add("analytic_bounds_k2", lambda sp, sf: (b := A.analytic_bounds(planes(sp, sf), 2)).select(*(F.round(c, 6).alias(c) for c in b.columns)), f"{_BASE}, z AS (SELECT *, {_bound(2)} AS b, (base + (CAST(1 AS BIGINT) << CAST(fl AS INTEGER)) - 1) / {s} AS largest FROM m), y AS (SELECT sum(row_count * b) AS sb, sum(row_count) AS n, max(b) AS eb, sum(2 * row_count * largest * b) AS vs, sum(code_sum) / {s} AS total FROM z) SELECT round(sb, 6) AS sum_bound, round(sb / n, 6) AS avg_bound, round(eb, 6) AS extremum_bound, round(vs / n + (2 * total / n + sb / n) * (sb / n), 6) AS var_bound FROM y")
    sums = f"y AS (SELECT CAST(sum(code) AS DOUBLE) / {s} AS exact, " + ", ".join(f"CAST(sum(base + ((d >> CAST(greatest(fl - {8 * k}, 0) AS INTEGER)) << CAST(greatest(fl - {8 * k}, 0) AS INTEGER))) AS DOUBLE) / {s} AS s{k}" for k in DEPTHS) + " FROM e), r AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, exact, s{k} AS approx, abs(exact - s{k}) AS abs_error, abs(exact - s{k}) / greatest(abs(exact), 1e-30) AS rel_error FROM y" for k in DEPTHS) + ")"
    _add("sum_errors", lambda sp, sf: A.errors(planes(sp, sf)), f"{_BASE}, {sums} SELECT * FROM r")
    for column, eps in (("rel_error", [0.1, 0.01, 1e-4, 1e-6]), ("abs_error", [10000.0, 100.0, 1.0])):
        grid = ", ".join(map(str, eps))
        _add(f"kstar_{column[:3]}", lambda sp, sf, c=column, e=eps: A.kstar(planes(sp, sf), e, c), f"{_BASE}, {sums} SELECT CAST(eps AS DOUBLE) AS eps, min(k) FILTER ({column} <= CAST(eps AS DOUBLE)) AS kstar FROM r, (SELECT unnest([{grid}]) AS eps) GROUP BY eps")
    _add("deferred_gather_k3", lambda sp, sf: A.deferred_gather(planes(sp, sf), raw(sp, sf), t, 3), f"{_cut(3)} SELECT count(*) AS n, round(CAST(sum(CAST(v AS DECIMAL(28,8))) AS DOUBLE), 4) AS raw_sum FROM b WHERE lo > t")
    _add("plane_statistics", lambda sp, sf: A.plane_statistics(planes(sp, sf)), f"{_BASE}, y AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS plane, {_byte(i)} AS byte FROM e" for i in range(PLANES)) + "), c AS (SELECT plane, byte, count(*) AS c FROM y WHERE byte IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, sum(c) OVER (PARTITION BY plane) AS n FROM c) SELECT plane, CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_bytes, CAST(coalesce(sum(c) FILTER (byte = 0), 0) AS BIGINT) AS zeros, min(byte) AS least, max(byte) AS most, round(sum(-(c / n) * log2(c / n)), 6) AS entropy FROM n GROUP BY plane")
    _add("plane_histogram", lambda sp, sf: A.plane_histogram(planes(sp, sf)), f"{_BASE} SELECT CAST(ceil(fl / 8.0) AS BIGINT) AS active, count(*) AS segments, min(seg) AS first_segment FROM m GROUP BY 1")
    _add("quantile_linear", lambda sp, sf: raw(sp, sf).agg(F.percentile("v", 0.9).alias("q")), "SELECT quantile_cont(value, 0.9) AS q FROM events")
    # Reliability
    _add("fixed_plane_sums", lambda sp, sf: _fixed(sp, sf).groupBy("plane").agg(F.sum("byte").alias("total"), F.count_if(F.col("byte") != 0).alias("active")), f"{_FIXED} SELECT plane, CAST(sum(byte) AS BIGINT) AS total, count(*) FILTER (byte <> 0) AS active FROM f GROUP BY plane")
    policy = ", ".join(f"('{n}', '{k}', {b}, {p}, {1 + e})" for n, k, b, extras in R.catalogue() for p, e in enumerate(extras))
    _add("policy_catalogue", lambda sp, sf: R.policies(sp), f"SELECT policy, kind, CAST(budget AS BIGINT) AS budget, CAST(plane AS BIGINT) AS plane, CAST(replicas AS BIGINT) AS replicas FROM (VALUES {policy}) AS v(policy, kind, budget, plane, replicas)")
    _add("digests", lambda sp, sf: R.digests(_fixed(sp, sf)), f"{_FIXED}, w AS (SELECT *, CAST(byte * pow(256, row_id % 4) AS HUGEINT) AS word, (row_id // 4) % 2 = 0 AS even FROM f) SELECT plane, CAST(sum(byte) % 4294967296 AS BIGINT) AS sum32, CAST(sum(word) % 4294967296 AS BIGINT) AS words32, CAST(sum(byte) AS BIGINT) AS sum64, bit_xor(byte) AS xor8, CAST(coalesce(sum(word) FILTER (even), 0) % 4294967296 AS BIGINT) AS even32, CAST(coalesce(sum(word) FILTER (NOT even), 0) % 4294967296 AS BIGINT) AS odd32, CAST(sum(byte * (row_id + 1)) % 4294967296 AS BIGINT) AS weighted32 FROM w GROUP BY plane")
    voted = f"{_FIXED}, {_PLAN_SQL}, net AS (SELECT plane, replica, row_id, bit_xor(mask) AS mask FROM plan GROUP BY ALL), cp AS (SELECT f.plane, r.r AS replica, f.row_id, f.byte AS clean, xor(f.byte, coalesce(net.mask, 0)) AS byte FROM f CROSS JOIN (SELECT unnest(range(3)) AS r) r LEFT JOIN net ON net.plane = f.plane AND net.replica = r.r AND net.row_id = f.row_id), v AS (SELECT plane, row_id, any_value(clean) AS clean, mode(byte) AS byte, min(byte) = max(byte) AS same FROM cp GROUP BY plane, row_id)"
    _add("vote_r3", lambda sp, sf: _voted(sp, sf).groupBy("plane").agg(F.sum("byte").alias("total"), F.count_if("agreed").alias("agreed")), f"{voted} SELECT plane, CAST(sum(byte) AS BIGINT) AS total, count(*) AS agreed FROM v GROUP BY plane")
    _add("inject_r1_sum", lambda sp, sf: R.encoded_sum(R.inject(R.replicate(f := _fixed(sp, sf), [1] * 8), _plan(f).where("replica = 0"))).select(F.col("total").cast("long").alias("total")), f"{voted} SELECT CAST(sum(CAST(byte AS HUGEINT) * CAST(pow(256, 7 - plane) AS HUGEINT)) AS BIGINT) AS total FROM cp WHERE replica = 0")
    _add("exposure", lambda sp, sf: R.exposure(_plan(_fixed(sp, sf))), f"{_FIXED}, {_PLAN_SQL}, net AS (SELECT plane, replica, row_id, bit_xor(mask) AS mask FROM plan GROUP BY ALL) SELECT (SELECT count(*) FROM plan) AS events, (SELECT CAST(sum(bit_count(mask)) AS BIGINT) FROM plan) AS bit_flips, (SELECT count(DISTINCT plane) FROM plan) AS planes, (SELECT count(DISTINCT row_id // 4096) FROM plan) AS segments, count(*) AS bytes, count(*) FILTER (mask = 0) AS cancelled, CAST(coalesce(sum(pow(2.0, 8 * (7 - plane))) FILTER (mask <> 0), 0) AS DOUBLE) AS impact FROM net")
    _add("certified_bound", lambda sp, sf: R.certified_bound(_plan(_fixed(sp, sf)).select("plane").distinct(), 1000).select(F.col("bound").cast("long").alias("bound")), f"{_FIXED}, {_PLAN_SQL} SELECT CAST(sum(255 * 1000 * CAST(pow(256, 7 - plane) AS HUGEINT)) AS BIGINT) AS bound FROM (SELECT DISTINCT plane FROM plan)")
    _add("repair_status", lambda sp, sf: R.repair(R.inject(R.replicate(f := _fixed(sp, sf), [3] * 8), _plan(f)), R.crc32_units(f)).groupBy("status").agg(F.count("*").alias("units")))
    _add("crc32c_units", lambda sp, sf: R.crc32c_units(_fixed(sp, sf)))
    _add("ordered_digest_units", lambda sp, sf: R.ordered_digest_units(_fixed(sp, sf)))
    cells = R.grid([1e-9, 1e-7, 1e-5, 1e-4], list(range(10)))

    def campaign(sp: SparkSession, sf: str) -> DataFrame:
        return R.campaign(sp, R.fixed_codes(raw(sp, sf)), raw(sp, sf).count(), cells)

    _add("campaign", campaign)
    _add("campaign_summary", lambda sp, sf: campaign(sp, sf).groupBy("policy", "outcome").agg(F.count("*").alias("cells"), F.avg(F.col("contains_truth").cast("int")).alias("contained")))


#: Events read as a table of runs, in both dialects.
_RUNS = [
    "event_id AS run_id", "event_type AS dataset", "CAST(user_id % 4 + 1 AS INT) AS k", "value AS threshold", "CAST(event_id % 100 AS DOUBLE) / 100 AS selectivity", "CAST(event_id % 50 + 1 AS DOUBLE) AS seconds",
    "CASE WHEN event_id % 3 = 0 THEN 's50' ELSE 's10' END AS selectivity_label", "CASE WHEN event_id % 2 = 0 THEN 'fused' ELSE 'raw' END AS kernel",
]
_R = f"WITH runs AS (SELECT {', '.join(_RUNS)} FROM events)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_RUNS)


def _register_reports() -> None:
    _add("report_headline", lambda sp, sf: _runs(sp, sf).groupBy("dataset", reports.percent_bucket(F.col("selectivity")).alias("percent")).agg(F.count("*").alias("runs"), F.min("seconds").alias("best")),
         f"{_R} SELECT dataset, CASE WHEN selectivity < 0.15 THEN 10 WHEN selectivity < 0.55 THEN 50 ELSE 90 END AS percent, count(*) AS runs, min(seconds) AS best FROM runs GROUP BY ALL")

    def throughput(sp: SparkSession, sf: str) -> DataFrame:
        runs = _runs(sp, sf).withColumn("artifact", F.concat(F.lit("p"), F.col("run_id") % 3))
        best = runs.groupBy("dataset", "artifact").agg((F.max("run_id") % 5 + 1).cast("int").alias("k_star"))
        speed = runs.groupBy("dataset", "artifact", "k").agg(F.avg("seconds").alias("seconds"))
        return reports.with_throughput(best, speed).select("dataset", reports.precision_power(F.col("artifact")).alias("power"), "k_star", F.round("seconds", 6).alias("seconds"))

    _add("report_k_star_throughput", throughput, f"""{_R}, r AS (SELECT *, run_id % 3 AS power FROM runs), b AS (SELECT dataset, power, CAST(max(run_id) % 5 + 1 AS INT) AS k_star FROM r GROUP BY ALL),
 s AS (SELECT dataset, power, k, avg(seconds) AS seconds FROM r GROUP BY ALL) SELECT b.dataset, CAST(b.power AS INT) AS power, k_star, round(seconds, 6) AS seconds FROM b LEFT JOIN s ON b.dataset = s.dataset AND b.power = s.power AND k_star = k""")  # fmt: skip
    _add("report_match_reference", lambda sp, sf: reports.match_reference((r := _runs(sp, sf)).where("run_id % 2 = 1"), r.where("run_id % 2 = 0").withColumnRenamed("run_id", "ref_id").withColumn("selectivity", F.col("selectivity") * 100)),
         f"""{_R}, p AS (SELECT a.run_id, b.run_id AS ref_id, abs(b.threshold - a.threshold) AS away, CASE WHEN b.selectivity * 100 > 1 THEN b.selectivity * 100 / 100 ELSE b.selectivity * 100 END AS s, a.selectivity AS t
 FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.k = b.k AND a.run_id % 2 = 1 AND b.run_id % 2 = 0 AND abs(b.threshold - a.threshold) <= greatest(1e-12, greatest(abs(a.threshold), abs(b.threshold)) * 1e-6)),
 f AS (SELECT *, CASE WHEN abs(1 - s - t) <= 0.05 THEN abs(1 - s - t) ELSE abs(s - t) END AS far FROM p), o AS (SELECT *, far > 0.05 AS by_threshold_only FROM f)
 SELECT run_id, ref_id, by_threshold_only FROM o QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY by_threshold_only, CASE WHEN by_threshold_only THEN away ELSE far END, ref_id) = 1""")  # fmt: skip
    _add("report_native_speedup", lambda sp, sf: reports.with_native((r := _runs(sp, sf)).where("run_id % 2 = 1"), r.where("run_id % 3 = 0")).select("run_id", "native_seconds", F.round("native_speedup", 9).alias("native_speedup")),
         f"""{_R}, n AS (SELECT * FROM runs WHERE run_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY dataset, selectivity, k ORDER BY run_id) = 1)
 SELECT a.run_id, n.seconds AS native_seconds, round(a.seconds / n.seconds, 9) AS native_speedup FROM runs a JOIN n USING (dataset, selectivity, k) WHERE a.run_id % 2 = 1""")  # fmt: skip
    _add("report_replace_runs", lambda sp, sf: reports.replace_runs((r := _runs(sp, sf)).select("run_id", "dataset"), r.where("dataset = 'click' AND k = 1").select("run_id", "dataset", "k")),
         f"{_R} SELECT run_id, dataset, CAST(NULL AS INT) AS k FROM runs WHERE dataset NOT IN (SELECT dataset FROM runs WHERE dataset = 'click' AND k = 1) UNION ALL SELECT run_id, dataset, k FROM runs WHERE dataset = 'click' AND k = 1")

    def traffic(sp: SparkSession, sf: str) -> DataFrame:
        size = F.concat(F.col("run_id").cast("string"), F.when(F.col("k") == 1, " Gbyte").otherwise(" Mbyte"))
        runs = _runs(sp, sf).where("run_id > 0").withColumn("dram", reports.megabytes(size))
        one = runs.groupBy("dataset", F.when(F.col("k") == 4, "raw").otherwise(F.col("k").cast("string")).alias("k")).agg(F.sum("dram").alias("dram"), F.sum("seconds").alias("seconds"))
        return reports.ratios_to_raw(one, ("dram", "seconds")).select("dataset", "k", "metric", *(F.round(c, 9).alias(c) for c in ("value", "ratio_to_raw", "reduction")))

    _add("report_traffic", traffic, f"""{_R}, r AS (SELECT dataset, CASE WHEN k = 4 THEN 'raw' ELSE CAST(k AS VARCHAR) END AS k, sum(run_id * CASE WHEN k = 1 THEN 1024.0 ELSE 1.0 END)::DOUBLE AS dram, sum(seconds) AS seconds FROM runs WHERE run_id > 0 GROUP BY ALL),
 l AS (SELECT dataset, k, 'dram' AS metric, dram AS value FROM r UNION ALL SELECT dataset, k, 'seconds', seconds FROM r)
 SELECT l.dataset, l.k, l.metric, round(l.value, 9) AS value, round(l.value / w.value, 9) AS ratio_to_raw, round(w.value / l.value, 9) AS reduction FROM l JOIN l w ON l.dataset = w.dataset AND l.metric = w.metric AND w.k = 'raw'""")  # fmt: skip
    _add("report_break_even", lambda sp, sf: reports.break_even(_runs(sp, sf).withColumn("dram_ratio", F.col("selectivity"))).select("run_id", "policy_region", F.round("dram_reduction", 9).alias("dram_reduction")),
         f"{_R} SELECT run_id, CASE WHEN k >= 3 THEN 'fallback' ELSE 'dispatch_window' END AS policy_region, round(1 / nullif(selectivity, 0), 9) AS dram_reduction FROM runs WHERE selectivity_label = 's50' AND kernel = 'fused'")
    _add("layout_summary", lambda sp, sf: reports.layout_summary(planes(sp, sf).meta).withColumns({c: F.round(c, 9) for c in ("planes_mean", "bytes_per_row")}),
         f"""{_BASE}, q AS (SELECT row_count, CAST(ceil(fl / 8.0) AS BIGINT) AS p FROM m) SELECT count(*) AS segments, CAST(sum(row_count) AS BIGINT) AS "rows", min(p) AS planes_min, max(p) AS planes_max, round(avg(p), 9) AS planes_mean, round(sum(p * row_count) / sum(row_count), 9) AS bytes_per_row FROM q""")


_register()
_register_reports()


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _ALL.items() if s}
