"""Registered queries of interchange, allocation, read paths, scenarios and gates, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigplane.functions import codec
from sigplane.operators import gates, paths, scenarios
from sigplane.operators import reliability as R
from sigplane.plans import queries as Q
from sigplane.sources import interchange as I

_add, raw, planes = Q._add, Q.raw, Q.planes
SCALE, SEGMENT, THRESHOLD = Q.SCALE, Q.SEGMENT, Q.THRESHOLD
SEEDS, RATES = [0, 1, 2], [1e-4, 1e-2]


def _container(sp: SparkSession, sf: str) -> str:
    path = I.scratch(sp, "values.buff64")
    I.write_container(planes(sp, sf), path)
    return path


def _plane_files(sp: SparkSession, sf: str) -> DataFrame:
    folder = I.scratch(sp, "planes")
    I.write_plane_files(planes(sp, sf), folder)
    return I.read_plane_files(sp, folder, Q.PLANES)


def _segment_csv(sp: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(sp, "segments.csv")
    I.write_segment_csv(planes(sp, sf), path)
    back = I.read_segment_csv(sp, path)
    return back.select("segment_index", "row_offset", "row_count", "active_plane_count", I.base_of_hex("integer_base_hex").alias("base"), "segment_base", "raw_fractional_bits", "plane_basis_0", "plane_basis_1")


def _results(sp: SparkSession, sf: str, kind: str) -> DataFrame:
    path = I.scratch(sp, f"results-{kind}")
    sp.createDataFrame([], "k long, n long").write.mode("overwrite").format("json").save(path)
    for k in (1, 2):
        I.append_results(raw(sp, sf).agg(F.count_if(F.col("v") > 100.0 * k).alias("n")).select(F.lit(k).cast("long").alias("k"), "n"), path, kind)
    reader = sp.read.schema("k long, n long").option("pathGlobFilter", f"*.{kind}")
    return reader.json(path) if kind == "json" else reader.option("header", True).csv(path)


def _written_layout(sp: SparkSession, sf: str):
    from sigplane.plans import layout

    path = I.scratch(sp, f"layout-{abs(hash(sf))}")
    layout.write(planes(sp, sf), path, "events", sf)
    return layout.read(sp, path)


def _register_sources() -> None:
    _add("container_header", lambda sp, sf: I.read_header(sp, _container(sp, sf)), f"SELECT count(*) AS total_values, CAST({SEGMENT} AS BIGINT) AS segment_size, count(DISTINCT event_id // {SEGMENT}) AS segment_count FROM events")
    _add("container_decode", lambda sp, sf: I.read_container(sp, _container(sp, sf)).select("row_id", "seg", "base", "fl", (F.col("code") / F.lit(SCALE)).alias("x")), f"{Q._BASE} SELECT row_id - (SELECT min(event_id) FROM events) AS row_id, dense_rank() OVER (ORDER BY seg) - 1 AS seg, base, fl, code / {SCALE} AS x FROM e")
    _add("plane_files", _plane_files, f"{Q._BASE} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, " + ", ".join(f"coalesce({Q._byte(i)}, 0) AS b{i}" for i in range(Q.PLANES)) + " FROM e")
    basis = lambda i: f"CASE WHEN fl > {8 * i} THEN pow(2.0, greatest(fl - {8 * (i + 1)}, 0) - 15) ELSE 0.0 END AS plane_basis_{i}"
    _add("segment_csv", _segment_csv, f"{Q._BASE} SELECT seg AS segment_index, row_offset, row_count, CAST(ceil(fl / 8.0) AS BIGINT) AS active_plane_count, base, base / {SCALE} AS segment_base, CAST(15 AS BIGINT) AS raw_fractional_bits, {basis(0)}, {basis(1)} FROM m")
    for kind in ("json", "csv"):
        _add(f"result_sink_{kind}", lambda sp, sf, k=kind: _results(sp, sf, k), "SELECT CAST(k AS BIGINT) AS k, count(*) FILTER (value > 100.0 * k) AS n FROM events, (SELECT unnest([1, 2]) AS k) GROUP BY k")
    _add("written_layout_checks", lambda sp, sf: Q.layout.contract(_written_layout(sp, sf)), Q.oracle_sql()["artifact_checks"])
    _add("written_filter_sum_k2", lambda sp, sf: Q.A.filter_sum(_written_layout(sp, sf), THRESHOLD, 2), Q.oracle_sql()["filter_sum_k2"])
    _add("row_state_sink", lambda sp, sf: _states(sp, sf), Q.oracle_sql()["row_states_k2"])
    _add("contiguous_sum", lambda sp, sf: Q.layout.codes(raw(sp, sf), Q.PRECISION, SEGMENT).agg(F.sum("code").alias("total")), f"{Q._BASE} SELECT CAST(sum(code) AS BIGINT) AS total FROM enc")
    # Reading some lanes, or through an index, is what these two measure.
    _add("masked_read", lambda sp, sf: raw(sp, sf).where("row_id % 32 < 8").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("decimal(28,8)")).cast("double"), 4).alias("total")), "SELECT count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE), 4) AS total FROM events WHERE event_id % 32 < 8")
    _add("gather_read", lambda sp, sf: raw(sp, sf).join((r := raw(sp, sf)).select((F.col("row_id") * 1103 % F.lit(max(r.count(), 1))).alias("row_id")), "row_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("decimal(28,8)")).cast("double"), 4).alias("total")), "SELECT count(*) AS n, round(CAST(sum(CAST(a.value AS DECIMAL(28,8))) AS DOUBLE), 4) AS total FROM events a JOIN (SELECT event_id * 1103 % (SELECT count(*) FROM events) AS i FROM events) b ON a.event_id = b.i")
    _add("fractional_bits", lambda sp, sf: raw(sp, sf).select("row_id", codec.fractional_bits(F.col("v")).alias("bits")), "SELECT event_id AS row_id, CAST(list_min(list_filter(range(0, 1075), lambda f: value * pow(2.0, f) = floor(value * pow(2.0, f)))) AS BIGINT) AS bits FROM events")
    _add("hex_and_json", lambda sp, sf: sp.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.hex("c_name").alias("hex"), F.unhex(F.hex("c_name")).cast("string").alias("back"), F.to_json(F.struct("c_name")).alias("json")), "SELECT c_custkey, hex(c_name) AS hex, c_name AS back, CAST(to_json({'c_name': c_name}) AS VARCHAR) AS json FROM customer")
    code = lambda f: f"TRY_CAST(floor(value * {2.0**f!r}) AS BIGINT)"
    parts = " UNION ALL ".join(f"SELECT CAST({p} AS BIGINT) AS precision, event_id // {SEGMENT} AS seg, count(*) AS n, max({code(f)}) - min({code(f)}) AS span, max(value) * {2.0**f!r} <= 9223372036854775807.0 AS fits FROM events GROUP BY 2" for p, f in codec.FRACTION_BITS.items())
    _add("precision_probe", lambda sp, sf: I.precision_probe(raw(sp, sf), SEGMENT).withColumn("bytes_per_row", F.round("bytes_per_row", 9)),
         f"WITH s AS ({parts}), q AS (SELECT *, CAST(ceil((CASE WHEN span = 0 THEN 0 ELSE length(bin(span)) END) / 8.0) AS BIGINT) AS k FROM s), g AS (SELECT precision, max(k) AS planes, sum(k * n) / sum(n) AS b, bool_and(fits) AS fits FROM q GROUP BY precision) SELECT precision, planes, round(b, 9) AS bytes_per_row, fits, precision IS NOT DISTINCT FROM (SELECT max(precision) FROM g WHERE fits AND planes < 8 AND b < 8) AS chosen FROM g")
    _add("segment_trace", lambda sp, sf: Q.P.states(planes(sp, sf), THRESHOLD, 2, "v").where("seg = 1").select("row_id", "v", "lo", "hi", F.col("state").cast("long").alias("state")), f"{Q._cut(2)} SELECT row_id, v, lo, hi, CAST(CASE WHEN lo > t THEN 1 WHEN hi <= t THEN 0 ELSE 2 END AS BIGINT) AS state FROM b WHERE seg = 1")


def _states(sp: SparkSession, sf: str) -> DataFrame:
    path = I.scratch(sp, "states")
    Q.P.states(planes(sp, sf), THRESHOLD, 2).select("row_id", F.col("state").cast("byte").alias("state")).write.mode("overwrite").parquet(path)
    return sp.read.parquet(path).withColumn("state", F.col("state").cast("long"))


def _register_reliability() -> None:
    n = "(SELECT count(*) FROM events)"
    units = f"u AS (SELECT p AS plane, unit, least(256, {n} - unit * 256) AS size FROM (SELECT unnest(range(8)) AS p), (SELECT unnest(range(CAST(ceil({n} / 256.0) AS BIGINT))) AS unit))"

    def allocated(sp: SparkSession, sf: str, kind: str, budget: int) -> DataFrame:
        rows = raw(sp, sf).count()
        each = sp.range(-(-rows // 256)).withColumnRenamed("id", "unit").crossJoin(sp.range(8).withColumnRenamed("id", "plane"))  # numbers only
        return R.allocation(each, kind, budget, 8, rows, 256)

    def audit(sp: SparkSession, sf: str) -> DataFrame:
        out, rows = None, raw(sp, sf).count()
        for kind in R.ALLOCATIONS:
            for budget in (1, 2, 3, 4):
                one = R.coverage(allocated(sp, sf, kind, budget), rows, 256).select(F.lit(kind).alias("kind"), F.lit(budget).cast("long").alias("budget"), "*")
                out = one if out is None else out.unionByName(one)
        return out

    rule = {
        "graded": "1 + CASE WHEN plane < 2 THEN greatest(least(b - 2 * plane, 2), 0) ELSE 0 END",
        "uniform_detect": f"CASE WHEN unit * 8 + plane < b * {n} // 256 THEN 2 ELSE 1 END",
        "uniform_repair": f"CASE WHEN unit * 8 + plane < b * {n} // 512 THEN 3 ELSE 1 END",
    }
    each = " UNION ALL ".join(f"SELECT '{k}' AS kind, b, size, {x} AS r FROM u, (SELECT unnest([1, 2, 3, 4]) AS b)" for k, x in rule.items())
    _add("storage_audit", audit, f"WITH {units}, a AS ({each}) SELECT kind, CAST(b AS BIGINT) AS budget, CAST(coalesce(sum(size) FILTER (r = 3), 0) AS BIGINT) AS repair_bytes, CAST(coalesce(sum(size) FILTER (r = 2), 0) AS BIGINT) AS detect_bytes, CAST(coalesce(sum(size) FILTER (r = 1), 0) AS BIGINT) AS fallback_bytes, CAST(sum((r - 1) * size) AS BIGINT) AS extra_bytes FROM a GROUP BY kind, b")
    _add("allocation_repair_b3", lambda sp, sf: allocated(sp, sf, "uniform_repair", 3), f"WITH {units} SELECT plane, unit, CAST({rule['uniform_repair'].replace('b *', '3 *')} AS BIGINT) AS replicas FROM u")

    # Read paths over columns of voted planes
    def faulted(sp: SparkSession, sf: str, copies: list[int]) -> DataFrame:
        wide = paths.columns(raw(sp, sf))
        plan = Q._plan(R.fixed_planes(raw(sp, sf)))
        fits = F.get(F.array(*map(F.lit, copies)), F.col("plane").cast("int")) > F.col("replica")
        return paths.with_masks(wide, plan.where(fits), copies)

    three = [3] * 8
    net = f"{Q._FIXED}, {Q._PLAN_SQL}, net AS (SELECT plane, replica, row_id, bit_xor(mask) AS mask FROM plan GROUP BY ALL), cp AS (SELECT f.plane, r.r AS replica, f.row_id, f.byte AS clean, xor(f.byte, coalesce(net.mask, 0)) AS byte FROM f CROSS JOIN (SELECT unnest(range(3)) AS r) r LEFT JOIN net ON net.plane = f.plane AND net.replica = r.r AND net.row_id = f.row_id), v AS (SELECT plane, row_id, any_value(clean) AS clean, min(byte) FILTER (replica = 0) AS first, mode(byte) AS voted FROM cp GROUP BY plane, row_id)"

    def answer(column: str, k: int) -> str:
        shift = 8 * (8 - k)
        cut = (int(THRESHOLD * 100) >> shift) << shift
        return f"(SELECT row_id, CAST(sum({column} << CAST(8 * (7 - plane) AS INTEGER)) AS BIGINT) AS x, sum({column}) AS s FROM v WHERE plane < {k} GROUP BY row_id) WHERE true", f"x > {cut}"

    def one(name: str, column: str, k: int, digest: bool) -> str:
        source, hit = answer(column, k)
        return f"SELECT '{name}' AS path, count(*) FILTER ({hit}) AS n, CAST(sum(x) FILTER ({hit}) AS DOUBLE) AS total, {'CAST(sum(s) % 4294967296 AS BIGINT)' if digest else 'CAST(NULL AS BIGINT)'} AS digest FROM {source}"

    raw_path = f"SELECT 'raw' AS path, count(*) FILTER (value > {THRESHOLD}) AS n, CAST(sum(CAST(value * 100 AS DECIMAL(38,6))) FILTER (value > {THRESHOLD}) AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS digest FROM events"
    for k in (7, 8):
        sql = " UNION ALL ".join([one("baseline", "first", k, False), one("digest", "first", k, True), one("vote", "voted", k, False), one("vote_digest", "voted", k, True), raw_path])
        _add(f"read_paths_k{k}", lambda sp, sf, k=k: paths.all_paths(faulted(sp, sf, three), three, THRESHOLD, k).withColumn("total", F.round("total", 2)), f"{net} SELECT path, n, round(total, 2) AS total, digest FROM ({sql})")

    def three_answers(sp: SparkSession, sf: str) -> DataFrame:
        clean = paths.with_masks(paths.columns(raw(sp, sf)), Q._plan(R.fixed_planes(raw(sp, sf))).where("false"), three)
        got = paths.three_answers(clean, faulted(sp, sf, [1] * 6 + [1, 3]), [1] * 6 + [1, 3], THRESHOLD, [7, 8])
        return got.select("k", *(F.round(c, 6).alias(c) for c in ("truth", "clean_k", "faulted_k", "error_to_truth", "error_to_clean")))

    pieces = []
    for k in (7, 8):
        source, hit = answer("CASE WHEN plane = 7 THEN voted ELSE first END", k)
        clean_source, _ = answer("clean", k)
        pieces.append(f"SELECT CAST({k} AS BIGINT) AS k, (SELECT total FROM ({raw_path})) AS truth, (SELECT CAST(sum(x) FILTER ({hit}) AS DOUBLE) FROM {clean_source}) AS clean_k, (SELECT CAST(sum(x) FILTER ({hit}) AS DOUBLE) FROM {source}) AS faulted_k")
    _add("three_answers", three_answers, f"{net}, t AS ({' UNION ALL '.join(pieces)}) SELECT k, round(truth, 6) AS truth, round(clean_k, 6) AS clean_k, round(faulted_k, 6) AS faulted_k, round(abs(faulted_k - truth) / CASE WHEN abs(truth) > 1 THEN abs(truth) ELSE 1 END, 6) AS error_to_truth, round(abs(faulted_k - clean_k) / CASE WHEN abs(clean_k) > 1 THEN abs(clean_k) ELSE 1 END, 6) AS error_to_clean FROM t")
    for r, rule_sql in ((2, "first"), (5, "CASE WHEN plane < 8 THEN voted END")):
        _add(f"eager_vote_r{r}", lambda sp, sf, r=r: faulted(sp, sf, three).select("row_id", *(paths.eager([paths.copy(p, min(j, 2)) if j < 3 else F.col(f"b{p}") for j in range(r)]).alias(f"x{p}") for p in (6, 7))), f"{net} SELECT row_id, max(x) FILTER (plane = 6) AS x6, max(x) FILTER (plane = 7) AS x7 FROM (SELECT row_id, plane, {'first' if r == 2 else 'clean'} AS x FROM v WHERE plane >= 6) GROUP BY row_id")
    _add("structure_bounds", lambda sp, sf: paths.bounds(R.fixed_planes(raw(sp, sf))), f"{Q._FIXED} SELECT plane, count(*) FILTER (byte <> 0) AS active, 255.0 * pow(256.0, 7 - plane) * count(*) AS worst, 255.0 * pow(256.0, 7 - plane) * count(*) FILTER (byte <> 0) AS aware FROM f GROUP BY plane")
    _add("damage", lambda sp, sf: paths.damage(f := R.fixed_planes(raw(sp, sf)), R.inject(R.replicate(f, [1] * 8), Q._plan(f).where("replica = 0")).drop("replica")).select(*(F.col(c).cast("long").alias(c) for c in ("clean", "delivered", "signed", "absolute")), F.round("normalised", 9).alias("normalised")),
         f"{net}, s AS (SELECT CAST(sum(CAST(clean AS HUGEINT) << CAST(8 * (7 - plane) AS INTEGER)) AS BIGINT) AS clean, CAST(sum(CAST(first AS HUGEINT) << CAST(8 * (7 - plane) AS INTEGER)) AS BIGINT) AS delivered FROM v) SELECT clean, delivered, delivered - clean AS signed, abs(delivered - clean) AS absolute, round(abs(delivered - clean) / CAST(greatest(abs(clean), 1) AS DOUBLE), 9) AS normalised FROM s")
    _add("duplicate_reads", lambda sp, sf: gates.duplicate_reads(f := R.fixed_planes(raw(sp, sf)), R.inject(R.replicate(f, [1] * 8), Q._plan(f).where("replica = 0")).drop("replica")), f"{net} SELECT plane, count(*) FILTER (clean <> first) AS mismatches FROM v GROUP BY plane")


def _register_scenarios() -> None:
    policy = ", ".join(f"('{n}', {p}, {r})" for n, rs in scenarios.POLICIES.items() for p, r in enumerate(rs))
    known = ", ".join(f"({i}, '{n}', {p}, {ln}, {st}, {m}, '{h}')" for i, n, p, ln, st, m, h in scenarios.SCENARIOS)
    n = "(SELECT count(*) FROM events)"
    draw = lambda x, salt, size: f"(({x} + {salt}) * 48271 % 2147483647) % ({size})"
    x = "(seed * 1000 + id + plane * 77)"
    plan = f"""pol(policy, plane, r) AS (VALUES {policy}), sc(id, scenario, plane, len, stride, mask, hits) AS (VALUES {known}),
k AS (SELECT sc.*, seed, policy, r, {draw(x, 11, f"CASE WHEN stride = 1 THEN greatest({n} - len + 1, 1) ELSE least(stride, {n}) END").replace('plane', 'sc.plane')} AS low, {draw(x, 23, 'r').replace('plane', 'sc.plane')} AS one
      FROM sc JOIN pol ON sc.plane = pol.plane, (SELECT unnest({SEEDS}) AS seed)),
h AS (SELECT *, unnest(CASE WHEN hits = 'one' OR hits = 'domain' AND policy <> 'naive_same_region_replication_r3' THEN [CAST(one AS BIGINT)] ELSE range(r) END) AS replica FROM k),
p AS (SELECT policy, scenario, CAST(seed AS BIGINT) AS seed, CAST(plane AS BIGINT) AS plane, CAST(replica AS BIGINT) AS replica, CAST(low + i * stride AS BIGINT) AS row_id, CAST(mask AS BIGINT) AS mask, r
      FROM (SELECT *, unnest(range(len)) AS i FROM h) WHERE low + i * stride < {n})"""

    def made(sp: SparkSession, sf: str, controls: bool = False) -> DataFrame:
        return scenarios.scenario_plan(sp, raw(sp, sf).count(), SEEDS, controls)

    def found(sp: SparkSession, sf: str, controls: bool = False) -> DataFrame:
        return scenarios.outcomes(made(sp, sf, controls), R.fixed_planes(raw(sp, sf)), raw(sp, sf).count())

    _add("scenario_plan", made, f"WITH {plan} SELECT policy, scenario, seed, plane, replica, row_id, mask FROM p")
    _add("scenario_summary", lambda sp, sf: scenarios.plan_summary(made(sp, sf), "policy", "scenario", "seed"), f"WITH {plan}, g AS (SELECT policy, scenario, seed, plane, count(*) AS entries, count(DISTINCT replica) AS hit, any_value(r) AS r FROM p GROUP BY ALL HAVING count(*) > 0) SELECT policy, scenario, seed, CAST(sum(entries) AS BIGINT) AS entries, count(*) AS planes_hit, CAST(sum(hit) AS BIGINT) AS replicas_hit, bool_or(plane = 0) AS high_significance_hit, max(hit / r) AS loss_correlation FROM g GROUP BY ALL")
    fixed = Q._FIXED.replace("WITH ", "", 1)
    outcome = f"""WITH {plan}, {fixed}, m AS (SELECT policy, scenario, seed, plane, replica, row_id, bit_xor(mask) AS mask FROM p GROUP BY ALL),
hit AS (SELECT DISTINCT m.policy, scenario, seed, m.plane, m.row_id, byte FROM m JOIN f ON m.plane = f.plane AND m.row_id = f.row_id),
cp AS (SELECT hit.*, c.j, xor(hit.byte, coalesce(m.mask, 0)) AS now FROM (SELECT hit.*, unnest(range(pol.r)) AS j FROM hit JOIN pol ON hit.policy = pol.policy AND hit.plane = pol.plane) c JOIN hit USING (policy, scenario, seed, plane, row_id)
 LEFT JOIN m ON m.policy = c.policy AND m.scenario = c.scenario AND m.seed = c.seed AND m.plane = c.plane AND m.row_id = c.row_id AND m.replica = c.j),
vt AS (SELECT policy, scenario, seed, plane, row_id, byte, arg_max(now, cnt * 256 + now) AS voted FROM (SELECT policy, scenario, seed, plane, row_id, byte, now, count(*) AS cnt FROM cp GROUP BY ALL) GROUP BY policy, scenario, seed, plane, row_id, byte),
pp AS (SELECT policy, scenario, seed, plane, sum(voted - byte) % 4294967296 <> 0 AS differs, sum(voted - byte) * CAST(pow(256, 7 - plane) AS HUGEINT) AS off FROM vt GROUP BY policy, scenario, seed, plane),
oo AS (SELECT policy, scenario, seed, bool_or(differs) AS detected, coalesce(sum(255 * {n} * CAST(pow(256, 7 - plane) AS HUGEINT)) FILTER (differs), 0) AS width, sum(off) AS damage FROM pp GROUP BY policy, scenario, seed),
o AS (SELECT policy, scenario, seed, detected, CAST(width AS DOUBLE) AS bound_width, CAST(damage AS DOUBLE) AS damage, NOT detected OR abs(damage) * 2 <= width AS contains_truth,
 CASE WHEN NOT detected THEN 'vote_recovered' WHEN abs(damage) * 2 <= width THEN 'bounded_degraded' ELSE 'cert_bound_failure' END AS outcome FROM oo)"""
    _add("scenario_outcomes", lambda sp, sf: found(sp, sf).withColumns({c: F.col(c).cast("double") for c in ("bound_width", "damage")}), f"{outcome} SELECT * FROM o")
    _add("scenario_verdict", lambda sp, sf: scenarios.verdict(found(sp, sf)), f"{outcome} SELECT count(DISTINCT scenario) AS families, count(*) AS runs, count(*) FILTER (outcome = 'cert_bound_failure') AS bound_failures, count(*) FILTER (NOT contains_truth) AS truth_failures, count(*) FILTER (NOT detected AND damage <> 0) AS silent_wrong, CASE WHEN count(DISTINCT scenario) < 3 OR count(*) FILTER (outcome = 'cert_bound_failure') > 0 OR count(*) FILTER (NOT contains_truth) > 0 OR count(*) FILTER (NOT detected AND damage <> 0) > 0 THEN 'NEEDS_FIXES' ELSE 'SUPPORTED' END AS verdict FROM o")
    _add("control_outcomes", lambda sp, sf: found(sp, sf, True).groupBy("scenario", "outcome").agg(F.count("*").alias("runs")))
    mode = ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in scenarios.DIVERSITY.items())
    cells = f"SELECT * FROM (VALUES {mode}) AS d(mode, a, b), (SELECT unnest([0, 1, 2]) AS replica), (SELECT unnest({RATES}) AS rate), (SELECT unnest({SEEDS}) AS seed), (SELECT unnest(['cluster', 'temporal']) AS fault)"
    width, low = f"greatest(CAST(ceil(rate * {n}) AS BIGINT), 1)", draw("seed", 31, f"{n} - greatest(CAST(ceil(rate * {n}) AS BIGINT), 1) + 1")
    hits = f"SELECT fault, mode, CAST(rate AS DOUBLE) AS rate, CAST(seed AS BIGINT) AS seed, CAST(replica AS BIGINT) AS replica, CASE WHEN fault = 'cluster' THEN {low} < (a * replica + 1) * ({n} // 3) AND {low} + {width} > a * replica * ({n} // 3) ELSE b * replica = {draw('seed', 41, '3')} END AS hit FROM ({cells})"
    diverse = lambda sp, sf: scenarios.diversity_faults(sp, raw(sp, sf).count(), RATES, SEEDS)
    _add("diversity_faults", diverse, hits)
    t = R_T
    ci = f"avg(x) AS mean, CASE WHEN count(x) < 2 THEN 0.0 ELSE list_extract({t}, CAST(least(greatest(count(x) - 1, 1), 30) AS INTEGER)) * stddev_samp(x) / sqrt(count(x)) END AS half"
    _add("factor_criterion", lambda sp, sf: gates.factor_criterion(diverse(sp, sf).groupBy("fault", "mode", "rate", "seed").agg(F.avg((~F.col("hit")).cast("int")).alias("value"))).withColumns({c: F.round(c, 9) for c in ("good_low", "bad_high")}),
         f"WITH d AS ({hits}), r AS (SELECT fault, mode, rate, seed, avg(CASE WHEN hit THEN 0.0 ELSE 1.0 END) AS x FROM d GROUP BY ALL), g AS (SELECT fault, rate, (fault = 'cluster' AND mode IN ('D1', 'D3') OR fault = 'temporal' AND mode IN ('D2', 'D3')) AS good, {ci} FROM r GROUP BY ALL), a AS (SELECT a.fault, a.rate, a.mean - a.half AS l, b.mean + b.half AS h FROM g a JOIN g b ON a.fault = b.fault AND a.rate = b.rate AND a.good AND NOT b.good) SELECT fault, rate, round(l, 9) AS good_low, round(h, 9) AS bad_high, l > h AS passes FROM a")
    _add("skip_faults", lambda sp, sf: scenarios.skip_faults(raw(sp, sf), 0.01, 3, 7), "SELECT CAST(replica AS BIGINT) AS replica, event_id AS row_id FROM events, (SELECT unnest([0, 1, 2]) AS replica) WHERE ((event_id * 31 + replica * 17 + 7) * 48271 % 2147483647 * 69621 % 2147483647) % 1000000 < 10000")

    # Gates over events read as runs
    runs = "SELECT CASE WHEN event_id % 2 = 0 THEN 'graded' ELSE 'uniform' END AS policy, CASE WHEN event_id // 2 % 3 = 0 THEN 1e-7 WHEN event_id // 2 % 3 = 1 THEN 1e-6 ELSE 1e-3 END AS rate, event_id // 2 AS seed, value AS error FROM events"
    _add("paired_gate", lambda sp, sf: gates.paired_gate(sp.read.parquet(f"{sf}/events.parquet").selectExpr("CASE WHEN event_id % 2 = 0 THEN 'graded' ELSE 'uniform' END AS policy", "CASE WHEN event_id div 2 % 3 = 0 THEN 1e-7 WHEN event_id div 2 % 3 = 1 THEN 1e-6 ELSE 1e-3 END AS rate", "event_id div 2 AS seed", "value AS error"), "graded", "uniform").withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")}),
         f"WITH r AS ({runs}), d AS (SELECT a.rate, b.error - a.error AS x FROM r a JOIN r b ON a.policy = 'graded' AND b.policy = 'uniform' AND a.seed = b.seed AND a.rate = b.rate WHERE a.rate BETWEEN 1e-7 AND 1e-5), g AS (SELECT rate, count(x) AS n, {ci} FROM d GROUP BY rate) SELECT rate, n, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, mean - half > 0 AS wins FROM g")
    _add("timing_statistics", lambda sp, sf: (g := gates.timing(Q._runs(sp, sf), "seconds", "dataset")).select("dataset", *(F.round(c, 6).alias(c) for c in g.columns[1:])), f"{Q._R} SELECT dataset, " + ", ".join(f"round({x}, 6) AS {c}" for c, x in (("median", "quantile_cont(seconds, 0.5)"), ("p10", "quantile_cont(seconds, 0.1)"), ("p90", "quantile_cont(seconds, 0.9)"), ("mean", "avg(seconds)"), ("least", "min(seconds)"), ("most", "max(seconds)"), ("deviation", "stddev_pop(seconds)"))) + " FROM runs GROUP BY dataset")
    _add("drift_verdict", lambda sp, sf: _drift(sp, sf), f"WITH s AS (SELECT event_type, 100.0 * count(*) FILTER (floor(value) > {THRESHOLD}) / count(*) - 100.0 * count(*) FILTER (value > {THRESHOLD}) / count(*) AS drift FROM events GROUP BY event_type) SELECT event_type, round(drift, 9) AS drift, CASE WHEN abs(drift) <= 0.1 THEN 'acceptable' WHEN abs(drift) <= 1 THEN 'caution' ELSE 'catastrophic' END AS verdict FROM s")
    _add("index_thresholds", lambda sp, sf: gates.index_threshold(raw(sp, sf), [0.01, 0.1, 0.5, 0.9]), f"WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM events) SELECT CAST(s AS DOUBLE) AS selectivity, value AS threshold FROM o JOIN (SELECT unnest([0.01, 0.1, 0.5, 0.9]) AS s) ON i = CAST(floor({n} * (1.0 - CAST(s AS DOUBLE))) AS BIGINT)")
    _add("ordered_report", lambda sp, sf: Q._runs(sp, sf).groupBy("dataset", "k").agg(F.count("*").alias("runs")).orderBy("dataset", "k"), f"{Q._R} SELECT dataset, k, count(*) AS runs FROM runs GROUP BY ALL ORDER BY dataset, k")
    _add("campaign_metrics", lambda sp, sf: R.cell_metrics(Q._ALL["campaign"][0](sp, sf), "policy", "family"))
    _add("crc32_units", lambda sp, sf: R.crc32_units(R.fixed_planes(raw(sp, sf)), 256))


def _drift(sp: SparkSession, sf: str) -> DataFrame:
    events = sp.read.parquet(f"{sf}/events.parquet")
    share = lambda c: 100.0 * F.count_if(c > THRESHOLD) / F.count("*")
    a = events.groupBy("event_type").agg((share(F.floor("value")) - share(F.col("value"))).alias("drift"))
    return a.select("event_type", F.round("drift", 9).alias("drift"), gates.drift_verdict(F.col("drift")).alias("verdict"))


#: The quantiles that intervals use, as SQL.
R_T = "[" + ", ".join(map(repr, R.T_QUANTILES)) + "]"

_register_sources()
_register_reliability()
_register_scenarios()
