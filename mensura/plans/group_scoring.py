"""Catalogue: measurement algebra, gates, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measure
from ..operators import calibration, scoring
from .adapters import items, read, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


_ITEMS = ("v_base", "v_items")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


@query("""SELECT tier, kind, count(*) AS n, round(avg(CASE WHEN truth BETWEEN lo AND hi THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS coverage, round(median(hi - lo), 6) AS median_width,
 round(median(abs(value - truth)), 6) AS median_abs_err, avg(CASE WHEN truth BETWEEN lo AND hi THEN 1::DOUBLE ELSE 0::DOUBLE END) BETWEEN 0.85 AND 0.95 AS in_band FROM v_items GROUP BY ALL""", *_ITEMS)  # fmt: skip
def calibration_table(spark, d):
    return _rounded(scoring.calibration_table(items(spark, d)), "coverage", "median_width", "median_abs_err")


@query("""SELECT tier, n, within, round(coverage, 6) AS coverage, round(median_abs_err, 6) AS median_abs_err, within = n AND coverage >= 0.85 AS passed,
 round(least(CAST(within AS DOUBLE) / n, coverage / 0.85::DOUBLE, 1::DOUBLE), 6) AS score FROM (
 SELECT tier, count(*) AS n, count(*) FILTER (abs(value - truth) <= CASE tier WHEN 'lidar' THEN greatest(0.02::DOUBLE, 0.01::DOUBLE * truth) WHEN 'video' THEN 0.03::DOUBLE * truth ELSE 0.08::DOUBLE * truth END) AS within,
 avg(CASE WHEN truth BETWEEN lo AND hi THEN 1::DOUBLE ELSE 0::DOUBLE END) AS coverage, median(abs(value - truth)) AS median_abs_err FROM v_items WHERE kind = 'wall_length' GROUP BY tier)""", *_ITEMS)  # fmt: skip
def wall_gate(spark, d):
    return _rounded(scoring.wall_gate(items(spark, d)), "coverage", "median_abs_err", "score")


@query("""SELECT tier, n, within, round(bias, 6) AS bias, round(spread, 6) AS spread, round(largest, 6) AS largest, within = n AS passed, round(CAST(within AS DOUBLE) / n, 6) AS score FROM (
 SELECT tier, count(*) AS n, count(*) FILTER (abs(value - truth) <= 0.015::DOUBLE + 1e-9) AS within, avg(value - truth) AS bias, stddev_pop(value - truth) AS spread, max(abs(value - truth)) AS largest
 FROM v_items WHERE kind = 'ceiling_height' GROUP BY tier)""", *_ITEMS)  # fmt: skip
def ceiling_gate(spark, d):
    return _rounded(scoring.ceiling_gate(items(spark, d)), "bias", "spread", "largest", "score")


def _stitched(spark, d):
    return read(spark, d, "nation").selectExpr("n_nationkey AS capture", "n_nationkey % 4 + 2 AS rooms_gt", "n_nationkey % 5 + 2 AS rooms_pred", "n_nationkey % 3 AS n_overlaps", "n_nationkey % 6 AS adjacency_gt", "n_nationkey % 7 AS adjacency_found")


@query("""SELECT *, score = 1 AS passed FROM (SELECT *, (CAST(rooms_pred >= rooms_gt AS INT) + CAST(n_overlaps = 0 AS INT) + CAST(adjacency_found >= adjacency_gt AS INT)) / 3::DOUBLE AS score FROM (
 SELECT n_nationkey AS capture, n_nationkey % 4 + 2 AS rooms_gt, n_nationkey % 5 + 2 AS rooms_pred, n_nationkey % 3 AS n_overlaps, n_nationkey % 6 AS adjacency_gt, n_nationkey % 7 AS adjacency_found FROM nation))""")  # fmt: skip
def photo_stitch_gate(spark, d):
    return scoring.photo_stitch_gate(_stitched(spark, d))


_PER_REF = "SELECT room, ref, kind, max(value) AS value FROM v_items WHERE capture = {} AND kind IN ('wall_length', 'ceiling_height') GROUP BY ALL"


@query(f"""SELECT room, ref, kind, a, b, round(a - b, 6) AS diff, round(tolerance, 6) AS tolerance, abs(a - b) <= tolerance AS ok FROM (SELECT x.room, x.ref, x.kind, x.value AS a, y.value AS b,
 CASE WHEN x.kind = 'ceiling_height' THEN 0.01::DOUBLE ELSE greatest(0.01::DOUBLE, 0.005::DOUBLE * (x.value + y.value) / 2) END AS tolerance FROM ({_PER_REF.format(1)}) x JOIN ({_PER_REF.format(2)}) y USING (room, ref, kind))""", *_ITEMS)  # fmt: skip
def repeatability(spark, d):
    one = lambda k: items(spark, d).where((F.col("capture") == k) & F.col("kind").isin("wall_length", "ceiling_height")).groupBy("room", "ref", "kind").agg(F.max("value").alias("value"))
    return _rounded(scoring.repeatability(one(1), one(2)), "diff", "tolerance")


@query("""SELECT capture, e AS upper_median, n FROM (SELECT capture, round(abs(value - truth), 6) AS e, count(*) OVER (PARTITION BY capture) AS n, row_number() OVER (PARTITION BY capture ORDER BY round(abs(value - truth), 6)) AS k
 FROM v_items WHERE kind = 'wall_length') WHERE k = n // 2 + 1""", *_ITEMS)  # fmt: skip
def drift_ablation_upper_median(spark, d):
    walls = items(spark, d).where("kind = 'wall_length'").select("capture", F.round(F.abs(F.col("value") - F.col("truth")), 6).alias("e"))
    return scoring.upper_median(walls, "capture", "e")


_DIMS = "SELECT room, ref AS dimension, max({}) AS {} FROM v_items WHERE capture = {} GROUP BY ALL"


@query(f"""SELECT *, CASE WHEN our_value IS NULL THEN 'missing' WHEN our_err <= 0.01 AND app_err <= 0.01 THEN 'tie' WHEN our_err <= app_err THEN 'beat' ELSE 'loss' END AS verdict FROM (
 SELECT room, dimension, app_value, truth, our_value, abs(app_value - truth) AS app_err, abs(our_value - truth) AS our_err FROM ({_DIMS.format('value', 'app_value', 1)}) JOIN ({_DIMS.format('truth', 'truth', 1)}) USING (room, dimension)
 LEFT JOIN ({_DIMS.format('value', 'our_value', 2)}) USING (room, dimension))""", *_ITEMS)  # fmt: skip
def head_to_head(spark, d):
    dims = lambda c, name, k: items(spark, d).where(F.col("capture") == k).groupBy("room", F.col("ref").alias("dimension")).agg(F.max(c).alias(name))
    return scoring.head_to_head(dims("value", "app_value", 1), dims("truth", "truth", 1), dims("value", "our_value", 2))


_GATES = """SELECT 'wall lengths' AS name, CASE n_nationkey % 3 WHEN 0 THEN 'lidar' WHEN 1 THEN 'video' ELSE 'photo' END || n_nationkey AS tier, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey % {0} AS DOUBLE) / {0} END AS score,
 n_nationkey % {0} = 0 AS passed, n_nationkey AS seq FROM nation"""


def _gates(spark, d, k):
    return read(spark, d, "nation").selectExpr(
        "'wall lengths' AS name", "CASE n_nationkey % 3 WHEN 0 THEN 'lidar' WHEN 1 THEN 'video' ELSE 'photo' END || n_nationkey AS tier",
        f"CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey % {k} AS DOUBLE) / {k} END AS score", f"n_nationkey % {k} = 0 AS passed", "n_nationkey AS seq")


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY coalesce(score, 1), seq) AS INT) AS rank FROM ({_GATES.format(5)}) WHERE NOT passed")
def failing_gates_rank(spark, d):
    return scoring.failing_gates(_gates(spark, d, 5))


@query(f"""SELECT b.name, b.tier, b.score AS score_before, b.passed AS passed_before, a.score AS score_after, CAST(a.passed AS INT) AS passed_after, round(a.score - b.score, 6) AS change
 FROM ({_GATES.format(5)}) b LEFT JOIN (SELECT * FROM ({_GATES.format(4)}) WHERE seq % 6 <> 0) a USING (name, tier)""")  # fmt: skip
def gates_before_after(spark, d):
    out = scoring.before_after(_gates(spark, d, 5), _gates(spark, d, 4).where("seq % 6 <> 0"))
    return _rounded(out.withColumn("passed_after", F.col("passed_after").cast("int")), "change")


_TRUE_ADJ = "SELECT n_regionkey AS site, n_nationkey % 6 AS a, n_nationkey % 7 AS b FROM nation WHERE n_nationkey % 6 <> n_nationkey % 7"
_PRED_ADJ = "SELECT n_regionkey AS site, n_nationkey % 7 AS a, n_nationkey % 5 AS b, CASE WHEN n_nationkey % 4 = 0 THEN 'shared_wall' ELSE 'door' END AS kind FROM nation WHERE n_nationkey % 7 <> n_nationkey % 5"


@query(f"""WITH t AS (SELECT DISTINCT site, least(a, b) AS a, greatest(a, b) AS b FROM ({_TRUE_ADJ})), p AS (SELECT DISTINCT site, least(a, b) AS a, greatest(a, b) AS b FROM ({_PRED_ADJ}) WHERE kind <> 'shared_wall')
 SELECT site, status, count(*) AS n FROM (SELECT *, 'found' AS status FROM (FROM t INTERSECT FROM p) UNION ALL SELECT *, 'missing' FROM (FROM t EXCEPT FROM p) UNION ALL SELECT *, 'extra' FROM (FROM p EXCEPT FROM t)) GROUP BY ALL""")  # fmt: skip
def adjacency_setops(spark, d):
    n = read(spark, d, "nation")
    true = n.where("n_nationkey % 6 <> n_nationkey % 7").selectExpr("n_regionkey AS site", "n_nationkey % 6 AS a", "n_nationkey % 7 AS b")
    found = n.where("n_nationkey % 7 <> n_nationkey % 5").selectExpr("n_regionkey AS site", "n_nationkey % 7 AS a", "n_nationkey % 5 AS b", "CASE WHEN n_nationkey % 4 = 0 THEN 'shared_wall' ELSE 'door' END AS kind")
    return scoring.adjacency_scores(true, found)


# ---- measurement -------------------------------------------------------------------------------

#: Calibration prior by tier and kind.
PRIOR = [(tier, kind, *row) for tier, rows in {
    "lidar": {"default": (1.5, 1.0, 0.004, 0.0), "wall_length": (1.5, 1.0, 0.004, 0.0), "ceiling_height": (1.5, 1.0, 0.004, 0.0), "opening_width": (1.5, 1.0, 0.008, 0.0), "opening_height": (1.5, 1.0, 0.010, 0.0),
              "floor_area": (1.5, 1.0, 0.05, 0.0), "footprint_area": (1.5, 1.0, 0.10, 0.0), "damage_extent": (1.5, 1.0, 0.01, 0.0)},
    "video": {"default": (1.5, 1.5, 0.02, 0.0), "wall_length": (1.5, 1.5, 0.02, 0.0), "ceiling_height": (1.5, 1.5, 0.02, 0.0), "opening_width": (1.5, 1.5, 0.03, 0.0), "floor_area": (1.5, 1.5, 0.2, 0.0), "footprint_area": (1.5, 1.5, 0.5, 0.0)},
    "photo": {"default": (2.0, 1.5, 0.04, 0.0), "wall_length": (2.0, 1.5, 0.04, 0.0), "ceiling_height": (2.0, 1.5, 0.03, 0.0), "opening_width": (2.0, 1.5, 0.05, 0.0), "floor_area": (2.0, 1.5, 0.4, 0.0), "footprint_area": (2.0, 1.5, 1.0, 0.0)},
}.items() for kind, row in rows.items()]
_PRIOR_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for t, k, a, b, c, e in PRIOR) + ") AS t(tier, kind, abs_mult, log_mult, abs_floor, log_floor)"


def prior(spark):
    return spark.createDataFrame(PRIOR, "tier string, kind string, abs_mult double, log_mult double, abs_floor double, log_floor double")


def _estimates(spark, d):
    return items(spark, d).select("capture", "tier", "kind", "ref", "value", ((F.col("hi") - F.col("lo")) / 40).alias("sigma_abs"), (F.col("truth") / 1000).alias("sigma_log"))


_EST = "SELECT capture, tier, kind, ref, value, (hi - lo) / 40 AS sigma_abs, truth / 1000 AS sigma_log FROM v_items"
_MULT = f"""SELECT e.*, coalesce(k.abs_mult, b.abs_mult, 1) AS abs_mult, coalesce(k.log_mult, b.log_mult, 1) AS log_mult, coalesce(k.abs_floor, b.abs_floor, 0) AS abs_floor, coalesce(k.log_floor, b.log_floor, 0) AS log_floor
 FROM ({_EST}) e LEFT JOIN ({_PRIOR_SQL}) k ON k.tier = e.tier AND k.kind = e.kind AND k.kind <> 'default' LEFT JOIN ({_PRIOR_SQL}) b ON b.tier = e.tier AND b.kind = 'default'"""


@query(_MULT, *_ITEMS)
def calibration_lookup_fallback(spark, d):
    return calibration.with_multipliers(_estimates(spark, d), prior(spark))


@query(f"""SELECT * EXCLUDE (a, g), round(greatest(0, value - sqrt((1.6449 * a) ** 2 + (value - value * exp(-1.6449 * g)) ** 2)), 6) AS lo, round(value + sqrt((1.6449 * a) ** 2 + (value * exp(1.6449 * g) - value) ** 2), 6) AS hi
 FROM (SELECT *, sqrt((sigma_abs * abs_mult) ** 2 + abs_floor ** 2) AS a, sigma_log * log_mult + log_floor AS g FROM ({_MULT}))""", *_ITEMS)  # fmt: skip
def finalize_interval(spark, d):
    return calibration.finalize(_estimates(spark, d), prior(spark))


@query("SELECT capture, tier, kind, ref, truth BETWEEN lo AND hi AS covered, round(value - truth, 6) AS err, round((value - truth) / nullif(truth, 0), 6) AS rel FROM v_items", *_ITEMS)
def interval_contains(spark, d):
    c = F.col
    return items(spark, d).select("capture", "tier", "kind", "ref", measure.covered(c("truth"), c("lo"), c("hi")).alias("covered"), F.round(measure.error(c("value"), c("truth")), 6).alias("err"), F.round(measure.relative_error(c("value"), c("truth")), 6).alias("rel"))


@query(f"SELECT capture, tier, kind, round(sum(value), 4) AS value, round(sqrt(sum(sigma_abs * sigma_abs)), 6) AS sigma_abs, max(sigma_log) AS sigma_log FROM ({_EST}) GROUP BY ALL", *_ITEMS)
def estimate_sum(spark, d):
    return calibration.summed(_estimates(spark, d), "capture", "tier", "kind").withColumns({"value": F.round("value", 4), "sigma_abs": F.round("sigma_abs", 6)})


@query("""SELECT id, round(CASE WHEN id % 3 > 0 THEN sqrt(s * s + 0.003::DOUBLE * 0.003::DOUBLE + 0.002::DOUBLE * 0.002::DOUBLE) ELSE sqrt(s * s + 0.08::DOUBLE * 0.08::DOUBLE) END, 6) AS sigma FROM (SELECT id, top / 100 AS s FROM v_edges)""", "v_edges")
def edge_sigma(spark, d):
    from .adapters import edges

    b = measure.BUDGETS["lidar"]
    rows = edges(spark, d).select("id", (F.col("top") / 100).alias("s"))
    return rows.select("id", F.round(measure.edge_sigma(F.col("s"), F.col("id") % 3 > 0, *(F.lit(b[k]) for k in ("bias", "drift", "unobserved"))), 6).alias("sigma"))


@query("SELECT ref, kind, value, unit, round(value * CASE unit WHEN 'm2' THEN 10.7639::DOUBLE WHEN 'm' THEN 3.28084::DOUBLE ELSE 1::DOUBLE END, 2) AS imperial FROM (SELECT ref, kind, value, CASE WHEN kind LIKE '%area' THEN 'm2' WHEN kind = 'damage_extent' THEN 'ea' ELSE 'm' END AS unit FROM v_items)", *_ITEMS)
def unit_conversion(spark, d):
    unit = F.when(F.col("kind").like("%area"), "m2").when(F.col("kind") == "damage_extent", "ea").otherwise("m")
    return items(spark, d).select("ref", "kind", "value", unit.alias("unit")).withColumn("imperial", measure.imperial(F.col("value"), F.col("unit")))


# ---- calibration -------------------------------------------------------------------------------

_SCORED = "SELECT *, abs(truth - value) / greatest(CASE WHEN truth >= value THEN hi - value ELSE value - lo END, 1e-9) AS s FROM v_items"


@query(f"SELECT capture, tier, kind, ref, round(s, 6) AS s FROM ({_SCORED})", *_ITEMS)
def conformal_score(spark, d):
    return calibration.scored(items(spark, d)).select("capture", "tier", "kind", "ref", F.round("s", 6).alias("s"))


def _factor_sql(source: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"""SELECT {k}, max(n) AS n, coalesce(max(s) FILTER (k = (9 * (n + 1) + 9) // 10), max(s) * 1.25::DOUBLE) AS factor FROM (SELECT {k}, s, count(*) OVER (PARTITION BY {k}) AS n, row_number() OVER (PARTITION BY {k} ORDER BY s) AS k FROM ({source})) GROUP BY {k}"""


@query(f"SELECT tier, kind, n, round(factor, 6) AS factor FROM ({_factor_sql(_SCORED, 'tier', 'kind')})", *_ITEMS)
def conformal_factor(spark, d):
    return _rounded(calibration.conformal_factor(calibration.scored(items(spark, d)), "tier", "kind"), "factor")


#: Tiers by part, so that groups are small: some have the eight items that a factor of their own takes, others borrow their tier's.
_FEW = "(SELECT tier || '-' || CAST(ref AS VARCHAR) AS tier, capture, kind, room, ref, truth, value, lo, hi FROM v_items)"


@query(f"""SELECT a.tier, a.kind, a.n, round(CASE WHEN a.n >= 8 THEN a.factor WHEN b.n >= 8 THEN b.factor END, 6) AS factor
 FROM ({_factor_sql(_SCORED.replace('v_items', _FEW), 'tier', 'kind')}) a JOIN ({_factor_sql(_SCORED.replace('v_items', _FEW), 'tier')}) b USING (tier)""", *_ITEMS)  # fmt: skip
def conformal_factor_fallback(spark, d):
    few = items(spark, d).withColumn("tier", F.concat("tier", F.lit("-"), F.col("ref").cast("string")))
    return _rounded(calibration.factors(few), "factor")


@query(f"SELECT tier, kind, CAST(grouping_id(tier, kind) AS BIGINT) AS level, count(*) AS n, round(median(s), 6) AS median_score FROM ({_SCORED}) GROUP BY GROUPING SETS ((tier, kind), (tier))", *_ITEMS)
def grouping_sets_pooled(spark, d):
    return _rounded(calibration.pooled_counts(items(spark, d)), "median_score")


_LOO = f"""WITH q AS (SELECT capture, tier, kind, s FROM ({_SCORED})), size AS (SELECT tier, kind, count(*) AS total FROM q GROUP BY ALL), folds AS (SELECT DISTINCT tier, kind, capture AS held, total FROM q JOIN size USING (tier, kind)),
 train AS (SELECT f.tier, f.kind, f.held, q.s FROM folds f JOIN q ON q.tier = f.tier AND q.capture <> f.held AND (q.kind = f.kind OR f.total < 8)), learned AS ({_factor_sql('train', 'tier', 'kind', 'held')})
 SELECT q.tier, q.kind, count(*) AS tested, round(avg(CASE WHEN q.s <= l.factor THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS loo_coverage FROM q JOIN learned l ON l.tier = q.tier AND l.kind = q.kind AND l.held = q.capture AND l.n >= 3 GROUP BY ALL"""


@query("SELECT * FROM (" + _LOO + ")", *_ITEMS)
def loo_coverage(spark, d):
    return _rounded(calibration.leave_one_out(items(spark, d)), "loo_coverage")


@query("""SELECT n, captures, round(ratio, 6) AS ratio, round(before, 6) AS before, round(after, 6) AS after, after < 0.95 * before AND n >= 6 AND captures >= 2 AS adopted FROM (SELECT count(*) AS n, count(DISTINCT capture) AS captures, exp(median(g)) AS ratio FROM sel),
 (SELECT avg(abs(value - truth)) AS before, avg(abs(value * r - truth)) AS after FROM sel JOIN (SELECT h.capture AS held, exp(median(g)) AS r FROM (SELECT DISTINCT capture FROM sel) h JOIN sel s ON s.capture <> h.capture GROUP BY h.capture) ON capture = held)""".replace("FROM sel", "FROM v_sel").replace("JOIN sel", "JOIN v_sel"), *_ITEMS, "v_sel")  # fmt: skip
def depth_scale_loo(spark, d):
    return _rounded(calibration.depth_scale(items(spark, d)), "ratio", "before", "after")


@query("SELECT ref, kind, value * k AS value, lo * k AS lo, hi * k AS hi FROM (SELECT *, CASE WHEN kind LIKE '%area' THEN 1.02::DOUBLE * 1.02::DOUBLE ELSE 1.02::DOUBLE END AS k FROM v_items)", *_ITEMS)
def rescale_items(spark, d):
    return calibration.rescaled(items(spark, d), F.lit(1.02)).select("ref", "kind", "value", "lo", "hi")


_CUES = "SELECT capture, tier || kind || CAST(room AS VARCHAR) AS name, round(avg(value / truth), 6) AS log_scale, round(avg(hi - lo), 6) AS sigma FROM v_items GROUP BY ALL"


@query(f"SELECT capture, round(sum(log_scale / (sigma * sigma)) / sum(1 / (sigma * sigma)), 6) AS fused, round(sqrt(1 / sum(1 / (sigma * sigma))), 6) AS fused_sigma, count(*) AS used FROM ({_CUES}) GROUP BY capture", *_ITEMS)
def scale_fusion_pass(spark, d):
    cues = items(spark, d).groupBy("capture", F.concat("tier", "kind", F.col("room").cast("string")).alias("name")).agg(F.round(F.avg(F.col("value") / F.col("truth")), 6).alias("log_scale"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("sigma"))
    return _rounded(calibration.fused_scale(cues, "capture"), "fused", "fused_sigma")
