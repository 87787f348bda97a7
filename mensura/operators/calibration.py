"""Interval calibration: fallback look-up, conformal factors, leave-one-capture-out, depth scale, scale fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import conformal_score, interval, scale_power
from . import order

ALPHA_TENTHS = 1
LEAST_ITEMS, LEAST_TRAINING = 8, 3
SCALE_KINDS = ("wall_length", "ceiling_height")


def with_multipliers(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Looks up (tier, kind), else (tier, default), else the identity."""
    names = ("abs_mult", "log_mult", "abs_floor", "log_floor")
    own = table.where("kind <> 'default'").select("tier", "kind", *[F.col(c).alias(f"_k_{c}") for c in names])
    base = table.where("kind = 'default'").select("tier", *[F.col(c).alias(f"_d_{c}") for c in names])
    identity = dict(zip(names, (1.0, 1.0, 0.0, 0.0)))
    found = rows.join(own, ["tier", "kind"], "left").join(base, "tier", "left")
    return found.select(*rows.columns, *[F.coalesce(f"_k_{c}", f"_d_{c}", F.lit(identity[c])).alias(c) for c in names])


def finalize(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Estimates (tier, kind, value, sigma_abs, sigma_log) to intervals at 90 %."""
    c = F.col
    lo, hi = interval(c("value"), c("sigma_abs"), c("sigma_log"), c("abs_mult"), c("abs_floor"), c("log_mult"), c("log_floor"))
    return with_multipliers(rows, table).withColumns({"lo": F.round(lo, 6), "hi": F.round(hi, 6)})


def scored(items: DataFrame) -> DataFrame:
    c = F.col
    return items.withColumn("s", conformal_score(c("truth"), c("value"), c("lo"), c("hi")))


def _place(n):
    return F.expr(f"(9 * ({n} + 1) + 9) div 10")


def conformal_factor(scores: DataFrame, *keys: str) -> DataFrame:
    """Per key the ceil(0.9 (n + 1))-th smallest score; beyond n, a quarter more than the largest."""
    values = order.counted(scores, "s", *keys)
    m = values.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("s").alias("most"))
    found = order.picked(values, "s", m.select(*keys, _place("n").alias("rank")), *keys).drop("rank")
    return m.join(found, list(keys), "left").select(*keys, "n", F.coalesce("s", F.col("most") * 1.25).alias("factor"))


def factors(items: DataFrame, least: int = LEAST_ITEMS) -> DataFrame:
    """Per (tier, kind) its own factor from `least` items on, else that of the tier, else null."""
    s = scored(items)
    own = conformal_factor(s, "tier", "kind")
    pooled = conformal_factor(s, "tier").select("tier", F.when(F.col("n") >= least, F.col("factor")).alias("pooled"))
    return own.join(pooled, "tier").select("tier", "kind", "n", F.when(F.col("n") >= least, F.col("factor")).otherwise(F.col("pooled")).alias("factor"))


def pooled_counts(items: DataFrame) -> DataFrame:
    """Coverage and n by (tier, kind) and by tier, in one pass of grouping sets."""
    rows = scored(items).groupingSets([[F.col("tier"), F.col("kind")], [F.col("tier")]], "tier", "kind")
    return rows.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.median("s").alias("median_score"))


def _others_factor(scores: DataFrame, held: str, *keys: str) -> DataFrame:
    """(keys, held, n, factor): conformal_factor of all rows of the keys but the held one's."""
    most = F.least(_place("n"), F.col("n"))
    at = order.others_ranks(scores, "s", held, most, *keys).where("n > 0")
    values = order.at_ranks(scores, "s", at.select(*keys, "rank"), *keys)
    beyond = F.when(_place("n") > F.col("n"), 1.25).otherwise(1.0)
    return at.join(values, [*keys, "rank"]).select(*keys, held, "n", (F.col("s") * beyond).alias("factor"))


def leave_one_out(items: DataFrame, least: int = LEAST_ITEMS, training: int = LEAST_TRAINING) -> DataFrame:
    """Share of held-out items within the factor of the other captures' items, of the kind or, if rare, the tier."""
    s = scored(items).select("capture", "tier", "kind", "s")
    rare = F.col("n_kind") < least
    size = s.groupBy("tier", "kind").agg(F.count("*").alias("n_kind"))
    own = _others_factor(s, "capture", "tier", "kind").withColumnsRenamed({"n": "n_own", "factor": "f_own"})
    pooled = _others_factor(s.select("tier", "capture", "s"), "capture", "tier").withColumnsRenamed({"n": "n_all", "factor": "f_all"})
    test = s.join(size, ["tier", "kind"]).join(own, ["tier", "kind", "capture"], "left").join(pooled, ["tier", "capture"], "left")
    learned = test.withColumns({"n": F.when(rare, F.col("n_all")).otherwise(F.col("n_own")), "factor": F.when(rare, F.col("f_all")).otherwise(F.col("f_own"))}).where(F.col("n") >= training)
    return learned.groupBy("tier", "kind").agg(F.count("*").alias("tested"), F.avg((F.col("s") <= F.col("factor")).cast("double")).alias("loo_coverage"))


def depth_scale(items: DataFrame) -> DataFrame:
    """The LiDAR length ratio exp(median ln(truth / value)), and held-out errors with and without it; adopted if 5 % better."""
    sel = items.where((F.col("tier") == "lidar") & F.col("kind").isin(*SCALE_KINDS) & (F.col("value") > 0) & (F.col("truth") > 0))
    sel = sel.select(F.lit(0).alias("_one"), "capture", "value", "truth", F.log(F.col("truth") / F.col("value")).alias("g"))
    middle = [order.others_ranks(sel, "g", "capture", F.expr(p), "_one").select("_one", "capture", "n", "rank") for p in ("(n + 1) div 2", "n div 2 + 1")]
    at = middle[0].unionByName(middle[1]).where("n > 0")
    values = order.at_ranks(sel, "g", at.select("_one", "rank"), "_one")
    learned = at.join(values, ["_one", "rank"]).groupBy("capture").agg(F.exp(F.avg("g")).alias("r"))
    tested = sel.join(learned, "capture")
    errors = tested.agg(F.avg(F.abs(F.col("value") - F.col("truth"))).alias("before"), F.avg(F.abs(F.col("value") * F.col("r") - F.col("truth"))).alias("after"))
    whole = sel.agg(F.count("*").alias("n"), F.count_distinct("capture").alias("captures"), F.lit(0).alias("_one"))
    ratio = order.medians(sel, "g", "ratio", "_one").select("_one", F.exp("ratio").alias("ratio"))
    found = whole.join(ratio, "_one").join(errors.withColumn("_one", F.lit(0)), "_one").drop("_one")
    return found.withColumn("adopted", (F.col("after") < 0.95 * F.col("before")) & (F.col("n") >= 6) & (F.col("captures") >= 2))


def rescaled(items: DataFrame, ratio) -> DataFrame:
    k = scale_power(F.col("kind"), ratio)
    return items.withColumns({c: F.col(c) * k for c in ("value", "lo", "hi")})


def fused_scale(cues: DataFrame, key: str) -> DataFrame:
    """Inverse-variance mean of log scales (log_scale, sigma) by key, and each cue's distance in sigmas."""
    w = 1.0 / (F.col("sigma") * F.col("sigma"))
    mean = cues.groupBy(key).agg((F.sum(F.col("log_scale") * w) / F.sum(w)).alias("fused"), F.sqrt(1.0 / F.sum(w)).alias("fused_sigma"), F.count("*").alias("used"))
    return mean


def reject_outliers(cues: DataFrame, key: str, limit: float = 3.0, passes: int = 4) -> DataFrame:
    """Leave-one-out rejection: while over two cues are used, drops the cue farthest (over `limit` sigmas) from the mean of the others."""
    left = cues
    for _ in range(passes):
        w = 1.0 / (F.col("sigma") * F.col("sigma"))
        by = Window.partitionBy(key)
        sw, sx = F.sum(w).over(by), F.sum(w * F.col("log_scale")).over(by)
        rest = (sx - w * F.col("log_scale")) / F.nullif(sw - w, F.lit(0.0))
        far = F.abs(F.col("log_scale") - rest) / F.sqrt(F.col("sigma") * F.col("sigma") + 1.0 / F.nullif(sw - w, F.lit(0.0)))
        place = F.row_number().over(by.orderBy(F.col("_far").desc_nulls_last(), "name"))
        ranked = left.withColumn("_n", F.count("*").over(by)).withColumn("_far", far).withColumn("_k", place)
        left = ranked.where(~((F.col("_n") > 2) & (F.col("_k") == 1) & (F.coalesce("_far", F.lit(0.0)) > limit))).select(*cues.columns)
    return left


def summed(estimates: DataFrame, *keys: str) -> DataFrame:
    """Sums of estimates: values add, absolute spreads in quadrature, the logarithmic spread is the largest."""
    return estimates.groupBy(*keys).agg(F.sum("value").alias("value"), F.sqrt(F.sum(F.col("sigma_abs") * F.col("sigma_abs"))).alias("sigma_abs"), F.max("sigma_log").alias("sigma_log"))
