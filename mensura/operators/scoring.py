"""Gates and coverage over score items (capture, tier, kind, room, ref, truth, value, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import covered
from . import order

#: Tolerances in metres, shares, and the coverage band.
OPENING_TOLERANCE, OPENING_RATE = 0.02, 0.85
CEILING_TOLERANCE = 0.015
WALL_LIDAR = (0.02, 0.01)
WALL_RELATIVE = {"video": 0.03, "photo": 0.08}
REPEAT = (0.01, 0.005)
BAND = (0.85, 0.95)
SLACK = 1e-9


def _hit():
    return covered(F.col("truth"), F.col("lo"), F.col("hi"))


def _off():
    return F.abs(F.col("value") - F.col("truth"))


def _share(flag):
    return F.avg(flag.cast("double"))


def calibration_table(items: DataFrame) -> DataFrame:
    """Per (tier, kind): n, coverage, median width, median error, and whether coverage is within the band."""
    keys = ["tier", "kind"]
    rows = items.groupBy(*keys).agg(F.count("*").alias("n"), _share(_hit()).alias("coverage"))
    off = items.select(*keys, (F.col("hi") - F.col("lo")).alias("width"), _off().alias("err"))
    both = rows.join(order.medians(off, "width", "median_width", *keys), keys).join(order.medians(off, "err", "median_abs_err", *keys), keys)
    return both.withColumn("in_band", F.col("coverage").between(*BAND))


def wall_tolerance():
    lidar = F.greatest(F.lit(WALL_LIDAR[0]), WALL_LIDAR[1] * F.col("truth"))
    other = F.when(F.col("tier") == "video", WALL_RELATIVE["video"]).otherwise(WALL_RELATIVE["photo"]) * F.col("truth")
    return F.when(F.col("tier") == "lidar", lidar).otherwise(other)


def wall_gate(items: DataFrame) -> DataFrame:
    """Per tier: all walls within tolerance, and coverage at least the band's lower end (its upper end doesn't count)."""
    walls = items.where("kind = 'wall_length'")
    rows = walls.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(_off() <= wall_tolerance()).alias("within"), _share(_hit()).alias("coverage"))
    rows = rows.join(order.medians(walls.select("tier", _off().alias("err")), "err", "median_abs_err", "tier"), "tier")
    share = F.col("within") / F.col("n")
    return rows.withColumn("passed", (F.col("within") == F.col("n")) & (F.col("coverage") >= BAND[0])).withColumn("score", F.least(share, F.col("coverage") / BAND[0], F.lit(1.0)))


def ceiling_gate(items: DataFrame) -> DataFrame:
    """Per tier: every ceiling within tolerance; bias, spread (population) and the largest error."""
    e = F.col("value") - F.col("truth")
    rows = items.where("kind = 'ceiling_height'").groupBy("tier").agg(
        F.count("*").alias("n"), F.count_if(_off() <= CEILING_TOLERANCE + SLACK).alias("within"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("spread"), F.max(_off()).alias("largest"))
    return rows.withColumn("passed", F.col("within") == F.col("n")).withColumn("score", F.col("within") / F.col("n"))


def opening_gate(scores: DataFrame) -> DataFrame:
    """Per tier, from counters by capture (openings_gt, within, missed, phantom): phantoms count against the rate; null if none."""
    rows = scores.groupBy("tier").agg(*[F.sum(c).alias(c) for c in ("openings_gt", "within", "missed", "phantom")])
    rate = F.try_divide(F.col("within").cast("double"), F.col("openings_gt") + F.col("phantom"))
    return rows.withColumn("rate", rate).withColumn("passed", F.col("rate") >= OPENING_RATE).withColumn("score", F.least(F.lit(1.0), F.col("rate") / OPENING_RATE))


def capture_counters(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counters by key from matched openings (truth, found, t_width, f_width), in which an opening of either side may stand alone."""
    t, f = F.col("truth").isNotNull(), F.col("found").isNotNull()
    near = F.abs(F.col("f_width") - F.col("t_width")) <= OPENING_TOLERANCE + SLACK
    return pairs.groupBy(*keys).agg(F.count_if(t).alias("openings_gt"), F.count_if(t & f & near).alias("within"), F.count_if(t & ~f).alias("missed"), F.count_if(f & ~t).alias("phantom"))


def photo_stitch_gate(plans: DataFrame) -> DataFrame:
    """Mean of three facts a capture: all rooms placed, no overlaps, all adjacency found."""
    facts = [F.col("rooms_pred") >= F.col("rooms_gt"), F.col("n_overlaps") == 0, F.col("adjacency_found") >= F.col("adjacency_gt")]
    mean = sum((f.cast("int") for f in facts[1:]), facts[0].cast("int")) / F.lit(3.0)
    return plans.withColumn("score", mean).withColumn("passed", F.col("score") == 1.0)


def repeatability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Walls and ceilings that two captures share, by (room, ref): difference against the tolerance."""
    both = a.select("room", "ref", "kind", F.col("value").alias("a")).join(b.select("room", "ref", "kind", F.col("value").alias("b")), ["room", "ref", "kind"])
    tolerance = F.when(F.col("kind") == "ceiling_height", F.lit(0.01)).otherwise(F.greatest(F.lit(REPEAT[0]), REPEAT[1] * (F.col("a") + F.col("b")) / 2))
    return both.withColumn("diff", F.col("a") - F.col("b")).withColumn("tolerance", tolerance).withColumn("ok", F.abs("diff") <= F.col("tolerance"))


def upper_median(items: DataFrame, key: str, value: str) -> DataFrame:
    """The element in place n div 2 (from 0) of each key, which for even n is the upper middle one."""
    values = order.counted(items, value, key)
    n = values.groupBy(key).agg(F.sum("_c").alias("n"))
    found = order.picked(values, value, n.select(key, F.expr("n div 2 + 1").alias("rank")), key)
    return found.select(key, F.col(value).alias("upper_median")).join(n, key)


def head_to_head(app: DataFrame, truth: DataFrame, ours: DataFrame) -> DataFrame:
    """Dimensions of another app against truth and ours, by (room, dimension). Tie: both within a centimetre; beat: our error isn't larger."""
    rows = app.join(truth, ["room", "dimension"]).join(ours, ["room", "dimension"], "left")
    app_err, our_err = F.abs(F.col("app_value") - F.col("truth")), F.abs(F.col("our_value") - F.col("truth"))
    verdict = F.when(F.col("our_value").isNull(), "missing").when((our_err <= 0.01) & (app_err <= 0.01), "tie").when(our_err <= app_err, "beat").otherwise("loss")
    return rows.withColumns({"app_err": app_err, "our_err": our_err, "verdict": verdict})


def failing_gates(gates: DataFrame) -> DataFrame:
    """Gates that failed, worst first; a gate without a score counts as 1; equal scores keep their order."""
    rank = F.row_number().over(Window.orderBy(F.coalesce("score", F.lit(1.0)), "seq"))
    return gates.where("passed = false").withColumn("rank", rank)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("name", "tier", F.col("score").alias("score_before"), F.col("passed").alias("passed_before"))
    a = after.select("name", "tier", F.col("score").alias("score_after"), F.col("passed").alias("passed_after"))
    return b.join(a, ["name", "tier"], "left").withColumn("change", F.col("score_after") - F.col("score_before"))


def adjacency_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Undirected pairs by site: in both, missing, extra; shared walls don't count as found."""
    def pairs(df):
        return df.select("site", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    t, p = pairs(truth), pairs(found.where("kind <> 'shared_wall'"))
    parts = [t.intersect(p).withColumn("status", F.lit("found")), t.exceptAll(p).withColumn("status", F.lit("missing")), p.exceptAll(t).withColumn("status", F.lit("extra"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("site", "status").agg(F.count("*").alias("n"))
