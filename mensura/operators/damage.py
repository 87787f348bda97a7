"""Damage evidence on surface rasters: tests of candidate regions, their looks, classes, views and quantities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Views a discolouration needs, what stands proud (m), share of unobserved ring, skirting and cornice (m) and share in them.
MIN_VIEWS, PROUD, BORDER, SKIRTING, CORNICE, BANDED = 2, 0.012, 0.3, 0.12, 0.06, 0.7
#: Least pixels of a shape, straightness and angle of joints, least probability and margin, least area (m2), crack's shape.
LEAST, STRAIGHT, ALIGNED, PROBABILITY, MARGIN, STAIN_AREA, CRACK_LONG, CRACK_THIN = 5, 0.97, 6.0, 0.45, 2.0, 0.01, 4.0, 0.012


def surface_grid(surfaces: DataFrame, size: float) -> DataFrame:
    """(surface, r, c, u, v, x, y, z): a raster of each surface, rows from its top down, with the world place of each cell's middle.

    surfaces: surface, origin (ox, oy, oz) at (u0, v0), unit axes (ux ..) and (vx ..), and extents u0, u1, v0, v1.
    """
    count = lambda a, b: F.greatest(F.ceil(F.round((F.col(b) - F.col(a)) / size, 9)).cast("int"), F.lit(1))
    cells = surfaces.withColumn("c", F.explode(F.sequence(F.lit(0), count("u0", "u1") - 1)))
    cells = cells.withColumn("r", F.explode(F.sequence(F.lit(0), count("v0", "v1") - 1)))
    cells = cells.withColumns({"u": F.col("u0") + (F.col("c") + 0.5) * size, "v": F.col("v1") - (F.col("r") + 0.5) * size})
    place = [(F.col(f"o{k}") + (F.col("u") - F.col("u0")) * F.col(f"u{k}") + (F.col("v") - F.col("v0")) * F.col(f"v{k}")).alias(k) for k in "xyz"]
    return cells.select("surface", "r", "c", "u", "v", *place)


def plausible(pixels: DataFrame, key: str = "region") -> DataFrame:
    """(key, plausible): regions that aren't made by what was not seen, by trim, or by an object.

    pixels: key, inside (region or ring around it), views, protrusion (null if unknown), valid, kind of surface, v, v0, v1.
    """
    own = lambda c: F.when(F.col("inside"), c)
    share = lambda c: F.avg(own(c.cast("double")))
    m = pixels.groupBy(key).agg(
        F.median(own(F.col("views"))).alias("views"), F.count(own(F.col("protrusion"))).alias("n"), F.median(own(F.col("protrusion"))).alias("proud"),
        F.avg(F.when(~F.col("inside"), (~F.col("valid")).cast("double"))).alias("border"), F.first("kind").alias("kind"),
        share(F.col("v") < F.col("v0") + SKIRTING).alias("low"), share(F.col("v") > F.col("v1") - CORNICE).alias("high"))
    c = F.col
    bad = [c("views") < MIN_VIEWS, (c("n") >= LEAST) & (c("proud") > PROUD), c("border") > BORDER, (c("kind") == "wall") & (c("low") >= BANDED), (c("kind") == "wall") & (c("high") >= BANDED)]
    any_bad = F.lit(False)
    for b in bad:
        any_bad = any_bad | F.coalesce(b, F.lit(False))
    return m.select(key, (~any_bad).alias("plausible"))


def tortuous(pixels: DataFrame, key: str = "region") -> DataFrame:
    """(key, tortuous): whether a line of pixels (u, v) wanders, as cracks do; straight ones along the axes are joints. From the covariance."""
    c = F.col
    m = pixels.groupBy(key).agg(F.count("*").alias("n"), F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("uv"))
    root = F.sqrt((c("uu") - c("vv")) * (c("uu") - c("vv")) / 4 + c("uv") * c("uv"))
    straight = F.sqrt(F.try_divide((c("uu") + c("vv")) / 2 + root, c("uu") + c("vv")))
    angle = F.pmod(F.abs(F.degrees(F.atan2(2 * c("uv"), c("uu") - c("vv")) / 2)), F.lit(90.0))
    joint = (F.round(straight, 9) > STRAIGHT) & (F.round(F.least(angle, 90 - angle), 6) < ALIGNED)
    return m.select(key, ((c("n") >= LEAST) & ~F.coalesce(joint, F.lit(False))).alias("tortuous"))


def appearance(pixels: DataFrame, key: str = "region") -> DataFrame:
    """(key, dl, da, db, tex): a region's mean colour (l, a, b) against its ring's, and its texture as a share of the ring's; a ring of under
    twenty valid pixels gives way to the rest of the surface.

    pixels: key, part (inside, ring or rest), valid, l, a, b.
    """
    of = lambda part, c: F.when(part, F.col(c))
    ring, rest = (F.col("part") == "ring") & F.col("valid"), F.col("valid")
    m = pixels.groupBy(key).agg(
        F.count_if(ring).alias("n"), *[F.avg(of(F.col("part") == "inside", c)).alias(f"i{c}") for c in "lab"], *[F.avg(of(ring, c)).alias(f"r{c}") for c in "lab"],
        *[F.avg(of(rest, c)).alias(f"v{c}") for c in "lab"], F.stddev_pop(of(F.col("part") == "inside", "l")).alias("is"), F.stddev_pop(of(ring, "l")).alias("rs"), F.stddev_pop(of(rest, "l")).alias("vs"))
    enough = F.col("n") >= 20
    outer = lambda c: F.when(enough, F.col(f"r{c}")).otherwise(F.col(f"v{c}"))
    return m.select(key, *[(F.col(f"i{c}") - outer(c)).alias(f"d{c}") for c in "lab"], (F.col("is") / F.greatest(outer("s"), F.lit(1.0))).alias("tex"))


def consistent(kind: Column, dl: Column, db: Column, tex: Column, n: Column, proud: Column) -> Column:
    """Whether a class agrees with what was measured: stains are yellow or dark, mold dark and rough, paint rough, holes dark and behind."""
    hole = (dl <= -20) & ~F.coalesce((n >= LEAST) & (proud > -0.005), F.lit(False))
    return (
        F.when(kind == "water_stain", (db >= 2.5) | (dl <= -8)).when(kind == "mold", (dl <= -15) & (tex >= 1.3))
        .when(kind == "peeling_paint", tex >= 1.5).when(kind == "hole", hole).otherwise(F.lit(True))
    )


def accepted(candidates: DataFrame, probability: float = PROBABILITY, margin: float = MARGIN) -> DataFrame:
    """Candidates that count, with a confidence: (region, ridge, class, p, negative, area, dl, db, tex, n, proud, elongation, thickness)."""
    c = F.col
    spread = c("class").isin("water_stain", "mold", "peeling_paint") & (c("area") < STAIN_AREA)
    not_crack = c("ridge") & ((c("class") != "crack") | (c("p") < 0.5))
    blob = (c("class") == "crack") & ~c("ridge") & ((c("elongation") < CRACK_LONG) | (c("thickness") > CRACK_THIN))
    weak = (c("p") < probability) | (c("p") < c("negative") * margin)
    fits = consistent(c("class"), c("dl"), c("db"), c("tex"), c("n"), c("proud"))
    return candidates.where(~not_crack & ~spread & fits & ~blob & ~weak).withColumn("confidence", F.least(c("p") / (c("p") + c("negative") + 1e-6), F.lit(0.95)))


def guessed(candidates: DataFrame, cap: float = 0.45) -> DataFrame:
    """A class by looks alone, where no model is at hand: (region, ridge, dl, db, sl), sl being the spread of lightness. Others go."""
    c = F.col
    dark = (c("dl") < -12) & (c("sl") > 18)
    stain = (c("dl") < -6) & (c("db") > 3)
    kind = F.when(c("ridge"), "crack").when(dark, "mold").when(stain, "water_stain")
    sure = F.when(c("ridge"), 0.4).when(dark, 0.35).when(stain, 0.4)
    return candidates.withColumns({"class": kind, "confidence": F.least(sure, F.lit(cap))}).where("class is not null")


def best_views(candidates: DataFrame, views: DataFrame, key: str = "scene") -> DataFrame:
    """The view (view, px, py, pz) that sees each candidate (region, x, y, z, nx, ny, nz) most squarely and from nearest: cosine 0.4 and 3.5 m
    at least; ties to the least view."""
    both = candidates.join(views, key)
    d = {k: F.col(f"p{k}") - F.col(k) for k in "xyz"}
    distance = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    cosine = (d["x"] * F.col("nx") + d["y"] * F.col("ny") + d["z"] * F.col("nz")) / F.greatest(F.col("distance"), F.lit(1e-6))
    seen = both.withColumn("distance", distance).withColumn("cosine", cosine).where("cosine >= 0.4 and distance <= 3.5")
    score = F.round(F.col("cosine") / F.greatest(F.col("distance"), F.lit(0.5)), 9)
    best = seen.groupBy("region").agg(F.min(F.struct((-score).alias("s"), "view")).alias("m"))
    return best.select("region", F.col("m.view").alias("view"), (-F.col("m.s")).alias("score"))


SAMPLES = 400


def sampled(lo: float, hi: float, rng: np.random.Generator) -> np.ndarray:
    """Draws that agree with an interval at 90 %; none is under zero."""
    half = (hi - lo) / 2
    return np.maximum(rng.normal((hi + lo) / 2, half / 1.645 if half > 0 else 0.0, SAMPLES), 0.0)


def quantities(lines: DataFrame) -> DataFrame:
    """(line, value, lo, hi, sigma) of products of two measured sides (line, a, a_lo, a_hi, b, b_lo, b_hi): the 5th and the 95th percentile of the
    samples, widened to hold the value. The draws of a line depend on its number alone."""
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng(int(r.line))
                x = sampled(r.a_lo, r.a_hi, rng) * sampled(r.b_lo, r.b_hi, rng)
                lo, hi = np.percentile(x, [5, 95])
                rows.append((r.line, r.a * r.b, min(lo, r.a * r.b), max(hi, r.a * r.b), float(np.std(x))))
            yield pd.DataFrame(rows, columns=["line", "value", "lo", "hi", "sigma"]).round({"value": 4, "lo": 4, "hi": 4, "sigma": 4})

    return lines.select("line", "a", "a_lo", "a_hi", "b", "b_lo", "b_hi").mapInPandas(run, "line long, value double, lo double, hi double, sigma double")
