"""What is left of model stages without media: class probabilities, colour statistics, a cache of outputs by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import dot


#: Prompts that every image is compared with, at most.
PROMPTS = 4096


def class_probabilities(images: DataFrame, prompts: DataFrame, scale: float = 100.0) -> DataFrame:
    """Softmax of scaled cosines over all prompts, summed by class. Prompts are a stated set, which is broadcast; more than PROMPTS are refused."""
    if prompts.limit(PROMPTS + 1).count() > PROMPTS:
        raise ValueError(f"over {PROMPTS} prompts")
    p = F.broadcast(prompts.select(F.col("id").alias("prompt"), F.col("class"), F.col("v").alias("pv")))
    scores = images.select("id", "v").join(p).select("id", "prompt", "class", F.round(scale * dot("v", "pv"), 6).alias("s"))
    top = F.max("s").over(Window.partitionBy("id"))
    e = scores.withColumn("e", F.exp(F.col("s") - top))
    return e.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("id"))).groupBy("id", "class").agg(F.sum("p").alias("p"))


def best_class(probabilities: DataFrame) -> DataFrame:
    return probabilities.groupBy("id").agg(F.min(F.struct((-F.round("p", 6)).alias("n"), "class")).alias("b")).select("id", F.col("b.class").alias("class"), (-F.col("b.n")).alias("p"))


def top_views_median(pixels: DataFrame, k: int = 3) -> DataFrame:
    """Median colour of each surface pixel over its k best views."""
    place = F.row_number().over(Window.partitionBy("surface", "r", "c").orderBy(F.col("score").desc(), "view"))
    return pixels.withColumn("_k", place).where(F.col("_k") <= k).groupBy("surface", "r", "c").agg(F.median("l").alias("l"), F.count("*").alias("views"))


def colour_distance(l: Column, a: Column, b: Column, l0: Column, a0: Column, b0: Column) -> Column:  # noqa: E741
    """Perceptual distance with lightness at 0.7."""
    dl, da, db = 0.7 * (l - l0), a - a0, b - b0
    return F.sqrt(dl * dl + da * da + db * db)


def outlier_mask(pixels: DataFrame, key: str, floor: float = 9.0, factor: float = 4.5) -> DataFrame:
    """Pixels far from their surface's median colour: over the floor and over the median distance by a multiple of its spread."""
    mid = pixels.groupBy(key).agg(*[F.median(c).alias(f"{c}0") for c in "lab"])
    far = pixels.join(mid, key).withColumn("distance", F.round(colour_distance(*(F.col(c) for c in ("l", "a", "b", "l0", "a0", "b0"))), 6))
    m = far.groupBy(key).agg(F.median("distance").alias("m"))
    spread = far.join(m, key).groupBy(key).agg(F.first("m").alias("m"), F.median(F.abs(F.col("distance") - F.col("m"))).alias("mad"))
    limit = F.greatest(F.lit(floor), F.round(F.col("m") + factor * 1.4826 * F.col("mad"), 6))
    return far.join(spread, key).where(F.col("distance") >= limit).select(key, "id", "distance")


def cached(inputs: DataFrame, store: DataFrame, compute, key: str = "key") -> DataFrame:
    """Outputs of the inputs: those stored under their key, and computed ones for the rest."""
    hits = inputs.select(key).distinct().join(store, key)
    missing = inputs.join(store.select(key), key, "left_anti").dropDuplicates([key])
    return hits.unionByName(compute(missing))
