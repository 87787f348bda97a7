"""Mixing sources to target weights by entropy balancing, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, own_name

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rates are kept as whole millionths, so that their sums don't depend on the order of adding.
UNIT = 1_000_000
#: Parts of a (source, size) cell, numbered apart so that no task orders a whole cell.
PARTS = 256


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, a key of the source that is never null, and the number of words (a null text has none)."""
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("s"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place, from 0, in order of the sources' code points, null last. They are sorted in ranges, each of which only counts its own."""
    placed = cut(sources.orderBy(F.col("source").asc_nulls_last())).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = cut(placed)
    before, starts = 0, []
    for p, n in sorted(map(tuple, placed.groupBy("_p").count().collect())):
        starts.append((p, before))
        before += n
    named = sources.sparkSession.createDataFrame(starts, "_p int, _start long")
    return placed.join(F.broadcast(named), "_p").withColumn("place", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, s, total, ...).

    Sources in code point order, null last, weigh as the repeating weights say and share `share` of all
    words; no target goes over `most` times its source's words. What is left over is reshared among the others by weight until none is
    above: a round is a sum over all sources, which gives the words that a unit of weight gets.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("total") * F.lit(float(most))
    weighed = cut(ranked(sources).withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int"))).drop("place"))
    exact = lambda c: F.sum(c.cast("decimal(28,0)")).cast("double")
    whole = weighed.agg(exact(F.col("total"))).first()[0] or 0.0
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        capped, open_ = weighed.agg(exact(F.when(full, cap)), exact(F.when(~full, F.col("weight")))).first()
        following = (whole * share - (capped or 0.0)) / open_ if open_ else level
        if not following > level:
            break
        level = following
    full = F.lit(bool(not open_)) | (cap <= F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", F.when(full, cap).otherwise(F.lit(level) * F.col("weight")))


def _rate(lam, x, most: int):
    return F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve(cells: DataFrame, goals: DataFrame, most: int = MOST, rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """lam for each source: Newton's iterations on the convex dual of entropy balancing.

    A document of x = size / mean size has the rate min(most, exp(lam x)): the rates nearest to one copy
    each, in relative entropy, that meet the words asked for without passing `most`; sources that need that of all have no lam. A round sums words and
    slope over all cells (equal documents of a source count as one cell), steps, and halves the bracket
    where a step leaves it. Sums are decimals: they don't depend on the order of adding.
    """
    t, s = F.col("target"), F.col("total")
    least_x = F.col("least") / F.col("mean")
    params = goals.where((t > 0) & (t < s * most)).select(
        "s", "total", "target", "mean",
        F.when(t < s, F.log(t / s) / least_x).otherwise(F.lit(0.0)).alias("lo"),
        F.when(t < s, F.lit(0.0)).otherwise(F.log(F.lit(float(most))) / least_x).alias("hi"),
        F.log(t / s).alias("lam"),
        F.lit(1.0).alias("gap"),
    )
    params = cut(params)
    small = F.col("size") > 0
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, most)
        words = F.col("n") * F.col("size") * r
        slope = F.when(r < most, words * x).otherwise(F.lit(0.0))
        sums = cells.where(small).join(params.select("s", "lam", "mean"), "s").groupBy("s").agg(
            F.sum(words.cast("decimal(28,6)")).cast("double").alias("g"), F.sum(slope.cast("decimal(28,6)")).cast("double").alias("slope"))
        d = F.col("g") - t
        lo, hi = F.when(d < 0, F.col("lam")).otherwise(F.col("lo")), F.when(d < 0, F.col("hi")).otherwise(F.col("lam"))
        step = F.col("lam") - F.try_divide(d, F.col("slope"))
        done = F.abs(d) <= t * tolerance
        params = cut(
            params.join(sums, "s").withColumns({"_lo": lo, "_hi": hi, "_step": step, "_done": done}).select(
                "s", "total", "target", "mean", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                F.when(F.col("_done"), F.col("lam")).when((F.col("_step") > F.col("_lo")) & (F.col("_step") < F.col("_hi")), F.col("_step")).otherwise((F.col("_lo") + F.col("_hi")) / 2).alias("lam"),
                F.when(F.col("_done"), F.lit(0.0)).otherwise(F.abs(d) / t).alias("gap"),
            )
        )
        if not (params.agg(F.max("gap")).first()[0] or 0.0):
            break
    else:
        raise RuntimeError("entropy balancing did not settle")
    return params.select("s", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken (= copies x size).

    Copies round the rates by systematic counting along each source in order of size, then a hash, then id:
    then one document of the source changes by a copy where that brings the source's words nearer to its
    target. No document gets over `most` copies. A null text has no words and takes none; a null source is a source of its own, last in
    order; sources without words have target 0. Rows with equal ids count one by one. No rows in, no rows out.
    """
    rows = cut(sized(docs, id_col, text_col, source_col).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")))
    parts = cut(rows.groupBy("source", "s", "size", "part").agg(F.count("*").alias("n")))
    cells = cut(parts.groupBy("source", "s", "size").agg(F.sum("n").alias("n")))
    filled = F.col("size") > 0
    sources = cells.groupBy("source", "s").agg(
        F.sum(F.col("n") * F.col("size")).alias("total"),
        F.min(F.when(filled, F.col("size"))).alias("least"),
        (F.sum(F.col("n") * F.col("size")) / F.sum(F.when(filled, F.col("n")))).alias("mean"),
    )
    goals = cut(targets(sources, weights, share, most))
    lam = solve(cells, goals, most)
    x = F.col("size") / F.col("mean")
    full = F.col("target") >= F.col("total") * float(most)
    rate = F.when(~filled, F.lit(0.0)).when(full, F.lit(float(most))).when(F.col("lam").isNull(), F.lit(0.0)).otherwise(_rate(F.col("lam"), x, most))
    along = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        cells.join(goals.select("s", "total", "target", "mean"), "s").join(lam, "s", "left")
        .withColumn("unit", F.round(rate * UNIT).cast("long"))
        .withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("unit")).over(along), F.lit(0)))
        .select("s", "size", "unit", "start", "total", "target")
    )
    inside = Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(rated, ["s", "size"]).select("s", "size", "part", "first", "unit", "start", "total", "target")
    k = F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("id"))
    drawn = cut(
        rows.withColumn("k", k).join(offsets, ["s", "size", "part"])
        .withColumn("i", F.col("first") + F.col("k"))
        .withColumn("copies", F.expr(f"(start + i * unit + {UNIT // 2}) div {UNIT} - (start + (i - 1) * unit + {UNIT // 2}) div {UNIT}").cast("long"))
        .select("id", "source", "s", "size", "part", "k", "total", "target", "unit", "copies")
    )
    return _nearer(drawn, most).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("total").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        (F.col("unit") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def _nearer(drawn: DataFrame, most: int) -> DataFrame:
    """One document of each source, the one whose size is nearest to what the source is off its target, changes by a copy.

    What a source is off is repeated for each part, so that a large source's rows aren't joined in one task.
    """
    off = drawn.groupBy("s").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    gap = F.abs(F.col("size") - F.abs("off"))
    room = ((F.col("off") > 0) & (F.col("copies") < most)) | ((F.col("off") < 0) & (F.col("copies") > 0))
    spread = off.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    best = drawn.join(spread, ["s", "part"]).where(room & (gap < F.abs("off"))).groupBy("s").agg(F.min(F.struct(gap.alias("gap"), "size", "part", "k", F.signum("off").cast("long").alias("step"))).alias("b"))
    steps = best.select("s", "b.size", "b.part", "b.k", "b.step")
    return drawn.join(steps, ["s", "size", "part", "k"], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, each as often as it takes it, with the columns of docs.

    Rows that share a doc_id (or have none) share a decision: the most copies any of them has. Documents without words, null texts
    among them, have no share in a mix of words and aren't taken. No rows in, no rows out.
    """
    mid, mk = own_name("_mid", docs), own_name("_mk", docs)
    chosen = mix(docs).groupBy(F.col("doc_id").alias(mid)).agg(F.max("copies").alias(mk)).where(F.col(mk) > 0)
    taken = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(mid)))
    return taken.withColumn(mid, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mk)))).select(*docs.columns)
