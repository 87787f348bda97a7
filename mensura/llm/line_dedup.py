"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, components. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import cut, discard, hot_keys, likely, one_map, own_name, spread_join
from .graph import components

#: Characters (UTF-16 units) of a shingle; a shorter line is one shingle.
CHARS = 10
SIMILARITY = 0.8
#: Nine minima and the twelve lines of the affine plane of order three: any two minima share one band, and any
#: five minima that agree hold a whole band. Of pairs at the similarity 99 in 100 meet, of closer ones more.
MINIMA = 9
BANDS = tuple((a, b, c) for a in range(9) for b in range(a + 1, 9) for c in range(b + 1, 9) if all((p + q + r) % 3 == 0 for p, q, r in zip(*(divmod(i, 3) for i in (a, b, c)))))
#: Shingles that are hashed in one row of the signatures' aggregate, a power of two.
STEP = 4
#: Words of 64 bits in a line's odd sketch.
SKETCH = 16
#: Lines of a bucket up to which all that aren't known to be connected are compared by their sketches, so many for each line at most; in larger
#: buckets those that share one of their rarest shingles are.
SMALL = 2048
#: Pivots that the lines of buckets of over PIVOTED open lines are compared with, before those that are left.
PIVOTS, PIVOTED = 8, 64


#: What is trimmed from the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def _mask(i: int) -> int:
    """Masks that differ in their first bits: a minimum under each is of a part of the hashes of its own."""
    x = (i * 0x1C71C71C71C71C71 + 0x3243F6A8885A308D) % 2**64
    return x - 2**64 if x >= 2**63 else x


def _hash(line):
    return F.xxhash64(line)


def written(df: DataFrame, name: str) -> DataFrame:
    """As common.written; most columns are hashes, so without dictionaries."""
    return common.written(df, name, dictionary=False)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, h) of all lines that aren't blank. Lines are compared trimmed and in lower case."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    raw = F.col("raw")
    # Spark's trim goes through all characters of a line; a look at its ends tells whether it is needed
    ragged = reduce(lambda a, b: a | b, (at(raw, F.lit(c)) for c in BLANKS for at in (F.startswith, F.endswith)))
    plain = split.select("id", "line_no", F.lower(F.when(ragged, F.trim(raw, F.lit(BLANKS))).otherwise(raw)).alias("line"))
    return plain.where("line <> ''").withColumn("h", _hash(F.col("line")))


def _wide(line):
    return F.encode(line, "UTF-16BE")


def _last(wide):
    return F.greatest((F.octet_length(wide) / 2).cast("int") - CHARS, F.lit(0))


def signatures(found: DataFrame) -> DataFrame:
    """(h, n, clash, m0 .. m8) of each distinct line: how many lines have its hash, whether their second hashes differ, and the least hash of its
    shingles under each mask. No text is shuffled."""
    wide = found.select("h", F.xxhash64(F.lit("second"), "line").alias("second"), _wide(F.col("line")).alias("w")).withColumn("last", _last(F.col("w")))
    each = wide.select("h", "second", "w", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    hashed = each.select("h", "second", "i", *(F.xxhash64(F.expr(f"substring(w, 2 * least(i + {j}, last) + 1, {2 * CHARS})")).alias(f"s{j}") for j in range(STEP)))
    rest = STEP
    masked = {(j, k): F.col(f"s{j}").bitwiseXOR(F.lit(_mask(k))) for j in range(STEP) for k in range(MINIMA)}
    while rest > 1:
        rest //= 2
        lesser = [F.when(masked[2 * j, k] < masked[2 * j + 1, k], masked[2 * j, k]).otherwise(masked[2 * j + 1, k]).alias(f"x{j}_{k}") for j in range(rest) for k in range(MINIMA)]
        hashed = hashed.select("h", "second", "i", *lesser)
        masked = {(j, k): F.col(f"x{j}_{k}") for j in range(rest) for k in range(MINIMA)}
    minima = [F.min(masked[0, k]).alias(f"m{k}") for k in range(MINIMA)]
    counted = hashed.groupBy("h").agg(F.count_if(F.col("i") == 0).alias("n"), F.min("second").alias("a"), F.max("second").alias("b"), *minima)
    return counted.select("h", "n", (F.col("a") != F.col("b")).alias("clash"), *(f"m{k}" for k in range(MINIMA)))


def signed_lines(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, its signatures): equal lines have one h, and by now no others share one.

    A second, independent hash tells lines apart whose first one clashes; these take a new one, until none clash.
    """
    while True:
        signed = written(signatures(found), "line-signatures")
        clashing = signed.where("clash").select("h", "clash")
        if clashing.isEmpty():
            return found, signed
        parted = F.when(F.col("clash"), F.xxhash64("h", F.lit("parted"), F.xxhash64(F.lit("second"), "line"))).otherwise(F.col("h"))
        found = written(found.join(clashing, "h", "left").select("id", "line_no", "line", parted.alias("h")), "lines")
        discard(signed)


def banded(signed: DataFrame) -> DataFrame:
    """(h, key): a key for each band."""
    keys = [F.xxhash64(F.lit(b), *(f"m{k}" for k in band)) for b, band in enumerate(BANDS)]
    return signed.select("h", F.explode(F.array(*keys)).alias("key"))


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, v) to compare first, (key, h) of the lines of larger buckets).

    Buckets are lines that share a band. What a bucket needs comes from aggregates with partial sums, never from a window or a list:
    its size, its pivot, which is its least line, and its last one. The two lines of a bucket of two are a pair; each line of a larger
    one makes a pair with the pivot.
    """
    keyed = banded(signed)
    # nearly all keys differ, so that a small map before the large one is only in the way
    with one_map(keyed.sparkSession):
        buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1"), "line-buckets")
    large = buckets.where("n > 2").select("key", "n", F.col("lo").alias("pivot"))
    held = likely(keyed, large.select("key"), "key")
    members = written(spread_join(held, large, ["key"], hot_keys(large, "key"), by=F.col("h")).select("key", "h", "pivot"), "line-members")
    pairs = buckets.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    pairs = pairs.unionByName(members.where("pivot <> h").select(F.col("pivot").alias("u"), F.col("h").alias("v"))).distinct()
    pairs = written(pairs, "line-pairs")
    discard(buckets)
    return pairs, members


def texts_of(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted lines (distinct h), each once. A bit map passes over most other lines before the shuffle."""
    return likely(found.select("h", "line"), wanted, "h").groupBy("h").agg(F.min("line").alias("line")).join(wanted, "h")


def _shingled(rows: DataFrame, distinct: bool = True, **names: str) -> DataFrame:
    """Adds sets (or all) of the shingle hashes, each from the named line. The inner function's line is a variable, which isn't copied at each use."""
    def each(wide):
        ends = F.sequence(F.lit(1), F.greatest(F.octet_length(wide).cast("int") - 2 * CHARS + 1, F.lit(1)), F.lit(2))
        return F.transform(ends, lambda i: F.xxhash64(F.substring(wide, i, F.lit(2 * CHARS))))

    wide = rows.withColumns({new: _wide(F.col(old)) for new, old in names.items()})
    hashes = {new: F.flatten(F.transform(F.array(new), each)) for new in names}
    return wide.withColumns({new: F.array_distinct(a) if distinct else a for new, a in hashes.items()})


def similar(pairs: DataFrame, texts: DataFrame, hubs: bool = False) -> DataFrame:
    """The pairs (u, v, ...) whose exact Jaccard similarity, of their sets of shingles, is enough. pairs and texts are written tables; hubs: a line
    may be u in a large part of all pairs."""
    both = pairs
    for end, name in (("u", "a"), ("v", "b")):
        hot = hot_keys(pairs.groupBy(end).agg(F.count("*").alias("n")), end) if hubs and end == "u" else []
        own = texts.select(F.col("h").alias(end), F.col("line").alias(name), F.col("size").alias(f"size_{name}"))
        both = spread_join(both, own, [end], hot, by=F.xxhash64("u", "v"))
    alike = both.where(_sized("size_a", "size_b"))
    # the intersection has each shingle once, and the sizes are known
    sets = _shingled(alike, distinct=False, a="a", b="b").select(*pairs.columns, F.col("size_a").alias("x"), F.col("size_b").alias("y"), F.size(F.array_intersect("a", "b")).alias("n"))
    return written(sets.where(F.col("n") >= (F.col("x") + F.col("y") - F.col("n")) * SIMILARITY).select(*pairs.columns), "line-links")


def _sized(x: str, y: str):
    """Whether sets of these sizes can be similar."""
    return F.least(x, y) >= F.greatest(x, y) * SIMILARITY


def open_lines(members: DataFrame, labels: DataFrame, pivots: int = 0) -> DataFrame:
    """(key, h, label, open, main, p0 ..): the lines of large buckets in which not all lines are known to be connected, with the number of the bucket's lines,
    the label of its first pivot and so many pivots, the same for all of them. labels: (node, root); lines of a label are connected, and a line without one is its own."""
    labelled = members.join(labels.select(F.col("node").alias("h"), F.col("root").alias("label")), "h", "left").withColumn("label", F.coalesce("label", "h"))
    labelled = written(labelled.select("key", "h", "label"), "line-labels")
    some = [F.min_by("h", F.xxhash64("h", F.lit(k))).alias(f"p{k}") for k in range(pivots)]
    parted = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("open"), F.min_by("label", "h").alias("main"), *some).where("a <> b").drop("a", "b")
    opened = written(spread_join(labelled, parted, ["key"], hot_keys(parted, "key", "open")), "line-open")
    discard(labelled)
    return opened


def sketched(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, size, o0 ..) of each open line: its number of shingles, and the parity of how many of them hash to each bit of o."""
    sets = _shingled(opened.select("h").distinct().join(texts, "h"), distinct=False, a="line")
    # most lines have no shingle twice, which their sizes tell
    once = F.when(F.size("a") == F.col("size"), F.col("a")).otherwise(F.array_distinct("a"))
    each = sets.select("h", "size", F.explode(once).alias("s"))
    bit = F.expr("shiftleft(1L, cast(shiftright(s, 8) & 63 as int))")
    words = [F.bit_xor(F.when(F.col("s").bitwiseAND(F.lit(SKETCH - 1)) == k, bit).otherwise(F.lit(0))).alias(f"o{k}") for k in range(SKETCH)]
    return written(each.groupBy("h", "size").agg(*words), "line-sketches")


def _labelled(sketches: DataFrame, opened: DataFrame) -> DataFrame:
    return sketches.join(opened.groupBy("h").agg(F.min("label").alias("label")), "h")


def _ends(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    def end(name):
        return lines.select(*(F.col(c) if c in ("key", "s") else F.col(c).alias(f"{name}_{c}") for c in lines.columns))

    return end("u"), end("v")


def _possible():
    """Whether two lines, not known to be connected, can be similar. Each shingle that only one of them has changes one bit of the sketches'
    difference, so that has no more bits than there are such shingles; at a similarity of 0.8 these are a ninth of both sizes at most."""
    bits = sum((F.bit_count(F.col(f"u_o{k}").bitwiseXOR(F.col(f"v_o{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("u_o0").bitwiseXOR(F.col("v_o0"))))
    few = bits * (1 + SIMILARITY) <= (F.col("u_size") + F.col("v_size")) * (1 - SIMILARITY) + 1e-6
    return (F.col("u_label") != F.col("v_label")) & _sized("u_size", "v_size") & few


def pivot_pairs(opened: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of each line of a bucket of over PIVOTED open lines with the bucket's pivots."""
    large = opened.where(F.col("open") > PIVOTED)
    ends = large.select("h", F.explode(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("p")).where("h <> p")
    pairs = ends.select(F.least("h", "p").alias("u_h"), F.greatest("h", "p").alias("v_h")).distinct()
    u, v = _ends(sketches)
    return pairs.join(u, "u_h").join(v, "v_h").where(_possible())


def small_pairs(opened: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of lines of a bucket with up to SMALL open lines, each in the first bucket that both are in. Of two lines of different labels one at least
    hasn't the bucket's main label, which most have: only those are compared with the others."""
    near = opened.where(F.col("open") <= SMALL).select("key", "h", "main")
    own = near.groupBy("h").agg(F.collect_set("key").alias("keys")).join(sketches, "h")
    rows = near.join(own, "h").withColumn("main", F.col("main") == F.col("label"))
    u, v = _ends(rows)
    once = F.col("v_main") | (F.col("u_h") < F.col("v_h"))
    met = u.where("not u_main").join(v, "key").where(once & _possible() & (F.array_min(F.array_intersect("u_keys", "v_keys")) == F.col("key")))
    return met.drop("key", "u_keys", "v_keys", "u_main", "v_main")


def prefix_pairs(opened: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of the open lines of larger buckets: all that can be similar, by prefix filtering.

    Only shingles that lines of two labels have can be shared by such a pair. A line needs 0.8 of its shingles to be among these, or has
    no partner. With all shingles in one order, rarest first, two similar lines share one among the first (so many as they have,
    less what they need, and one) of each, so only these are joined; and after the first one that they share, both have enough left to
    share what they need. A passage that many lines quote is frequent, and stands at the end of each line's order.
    """
    large = opened.where(F.col("open") > SMALL).groupBy("h").agg(F.min("label").alias("label"))
    sets = _shingled(large.join(texts, "h"), a="line").select("h", "label", "size", F.explode("a").alias("s"))
    rows = written(sets, "line-shingles")
    counts = rows.groupBy("s").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    counts = written(counts.where("a <> b").select("s", "n"), "line-shingle-counts")
    met = written(spread_join(rows, counts, ["s"], hot_keys(counts, "s")), "line-shingles-met")
    discard(rows, counts)
    need = F.ceil(F.col("size") * SIMILARITY - 1e-9)
    enough = met.groupBy("h").agg(F.count("*").alias("m"), F.max("size").alias("size")).where(F.col("m") >= need).select("h", "m")
    place = F.row_number().over(Window.partitionBy("h").orderBy("n", "s"))
    first = met.join(enough, "h").withColumn("place", place).where(F.col("place") <= F.col("m") - need + 1)
    u, v = _ends(first.select("s", "h", (F.col("m") - F.col("place") + 1).alias("rest")).join(sketches, "h"))
    shared = (F.col("u_size") + F.col("v_size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    return u.join(v, "s").where((F.col("u_h") < F.col("v_h")) & _possible() & (F.least("u_rest", "v_rest") >= shared))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v), labels: those of the pairs that are similar."""
    pairs = written(pairs.select(F.col("u_h").alias("u"), F.col("v_h").alias("v"), "u_label", "v_label").distinct(), "line-pairs")
    links = similar(pairs, texts).select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    discard(pairs)
    return links


def _moved(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): rooted, with the roots connected that links (u, v) connect."""
    top = cut(components(links).select(F.col("node").alias("root"), F.col("root").alias("top")))
    moved = rooted.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = top.select(F.col("root").alias("node"), F.col("top").alias("root")).join(rooted.select("node"), "node", "left_anti")
    return cut(moved.unionByName(alone))


def connected(found: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, root) of the distinct lines that are connected with others: those of all pairs of a bucket that are similar.

    First the lines of a bucket are compared with its pivot. That settles buckets of two, and those whose lines are all connected by
    now. Lines of larger buckets are compared with some more pivots. In what is left, pairs that aren't known to be connected are compared: in small buckets all whose sketches leave a similarity
    of 0.8 possible, in larger ones those of them that share one of their rarest shingles. Neither condition loses a link. signed: the signatures of found,
    which are deleted once they aren't needed.
    """
    pairs, members = candidates(signed)
    discard(signed)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()
    texts = _shingled(texts_of(found, ends), a="line").select("h", "line", F.size("a").alias("size"))
    texts = written(texts, "line-texts")
    rooted = cut(components(similar(pairs, texts, hubs=True)))
    opened = open_lines(members, rooted, PIVOTS)
    sketches = sketched(opened, texts)
    left = opened
    if not opened.where(F.col("open") > PIVOTED).isEmpty():
        # whole components, not only the lines around a pivot, spare most pairs of large groups
        rooted = _moved(rooted, _linked(pivot_pairs(opened, _labelled(sketches, opened)), texts))
        left = open_lines(opened.select("key", "h"), rooted)
        discard(opened)
    marked = _labelled(sketches, left)
    further = [small_pairs(left, marked)]
    if not left.where(F.col("open") > SMALL).isEmpty():
        further.append(prefix_pairs(left, marked, texts).drop("s", "u_rest", "v_rest"))
    rooted = _moved(rooted, _linked(reduce(DataFrame.unionByName, further), texts))
    discard(pairs, members, texts, sketches, left)
    return rooted


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line_no (from 0), keep id and line_no, group_size, kept.

    Lines are split at line feeds and compared trimmed, in lower case, as sets of 10-character shingles; lines
    connected by similarities of 0.8 or more are a group, of which the first line stays, by id (null first),
    then line_no. Blank lines always stay and have no row; null and empty texts have none.
    Equal lines are one node, told apart by two 64-bit hashes. Rows that repeat an id have equal lines at equal
    places, which stay or go together. No rows in, no rows out; other columns are not read.
    """
    found, signed = signed_lines(written(lines(docs, id_col, text_col), "lines"))
    repeated = written(signed.where("n > 1").select("h", "n"), "line-counts")
    grouped = connected(found, signed).withColumnRenamed("node", "h")
    alone = repeated.join(grouped, "h", "left_anti").select("h", F.col("h").alias("root"))
    known = cut(grouped.unionByName(alone))
    found = found.select("id", "line_no", "h")
    # most lines are in no group, and go to the answer without a shuffle
    near, far = likely(found, known, "h"), likely(found, known, "h", others=True)
    marked = spread_join(near, known, ["h"], hot_keys(repeated, "h"), "left", by=F.xxhash64("id", "line_no"))
    placed = written(marked.select("id", "line_no", "root"), "line-groups")
    groups = placed.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("group_size"))
    groups = cut(groups)
    answer = spread_join(placed.where("root is not null"), groups, ["root"], hot_keys(groups, "root", "group_size"), by=F.xxhash64("id", "line_no"))
    single = far.select("id", "line_no").unionByName(placed.where("root is null").select("id", "line_no"))
    single = single.select("id", "line_no", F.struct("id", "line_no").alias("first"), F.lit(1).cast("long").alias("group_size"))
    return answer.select("id", "line_no", "first", "group_size").unionByName(single).select(
        F.col("id").alias(id_col),
        "line_no",
        F.col("first.id").alias(f"keep_{id_col}"),
        F.col("first.line_no").alias("keep_line_no"),
        "group_size",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the lines that don't stay taken out of the text; a null text stays null.

    Nulls, empty texts, repeated rows and empty tables: as fuzzy_lines.
    """
    lid, gone = own_name("_lid", docs), own_name("_gone", docs)
    dropped = fuzzy_lines(docs, id_col, text_col).where("not kept").groupBy(F.col(id_col).alias(lid)).agg(F.collect_set("line_no").alias(gone))
    joined = docs.join(dropped, F.col(id_col).eqNullSafe(F.col(lid)), "left")
    left = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    return joined.withColumn(text_col, F.array_join(left, "\n")).select(*docs.columns)
