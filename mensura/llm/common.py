"""Reading tables, cutting lineage and the few settings that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are maximal runs of other characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch handed to Python: texts can be very long, so batches are short.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs in one process, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mensura-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, materialised once in the shared folder; a lost executor costs a read, not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def one_map(spark: SparkSession):
    """Aggregates of plans that are made and run in here have one hash map a task, not a small one before it."""
    name = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_remainder(id_col: str, k: int):
    """crc32 of the id written as text, modulo k; the folds of the contracts. A null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % k, F.lit(0))


def written(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """The same rows, from a table of its own in the shared folder; compressed, so better than cut for wide rows.

    A dictionary of values that nearly all differ only costs time, at each reading, too.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", dictionary).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once nothing that is still to run reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it has over one in so many of the rows: there are fewer hot keys than that, whatever the table.
HOT_SHARE = 256
#: Tasks that the rows of a hot key are dealt over.
HOT_PARTS = 128


def hot_keys(counted: DataFrame, key: str, n: str = "n") -> list:
    """The hot keys of a table with a row for each key and its count."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counted.where(F.col(n) > total / HOT_SHARE).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list, how: str = "inner", by=None) -> DataFrame:
    """left joined with right, which has one row a key: rows of left whose first key is hot are dealt over many tasks.

    What deals them is `by`, or else a row's place in left, which then has to be a written table or a checkpoint, so
    that a task that is run again deals them alike.
    """
    if not hot:
        return left.join(right, keys, how)
    is_hot = reduce(lambda a, b: a | b, [F.col(keys[0]).isin(hot[i : i + 64]) for i in range(0, len(hot), 64)])
    whole = F.array(F.lit(0))
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id() if by is None else by, F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(whole)))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def own_name(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until no frame has a column that differs from it in case only."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Words of 64 bits in a map by which rows are passed over whose key isn't wanted: 16 bits a key, this many words
#: at most, so that what is broadcast is bounded; a fuller map passes over fewer rows, and loses none.
MAP_WORDS = 1 << 20


def likely(rows: DataFrame, wanted: DataFrame, key: str, others: bool = False) -> DataFrame:
    """rows whose key, a hash, may be among the wanted ones (distinct keys): all that are, and few others; or the other rows. No shuffle of rows."""
    words = min(MAP_WORDS, 1 << max(4, (wanted.count() // 4).bit_length()))
    word, place = F.pmod(F.shiftright(key, 6), F.lit(words)), F.expr(f"cast({key} & 63 as int)")
    mapped = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(mapped), "_word", "left" if others else "inner")
    bit = F.call_function("shiftright", F.col("_bits"), place).bitwiseAND(F.lit(1).cast("long"))
    return found.where(F.coalesce(bit, F.lit(0)) == 0 if others else bit == 1).drop("_word", "_bits")
