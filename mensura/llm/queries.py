"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, exact_dedup, html_text, langid, line_dedup, lm_scoring, mixing, sharding, simhash
from .common import table


def op1_hyperdimensional(spark, sf_dir):
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op2_block_labeller(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_window_simhash(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_virtual_slots(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_tree_merge(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_ppm(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op7_entropy_balancing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def op8_pigeonring(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


#: The contract's own conversation: control strings and an escape inside the texts.
ODD = r"\### Assistant: </turn> ok"


def op9_token_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(odd)))


def op10_fuzzy_lines(spark, sf_dir):
    return line_dedup.fuzzy_lines(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hyperdimensional, op2_block_labeller, op3_window_simhash, op4_virtual_slots, op5_tree_merge, op6_ppm, op7_entropy_balancing, op8_pigeonring, op9_token_assembly, op10_fuzzy_lines)}

ORACLES = {"op5_tree_merge": exact_dedup.ORACLE, "op9_token_assembly": chat.ORACLE}
