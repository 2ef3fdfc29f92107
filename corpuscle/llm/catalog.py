"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import decontaminate, line_rules, ngram_join, packing, quality, repeats, secrets, shards, token_orc, warc

QUERIES = {
    "op1_sharding": shards.op1_sharding,
    "op2_token_orc": token_orc.op2_token_orc,
    "op3_suffix_arrays": decontaminate.op3_suffix_arrays,
    "op4_warc": warc.op4_warc,
    "op5_pairwise_quality": quality.op5_pairwise_quality,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_line_frequency": line_rules.op7_line_frequency,
    "op8_grammar": secrets.op8_grammar,
    "op9_repeats": repeats.op9_repeats,
    "op10_sum_of_squares": packing.op10_sum_of_squares,
}
SQL = {"op1_sharding": shards.OP1_SQL, "op3_suffix_arrays": decontaminate.OP3_SQL, "op4_warc": warc.OP4_SQL, "op7_line_frequency": line_rules.OP7_SQL, "op9_repeats": repeats.OP9_SQL}
