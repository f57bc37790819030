"""Queries of the corpus operators and their SQL, for the repository's entry module."""

from __future__ import annotations

from pathloom.llm import exact, iblt, licenses, mixing, negatives, orc_tokens, packing, repair, secrets, sharding, simhash, suffix, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_exact": exact.op3_exact,
    "op4_iblt": iblt.op4_iblt,
    "op5_secrets": secrets.op5_secrets,
    "op6_orc_tokens": orc_tokens.op6_orc_tokens,
    "op7_packing": packing.op7_packing,
    "op8_suffix": suffix.op8_suffix,
    "op9_licenses": licenses.op9_licenses,
    "op10_mixing": mixing.op10_mixing,
    "op11_repair": repair.op11_repair,
    "op12_sharding": sharding.op12_sharding,
    "op13_negatives": negatives.op13_negatives,
}
ORACLES = {"op3_exact": exact.OP3_SQL, "op10_mixing": mixing.mixing_sql(), "op12_sharding": sharding.OP12_SQL, "op13_negatives": negatives.OP13_SQL}
