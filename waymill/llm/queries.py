"""Queries of this subpackage for the driver: opN_<name> and, where SQL can say it, the oracle."""

from __future__ import annotations

from waymill.llm import decontaminate, kdtree, langid, lines, minhash, mixing, secrets, substrings, toxicity, urltree

QUERIES = {
    "op1_url_filter": urltree.op1_url_filter,
    "op2_langid": langid.op2_langid,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_topk": kdtree.op5_topk,
    "op6_near_dups": minhash.op6_near_dups,
    "op7_substrings": substrings.op7_substrings,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {
    "op4_mixing": mixing.OP4_SQL,
    "op5_topk": kdtree.OP5_SQL,
    "op7_substrings": substrings.OP7_SQL,
    "op9_line_dedup": lines.OP9_SQL,
}
