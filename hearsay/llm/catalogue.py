"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from hearsay.llm import chat, decontaminate, packing, private, quality, secrets, simhash, topk, urls, warc

QUERIES = {
    "op1_neighbour_quality": quality.query,
    "op2_simhash_neardup": simhash.query,
    "op3_warc_reassembly": warc.query,
    "op4_winnowing_decontamination": decontaminate.query,
    "op5_kdtree_topk": topk.query,
    "op6_private_spans": private.query,
    "op7_secret_forest": secrets.query,
    "op8_certified_packing": packing.query,
    "op9_chat_formatting": chat.query,
    "op10_url_filter": urls.query,
}
ORACLES: dict[str, str] = {
    "op3_warc_reassembly": warc.ORACLE,
    "op4_winnowing_decontamination": decontaminate.ORACLE,
    "op5_kdtree_topk": topk.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
}
