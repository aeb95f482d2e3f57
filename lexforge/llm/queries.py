"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexforge.llm import bpe, chat, hmm, hnsw, media, mixing, neardup, repair, resampling, suffixes, toxicity, urls, warc

QUERIES = {
    "op1_hmm": hmm.op1_hmm,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_hnsw": hnsw.op3_hnsw,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_media": media.op9_media,
    "op10_url_filter": urls.op10_url_filter,
    "op11_chat": chat.op11_chat,
    "op12_repair": repair.op12_repair,
    "op13_resample": resampling.op13_resample,
}
#: Ops 1, 3, 4, 5, 7, 8 and 9 can't be said in SQL; tests hold them against brute force.
SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op6_warc": warc.OP6_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op11_chat": chat.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_resample": resampling.OP13_SQL,
}
