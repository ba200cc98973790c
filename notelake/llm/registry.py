"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from notelake.llm.chat import OP3_SQL, op3_chat_snapshots
from notelake.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from notelake.llm.filter_audit import OP11_SQL, op11_filter_audit
from notelake.llm.fingerprints import op2_fingerprints
from notelake.llm.mixing import OP1_SQL, op1_mixture
from notelake.llm.near_dedup import OP8_SQL, op8_minhash
from notelake.llm.packing import op4_best_fit
from notelake.llm.quality import op5_quality
from notelake.llm.repeats import OP6_SQL, op6_repeats
from notelake.llm.suffix_dedup import OP13_SQL, op13_suffix_dedup
from notelake.llm.toxicity import op10_toxicity
from notelake.llm.trie import OP12_SQL, op12_prefix_trie
from notelake.llm.warc import op7_warc

QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_fingerprints": op2_fingerprints,
    "op3_chat_snapshots": op3_chat_snapshots,
    "op4_best_fit": op4_best_fit,
    "op5_quality": op5_quality,
    "op6_repeats": op6_repeats,
    "op7_warc": op7_warc,
    "op8_minhash": op8_minhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL = {
    "op1_mixture": OP1_SQL,
    "op3_chat_snapshots": OP3_SQL,
    "op6_repeats": OP6_SQL,
    "op8_minhash": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
