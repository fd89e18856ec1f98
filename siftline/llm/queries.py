"""The registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from siftline.llm import bitpack, decontam, divergence, exact, fill_middle, html_blocks, langid, packing, quality, simhash, suffixes, token_counts, toxicity

QUERIES = {fn.__name__: fn for fn in (
    langid.op1_language_id, quality.op2_quality_rules, packing.op3_packing, simhash.op4_simhash,
    decontam.op5_decontamination, toxicity.op6_toxicity, bitpack.op7_bit_packing,
    token_counts.op8_token_counts, suffixes.op9_suffix_dedup, html_blocks.op10_html_extraction,
    fill_middle.op11_fill_middle, exact.op12_exact_dedup, divergence.op13_source_divergence,
)} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"op9_suffix_dedup": suffixes.OP9_SQL, "op11_fill_middle": fill_middle.OP11_SQL,
                       "op12_exact_dedup": exact.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
