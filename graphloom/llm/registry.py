"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import (
    decontamination,
    exact_dedup,
    fill_in_middle,
    line_dedup,
    ngram_join,
    packing,
    quality,
    secret_scan,
    spelling,
    token_counts,
    token_store,
    toxicity,
    warc,
)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_store": token_store.op10_token_store,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_spelling_groups": spelling.op12_spelling_groups,
    "op13_secret_scan": secret_scan.op13_secret_scan,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_spelling_groups": spelling.OP12_SQL,
}
