"""Registered queries of the subpackage, and their SQL counterparts."""

from wardledger.llm import exact, lines, negatives, secret_scan, urls
from wardledger.llm.alignment import op12_token_alignment
from wardledger.llm.binary import op9_token_binary
from wardledger.llm.decontaminate import op5_benchmark_decontamination
from wardledger.llm.exact import op7_exact_dedup
from wardledger.llm.jaccard import op2_jaccard_join
from wardledger.llm.lines import op6_line_dedup
from wardledger.llm.lm import op1_lm_scoring
from wardledger.llm.negatives import op13_hard_negatives
from wardledger.llm.packing import op10_best_fit_packing
from wardledger.llm.quality import op8_quality_classifier
from wardledger.llm.secret_scan import op11_secret_scan
from wardledger.llm.tokens import op4_token_counts
from wardledger.llm.urls import op3_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_jaccard_join,
        op3_url_filter,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_line_dedup,
        op7_exact_dedup,
        op8_quality_classifier,
        op9_token_binary,
        op10_best_fit_packing,
        op11_secret_scan,
        op12_token_alignment,
        op13_hard_negatives,
    )
}

ORACLE_SQL = {
    "op3_url_filter": urls.SQL,
    "op6_line_dedup": lines.SQL,
    "op7_exact_dedup": exact.SQL,
    "op11_secret_scan": secret_scan.SQL,
    "op13_hard_negatives": negatives.SQL,
}
