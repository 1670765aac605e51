"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tulkki.llm.decontaminate import op6_decontamination
from tulkki.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from tulkki.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tulkki.llm.language_id import op3_language_id
from tulkki.llm.licenses import op7_licenses
from tulkki.llm.line_dedup import OP9_SQL, op9_line_dedup
from tulkki.llm.mixing import op4_mix_sources
from tulkki.llm.ngram_jaccard import OP5_SQL, op5_ngram_jaccard
from tulkki.llm.quality import op8_quality
from tulkki.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from tulkki.llm.token_alignment import op12_token_alignment
from tulkki.llm.topk import OP2_SQL, op2_topk
from tulkki.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_topk": op2_topk,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_exact_dedup": OP13_SQL,
}
