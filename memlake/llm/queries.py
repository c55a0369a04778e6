"""Queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from memlake.llm.embedding_dedup import op1_embedding_dedup
from memlake.llm.imatch import op4_fingerprints
from memlake.llm.lz_dedup import op9_substring_dedup
from memlake.llm.packing import op6_packing
from memlake.llm.pieces import op3_sentencepiece
from memlake.llm.pii import op5_pii
from memlake.llm.simhash import op10_simhash
from memlake.llm.suffix_dedup import op2_suffix_dedup
from memlake.llm.toxicity import op8_toxicity
from memlake.llm.url_filter import ORACLE as URL_ORACLE
from memlake.llm.url_filter import op7_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_suffix_dedup, op3_sentencepiece, op4_fingerprints, op5_pii, op6_packing, op7_url_filter, op8_toxicity, op9_substring_dedup, op10_simhash)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op7_url_filter": URL_ORACLE}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
