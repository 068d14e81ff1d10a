"""The text operators as queries: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express one."""

from __future__ import annotations

import corpus_pipeline
from haulcomp.llm import blocknames, hardnegatives, mixing
from haulcomp.llm.binary import op2_token_ids
from haulcomp.llm.blocknames import op11_exact_dedup
from haulcomp.llm.chat import op5_chat_format
from haulcomp.llm.decontaminate import op9_benchmark_decontamination
from haulcomp.llm.hardnegatives import op12_hard_negatives
from haulcomp.llm.jaccard import op7_jaccard_join
from haulcomp.llm.lines import op10_line_dedup
from haulcomp.llm.mixing import op3_mixing
from haulcomp.llm.ngrams import op4_lm_scoring
from haulcomp.llm.quality import op8_quality_rules
from haulcomp.llm.substrings import op6_substring_dedup
from haulcomp.llm.unigram import op1_token_counts
from haulcomp.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_token_ids, op3_mixing, op4_lm_scoring, op5_chat_format, op6_substring_dedup, op7_jaccard_join,
        op8_quality_rules, op9_benchmark_decontamination, op10_line_dedup, op11_exact_dedup, op12_hard_negatives,
        op13_whitening,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.sql(), "op11_exact_dedup": blocknames.sql(), "op12_hard_negatives": hardnegatives.sql()}
