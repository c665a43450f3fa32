"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.bpe import op2_bpe
from tessella.llm.decontaminate import OP1_SQL, op1_decontamination
from tessella.llm.html_text import op7_html_extraction
from tessella.llm.language_id import op5_language_id
from tessella.llm.line_dedup import OP8_SQL, op8_line_dedup
from tessella.llm.near_dedup import op6_simhash_near_dedup
from tessella.llm.pieces import op12_sentencepiece
from tessella.llm.quality_model import op3_quality_classifier
from tessella.llm.quality_rules import OP4_SQL, op4_quality_rules
from tessella.llm.runs import OP13_SQL, op13_periodic_runs
from tessella.llm.sharding import OP9_SQL, op9_sharding
from tessella.llm.toxicity import op10_toxicity
from tessella.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_sharding": OP9_SQL,
    "op13_periodic_runs": OP13_SQL,
}
