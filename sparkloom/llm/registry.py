"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.decontaminate import op4_decontaminate
from sparkloom.llm.jaccard_join import op3_jaccard_join
from sparkloom.llm.language_crf import op10_language_crf
from sparkloom.llm.lexical_search import OP11_SQL, op11_lexical_search
from sparkloom.llm.minhash_dedup import op13_minhash_dedup
from sparkloom.llm.packing import op7_packing
from sparkloom.llm.pii import op6_pii
from sparkloom.llm.quality_classifier import op2_quality_classifier
from sparkloom.llm.quality_rules import OP1_SQL, op1_quality_rules
from sparkloom.llm.suffix_dedup import op8_suffix_dedup
from sparkloom.llm.token_alignment import op12_token_alignment
from sparkloom.llm.toxicity import op5_toxicity
from sparkloom.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_language_crf": op10_language_crf,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_minhash_dedup": op13_minhash_dedup,
}

SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
}
