"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorspark.llm.alignment import op11_token_alignment
from factorspark.llm.bpe import op6_bpe
from factorspark.llm.collocations import OP12_SQL, op12_collocations
from factorspark.llm.decontam import op1_decontaminate
from factorspark.llm.exact import OP7_SQL, op7_exact_dedup
from factorspark.llm.language import op10_language
from factorspark.llm.licenses import op8_licenses
from factorspark.llm.neardup import op4_neardup
from factorspark.llm.quality import op5_quality
from factorspark.llm.simhash import op13_simhash
from factorspark.llm.suffix import op2_repeats
from factorspark.llm.toxicity import op3_toxicity
from factorspark.llm.urls import OP9_SQL, op9_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_repeats": op2_repeats,
    "op3_toxicity": op3_toxicity,
    "op4_neardup": op4_neardup,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_licenses": op8_licenses,
    "op9_urls": op9_urls,
    "op10_language": op10_language,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}
ORACLE: dict[str, str] = {"op7_exact_dedup": OP7_SQL, "op9_urls": OP9_SQL, "op12_collocations": OP12_SQL}
