"""The registered text queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op6_bpe
from tidemark.llm.decontamination import OP5_SQL, op5_benchmark_decontamination
from tidemark.llm.importance_resampling import OP11_SQL, op11_importance_resampling
from tidemark.llm.language_id import op8_language_id
from tidemark.llm.license_scan import OP2_SQL, op2_license_scan
from tidemark.llm.ngram_jaccard_join import OP7_SQL, op7_ngram_jaccard_join
from tidemark.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from tidemark.llm.pii import op4_pii
from tidemark.llm.quality_classifier import op9_quality_classifier
from tidemark.llm.quality_rules import op3_quality_rules
from tidemark.llm.secret_scan import op1_secret_scan
from tidemark.llm.source_mixing import OP13_SQL, op13_source_mixing
from tidemark.llm.substring_dedup import OP10_SQL, op10_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_bpe": op6_bpe,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_mixing": op13_source_mixing,
}

#: The others encode text, learn models or propagate constants, which SQL cannot say.
ORACLE: dict[str, str] = {
    "op2_license_scan": OP2_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_source_mixing": OP13_SQL,
}
