"""The registered queries of this subpackage and, where SQL can state them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallysift.llm.decontaminate import op6_benchmark_decontamination
from tallysift.llm.html import op8_html_extraction
from tallysift.llm.kneser_ney import op4_quality_classifier
from tallysift.llm import licenses, oracles
from tallysift.llm.line_dedup import op1_line_dedup
from tallysift.llm.media import op5_media_columns
from tallysift.llm.mixing import op7_mix_sources
from tallysift.llm.signature_join import op3_jaccard_join
from tallysift.llm.suffix_dedup import op10_suffix_dedup
from tallysift.llm.warc import OP2_SQL, op2_warc_members

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_members": op2_warc_members,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_media_columns": op5_media_columns,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_mix_sources": op7_mix_sources,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op3_jaccard_join": oracles.JACCARD,
    "op7_mix_sources": oracles.MIXING,
    "op10_suffix_dedup": oracles.SUBSTRINGS,
    "op2_warc_members": OP2_SQL,
    "op9_license_scan": licenses.oracle(),
}
