"""The subpackage's queries by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, infill, language, lines, mixing, neardup, oracles, packing, quality, recompression, runs, secrets, spotsigs, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": spotsigs.op1_spotsigs,
    "op2_substrings": substrings.op2_substrings,
    "op3_minhash": neardup.op3_minhash,
    "op4_recompression": recompression.op4_recompression,
    "op5_secrets": secrets.op5_secrets,
    "op6_lines": lines.op6_lines,
    "op7_language": language.op7_language,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_runs": runs.op11_runs,
    "op12_mixing": mixing.op12_mixing,
    "op13_infill": infill.op13_infill,
}

ORACLES: dict[str, str] = {
    "op2_substrings": oracles.SUBSTRINGS,
    "op3_minhash": oracles.MINHASH,
    "op4_recompression": oracles.RECOMPRESSION,
    "op6_lines": oracles.LINES,
    "op10_decontamination": oracles.DECONTAMINATION,
    "op12_mixing": oracles.MIXING,
    "op13_infill": oracles.INFILL,
}
