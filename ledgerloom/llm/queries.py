"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html, linededup, mixing, neardup, quality, substring, tokens, toxicity, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_output": tokens.op4_token_output,
    "op5_mixing": mixing.op5_mixing,
    "op6_neardup": neardup.op6_neardup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_linededup": linededup.op8_linededup,
    "op9_substring": substring.op9_substring,
    "op10_warc": warc.op10_warc,
}
ORACLES = {
    "op2_quality": quality.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_neardup": neardup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_linededup": linededup.ORACLE,
    "op9_substring": substring.ORACLE,
    "op10_warc": warc.ORACLE,
}
