"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .bpe_automaton import op7_bpe_automaton
from .cross_polytope import op2_cross_polytope
from .decontaminate import op9_decontaminate
from .html_template import op8_html_template
from .language_ppm import op5_language_ppm
from .minhash_forest import op10_minhash_forest
from .suffix_dedup import op1_suffix_dedup
from .token_files import op4_bit_planes
from .toxicity import op6_toxicity
from .warc import OP3_SQL, op3_warc


def queries():
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_cross_polytope": op2_cross_polytope,
        "op3_warc": op3_warc,
        "op4_bit_planes": op4_bit_planes,
        "op5_language_ppm": op5_language_ppm,
        "op6_toxicity": op6_toxicity,
        "op7_bpe_automaton": op7_bpe_automaton,
        "op8_html_template": op8_html_template,
        "op9_decontaminate": op9_decontaminate,
        "op10_minhash_forest": op10_minhash_forest,
    }


def oracle_sql():
    return {"op3_warc": OP3_SQL}
