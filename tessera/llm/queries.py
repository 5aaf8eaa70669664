"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import op5_chat
from .clustering import OP11_SQL, op11_clustering
from .decontamination import op10_decontamination
from .html_extraction import op1_html
from .jaccard import op3_jaccard
from .language import op13_language
from .mixing import OP6_SQL, op6_mixing
from .periodic import op12_periodic
from .quality import op9_quality
from .repetition import op2_repetition
from .suffixes import op7_suffix_dedup
from .templates import op4_line_dedup
from .warc import op8_warc

QUERIES = {"op1_html": op1_html, "op2_repetition": op2_repetition, "op3_jaccard": op3_jaccard, "op4_line_dedup": op4_line_dedup, "op5_chat": op5_chat, "op6_mixing": op6_mixing, "op7_suffix_dedup": op7_suffix_dedup, "op8_warc": op8_warc, "op9_quality": op9_quality, "op10_decontamination": op10_decontamination, "op11_clustering": op11_clustering, "op12_periodic": op12_periodic, "op13_language": op13_language}
SQL = {"op6_mixing": OP6_SQL, "op11_clustering": OP11_SQL}
