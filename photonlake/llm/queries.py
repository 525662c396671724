"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op5_hilbert_neighbours
from .decontaminate import op2_decontaminate
from .html import op7_main_text
from .jaccard import ORACLE_SQL as JACCARD_SQL
from .jaccard import op8_jaccard_join
from .lattice import op9_lattice
from .mixing import ORACLE_SQL as MIX_SQL
from .mixing import op1_mix
from .quality import op10_quality
from .substring import op6_substring_dedup
from .url_filter import ORACLE_SQL as URL_SQL
from .url_filter import op3_url_filter
from .warc import ORACLE_SQL as AUDIT_SQL
from .warc import op4_merkle_audit

QUERIES = {
    "op1_mix": op1_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_merkle_audit": op4_merkle_audit,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_main_text": op7_main_text,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_lattice": op9_lattice,
    "op10_quality": op10_quality,
}

ORACLE: dict[str, str] = {"op1_mix": MIX_SQL, "op3_url_filter": URL_SQL, "op4_merkle_audit": AUDIT_SQL, "op8_jaccard_join": JACCARD_SQL}
