"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontam, lattice, license_scan
from .decontam import op8_decontaminate
from .langid import op9_language
from .lattice import op3_lattice
from .license_scan import op6_licenses
from .pii import op1_pii
from .piece import op7_sentencepiece
from .quality import op4_quality
from .rollup import op2_token_counts
from .simhash import op10_simhash
from .toxicity import op5_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_lattice": op3_lattice,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
}

SQL: dict[str, str] = {
    "op3_lattice": lattice.sql_of(),
    "op6_licenses": license_scan.sql_of(),
    "op8_decontaminate": decontam.sql_of(),
}
