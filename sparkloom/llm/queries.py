"""The queries of this subpackage for the driver's contract, and SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op4_decontamination
from .fingerprint import op6_fingerprints
from .langid import op2_language_id
from .minhash import OP3_SQL, op3_minhash
from .packing import op9_packing
from .quality import op5_quality
from .secrets import op8_secrets
from .substrings import OP10_SQL, op10_substrings
from .toxicity import op7_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_minhash": op3_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_substrings": op10_substrings,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op3_minhash": OP3_SQL, "op10_substrings": OP10_SQL}
