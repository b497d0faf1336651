"""The contract queries of the corpus operators, by name."""

from __future__ import annotations

from quillon.llm.bpe import op9_bpe
from quillon.llm.decontaminate import op2_decontaminate
from quillon.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from quillon.llm.language_id import op6_language_id
from quillon.llm.license_scan import OP1_SQL, op1_license_scan
from quillon.llm.line_dedup import OP7_SQL, op7_line_dedup
from quillon.llm.simhash import op8_simhash
from quillon.llm.suffix_dedup import op5_suffix_dedup
from quillon.llm.toxicity import op10_toxicity
from quillon.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
}

SQL = {"op1_license_scan": OP1_SQL, "op3_warc": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL}
