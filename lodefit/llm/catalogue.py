"""The registered text queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from lodefit.llm.alignment import op13_alignment
from lodefit.llm.bpe import op9_bpe
from lodefit.llm.html_text import op8_html_text
from lodefit.llm.langid import op1_langid
from lodefit.llm.licenses import op12_license_scan
from lodefit.llm.pfair import op5_pfair
from lodefit.llm.quality_knn import op2_quality_knn
from lodefit.llm.quality_rules import op4_quality_rules
from lodefit.llm.secret_ledger import OP3_SQL, op3_secret_ledger
from lodefit.llm.simhash import op7_simhash
from lodefit.llm.substring import OP6_SQL, op6_substring
from lodefit.llm.vector_codes import OP11_SQL, op11_vector_codes
from lodefit.llm.vector_join import OP10_SQL, op10_vector_join

QUERIES = {
    "op1_langid": op1_langid,
    "op2_quality_knn": op2_quality_knn,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_quality_rules": op4_quality_rules,
    "op5_pfair": op5_pfair,
    "op6_substring": op6_substring,
    "op7_simhash": op7_simhash,
    "op8_html_text": op8_html_text,
    "op9_bpe": op9_bpe,
    "op10_vector_join": op10_vector_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_license_scan": op12_license_scan,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op3_secret_ledger": OP3_SQL,
    "op6_substring": OP6_SQL,
    "op10_vector_join": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
}
