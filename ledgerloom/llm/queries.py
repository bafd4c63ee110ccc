"""The registered queries of this package and the SQL to check them."""

from __future__ import annotations

from . import (
    audit, bpe, embeddings, language, licenses, lines, mixing, packing, pii, quality, runs, simhash,
    spotsigs,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_lines": lines.op3_lines,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_licenses": licenses.op8_licenses,
    "op9_pii": pii.op9_pii,
    "op10_language": language.op10_language,
    "op11_audit": audit.op11_audit,
    "op12_bpe": bpe.op12_bpe,
    "op13_runs": runs.op13_runs,
}
ORACLES = mixing.ORACLES | audit.ORACLES
