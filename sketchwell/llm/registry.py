"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import audit, fingerprints, langid, licenses, lm, minhash, packing, pieces, pii, quality, simhash, toxicity, trie


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_quality": quality.op3_quality,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_pii": pii.op6_pii,
        "op7_lm": lm.op7_lm,
        "op8_licenses": licenses.op8_licenses,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
        "op11_minhash": minhash.op11_minhash,
        "op12_trie": trie.op12_trie,
        "op13_audit": audit.op13_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": quality.ORACLE_SQL, "op8_licenses": licenses.ORACLE_SQL, "op11_minhash": minhash.ORACLE_SQL, "op12_trie": trie.ORACLE_SQL, "op13_audit": audit.ORACLE_SQL}
