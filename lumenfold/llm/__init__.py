"""Operators for preparing text corpora at scale; nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable

from lumenfold.llm import bpe, fingerprints, jaccard, langid, licenses, masked_lm, packing, quality, secrets, sharding, trie, urls, whitening

QUERIES: dict[str, Callable] = {
    "op1_kneser_ney_langid": langid.op1_kneser_ney_langid,
    "op2_weak_supervision": quality.op2_weak_supervision,
    "op3_link_trust": urls.op3_link_trust,
    "op4_masked_likelihood": masked_lm.op4_masked_likelihood,
    "op5_harmonic_packing": packing.op5_harmonic_packing,
    "op6_multiset_hash": fingerprints.op6_multiset_hash,
    "op7_token_combinations": jaccard.op7_token_combinations,
    "op8_virtual_slots": sharding.op8_virtual_slots,
    "op9_randomness_battery": secrets.op9_randomness_battery,
    "op10_tree_bpe": bpe.op10_tree_bpe,
    "op11_centroid_trie": trie.op11_centroid_trie,
    "op12_bidiagonal_whitening": whitening.op12_bidiagonal_whitening,
    "op13_containment_join": licenses.op13_containment_join,
}

ORACLE_SQL: dict[str, str] = {"op7_token_combinations": jaccard.ORACLE, "op11_centroid_trie": trie.ORACLE, "op13_containment_join": licenses.ORACLE}
