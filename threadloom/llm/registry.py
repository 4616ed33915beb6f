"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from threadloom.llm import bpe, collocation, embeddings, language, mainext, mixture, packing, pii, prefixtrie, quality, sharding, simhash, warc_zip

QUERIES = {
    "op1_suffix_repetition": quality.op1_suffix_repetition,
    "op2_sampled_splitters": sharding.op2_sampled_splitters,
    "op3_nearest_centroid": language.op3_nearest_centroid,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_zip_packages": warc_zip.op5_zip_packages,
    "op6_line_blocks": mainext.op6_line_blocks,
    "op7_sorted_projections": embeddings.op7_sorted_projections,
    "op8_gray_index": simhash.op8_gray_index,
    "op9_best_fit": packing.op9_best_fit,
    "op10_bilstm_crf": pii.op10_bilstm_crf,
    "op11_mixture_packing": mixture.op11_mixture_packing,
    "op12_collocations": collocation.op12_collocations,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_suffix_repetition": quality.ORACLE,
    "op5_zip_packages": warc_zip.ORACLE,
    "op7_sorted_projections": embeddings.ORACLE,
    "op12_collocations": collocation.ORACLE,
    "op13_prefix_trie": prefixtrie.ORACLE,
}
