"""Queries of the training-data operators, with SQL where SQL can express them."""

from lumenkg.llm.ann import op9_kmeans_tree_search
from lumenkg.llm.clusters import OP12_SQL, op12_centroid_clusters
from lumenkg.llm.html_extract import op6_block_html
from lumenkg.llm.langid import op4_crf_language
from lumenkg.llm.linededup import OP13_SQL, op13_line_dedup
from lumenkg.llm.merkle import OP11_SQL, op11_merkle_manifest
from lumenkg.llm.neardup import OP5_SQL, op5_minhash_neardup
from lumenkg.llm.packing import op1_hierarchical_packing
from lumenkg.llm.pii import op7_bootstrapped_pii
from lumenkg.llm.quality import OP10_SQL, op10_line_quality
from lumenkg.llm.spm import op3_sentencepiece_roundtrip
from lumenkg.llm.toxicity import op2_crf_toxicity
from lumenkg.llm.url_filter import OP8_SQL, op8_url_sweep

QUERIES = {
    "op1_hierarchical_packing": op1_hierarchical_packing,
    "op2_crf_toxicity": op2_crf_toxicity,
    "op3_sentencepiece_roundtrip": op3_sentencepiece_roundtrip,
    "op4_crf_language": op4_crf_language,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_block_html": op6_block_html,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_url_sweep": op8_url_sweep,
    "op9_kmeans_tree_search": op9_kmeans_tree_search,
    "op10_line_quality": op10_line_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES = {
    "op5_minhash_neardup": OP5_SQL,
    "op8_url_sweep": OP8_SQL,
    "op10_line_quality": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
