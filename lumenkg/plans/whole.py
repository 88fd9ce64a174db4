"""Second names of queries: <name>_all were twins over every triplet, row or turn, which the queries themselves now read."""

from lumenkg import registry
from lumenkg.plans import cards, course, graph, kg, knowledge, matching, retrieval  # noqa: F401  (they register the queries)

TWINS = """a22_node_origin a25_entity_texts f12_triage f19_apply_review f20_align_properties f9_f10_delta_filter g14_expand g15_hop_tags
g16_two_hop_pool g23_display_graph g25_isolated_nodes g3_trust_seeds g4_pagerank g5_components g6_long_components i10_fragment_importance
i13_chapter_view i3_discourse_channel i4_structure_channel i5_blend_channels j2_clip_evidence k1_vector_topk m2_prepared_tree m8_merge_trees
r12_image_paths r1_bm25_topk r3_hybrid_search r7_history_window r8_citations s13_graphml s14_cypher u8_filtered_relations x21_snippets""".split()

for _name in TWINS:
    registry.query(f"{_name}_all", registry._ORACLES.get(_name))(registry._QUERIES[_name])
