"""The queries of these operators and their SQL counterparts."""

from __future__ import annotations

from wayfield.llm.id_files import op9_id_files
from wayfield.llm.licenses import OP10_SQL, op10_license_scan
from wayfield.llm.media import op7_media_jpeg
from wayfield.llm.mixing import OP6_SQL, op6_mix_sources
from wayfield.llm.mtree import OP1_SQL, op1_mtree_search
from wayfield.llm.neardup import OP3_SQL, op3_minhash_neardup
from wayfield.llm.packing import op4_pack_sequences
from wayfield.llm.periodic import OP12_SQL, op12_periodic_runs
from wayfield.llm.preferences import OP8_SQL, op8_preference_chat
from wayfield.llm.quality import op2_quality_trees
from wayfield.llm.resampling import OP11_SQL, op11_importance_resample
from wayfield.llm.simhash import op13_simhash_neardup
from wayfield.llm.suffixes import OP5_SQL, op5_suffix_dedup

QUERIES = {
    "op1_mtree_search": op1_mtree_search,
    "op2_quality_trees": op2_quality_trees,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_media_jpeg": op7_media_jpeg,
    "op8_preference_chat": op8_preference_chat,
    "op9_id_files": op9_id_files,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resample": op11_importance_resample,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash_neardup": op13_simhash_neardup,
}

ORACLE = {
    "op1_mtree_search": OP1_SQL,
    "op3_minhash_neardup": OP3_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op8_preference_chat": OP8_SQL,
    "op10_license_scan": OP10_SQL,
    "op11_importance_resample": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
}
