"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroid_clustering
from .counts import op1_token_counts
from .dialogue import OP13_SQL, op13_conversation_repair
from .langid import op2_language_id
from .mixing import OP8_SQL, op8_poisson_mixing
from .neardup import op4_minhash_near_dedup
from .packing import op6_best_fit_packing
from .quality import op3_quality_rules
from .repeats import op7_suffix_array_dedup
from .secrets import op9_secret_scan
from .sites import op10_quality_classifier
from .slack import op11_minimum_slack_packing
from .topk import OP5_SQL, op5_exact_top_k

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_minimum_slack_packing": op11_minimum_slack_packing,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op5_exact_top_k": OP5_SQL,
    "op8_poisson_mixing": OP8_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
