"""Operators of a training-data pipeline, each with a query over its whole table."""

from .ann_search import op8_ann_search
from .language_id import op1_language_id
from .license_scan import op10_license_scan
from .lm_scores import op5_lm_scores
from .ngram_jaccard import OP6_SQL, op6_ngram_jaccard_join
from .secret_scan import op2_secret_scan
from .sequence_packing import op9_sequence_packing
from .sharding import OP11_SQL, op11_weighted_hash_tree
from .source_mix import op3_source_mix
from .token_alignment import op12_token_alignment
from .token_counts import op7_token_counts
from .vector_codes import OP13_SQL, op13_vector_codes
from .winnowing import op4_winnowing


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_secret_scan": op2_secret_scan,
        "op3_source_mix": op3_source_mix,
        "op4_winnowing": op4_winnowing,
        "op5_lm_scores": op5_lm_scores,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_token_counts": op7_token_counts,
        "op8_ann_search": op8_ann_search,
        "op9_sequence_packing": op9_sequence_packing,
        "op10_license_scan": op10_license_scan,
        "op11_weighted_hash_tree": op11_weighted_hash_tree,
        "op12_token_alignment": op12_token_alignment,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql():
    return {"op6_ngram_jaccard_join": OP6_SQL, "op11_weighted_hash_tree": OP11_SQL, "op13_vector_codes": OP13_SQL}
