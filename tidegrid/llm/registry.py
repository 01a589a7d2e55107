"""The queries of the text operators."""

from __future__ import annotations

from .chats import OP6_SQL, op6_chat_formatting
from .fingerprints import OP3_SQL, op3_merkle_fingerprints
from .jaccard_join import OP7_SQL, op7_ngram_jaccard_join
from .language_id import op10_language_id
from .licences import OP1_SQL, op1_license_scans
from .masked_lm import op5_masked_lm_scoring
from .neighbours import op8_nn_descent
from .packing import op9_best_fit_packing
from .resampling import OP13_SQL, op13_importance_resampling
from .sentencepiece_sampling import op4_sentencepiece_sampling
from .simhash import op11_simhash_near_dedup
from .suffix_dedup import OP2_SQL, op2_suffix_array_dedup
from .whitening import op12_embedding_whitening


def queries() -> dict:
    found = (
        op1_license_scans, op2_suffix_array_dedup, op3_merkle_fingerprints, op4_sentencepiece_sampling, op5_masked_lm_scoring,
        op6_chat_formatting, op7_ngram_jaccard_join, op8_nn_descent, op9_best_fit_packing, op10_language_id,
        op11_simhash_near_dedup, op12_embedding_whitening, op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": OP1_SQL, "op2_suffix_array_dedup": OP2_SQL, "op3_merkle_fingerprints": OP3_SQL, "op6_chat_formatting": OP6_SQL,
        "op7_ngram_jaccard_join": OP7_SQL, "op13_importance_resampling": OP13_SQL,
    }
