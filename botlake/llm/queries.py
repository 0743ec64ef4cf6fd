"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cdc import op7_substring_dedup
from .codes import OP12_SQL, op12_vector_codes
from .ctph import op3_fingerprints
from .langid import op1_language_id
from .manifest import OP13_SQL, op13_merkle_manifest
from .minhash import op9_minhash_near_dedup
from .packing import op10_packing
from .pagediff import op6_html_extraction
from .quality import op8_quality_classifier
from .sentencepieces import op5_sentencepiece
from .tokencounts import op11_token_counts
from .urls import OP4_SQL, op4_url_filters
from .vectors import op2_embedding_near_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op4_url_filters": op4_url_filters,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_html_extraction": op6_html_extraction,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_packing": op10_packing,
        "op11_token_counts": op11_token_counts,
        "op12_vector_codes": op12_vector_codes,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": OP4_SQL, "op12_vector_codes": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
