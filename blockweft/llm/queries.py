"""The registered queries of this subpackage, with their SQL equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run

from .centroids import op13_centroids, op13_sql
from .codebooks import op12_sql, op12_vector_codes
from .decontaminate import op5_decontamination
from .dedup_exact import OP9_SQL, op9_exact_dedup
from .html import op2_html_text
from .jaccard import op8_jaccard_join
from .language import op3_language
from .mixing import OP6_SQL, op6_mixing
from .secrets import op1_secrets
from .sharding import op4_sharding, op4_sql
from .simhash import op11_simhash
from .surrogates import op10_pii
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_centroids": op13_centroids,
    "pipeline": run,
}
ORACLE_SQL: dict[str, str] = {"op4_sharding": op4_sql(), "op6_mixing": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op12_vector_codes": op12_sql(), "op13_centroids": op13_sql()}
