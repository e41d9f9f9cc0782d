"""The queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidewarden.llm.class_ngrams import op11_class_ngrams
from tidewarden.llm.merkle import merkle_sql, op13_merkle_manifest
from tidewarden.llm.mixing import mixing_sql, op8_hierarchical_mixing
from tidewarden.llm.media import op7_media_columns
from tidewarden.llm.order_minhash import op5_order_minhash
from tidewarden.llm.packing import op4_best_fit_packing
from tidewarden.llm.periodic_runs import op12_periodic_runs
from tidewarden.llm.quality import op6_quality_cotraining
from tidewarden.llm.simhash import op3_simhash_near_dedup
from tidewarden.llm.substring_dedup import op2_substring_dedup
from tidewarden.llm.token_file import op1_token_file
from tidewarden.llm.toxicity import op9_toxicity
from tidewarden.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {f.__name__: f for f in (op1_token_file, op2_substring_dedup, op3_simhash_near_dedup, op4_best_fit_packing, op5_order_minhash, op6_quality_cotraining, op7_media_columns, op8_hierarchical_mixing, op9_toxicity, op10_url_filter, op11_class_ngrams, op12_periodic_runs, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op8_hierarchical_mixing": mixing_sql(), "op10_url_filter": OP10_SQL, "op13_merkle_manifest": merkle_sql()}
