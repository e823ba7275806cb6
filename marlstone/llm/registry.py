"""Queries of this subpackage and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP3_SQL, op3_format_chat
from .hnsw import OP10_SQL, PLANTED_SQL, near_vectors_planted, op10_near_vectors
from .langid import op5_language
from .lattice import op2_lattice_scores
from .maxscore import OP1_SQL, op1_top_k
from .minhash import op8_near_duplicates
from .packing import op4_pack
from .repeats import op7_remove_repeats
from .sharding import op6_shuffle_shards
from .subword import op9_encode_dropout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_lattice_scores": op2_lattice_scores,
    "op3_format_chat": op3_format_chat,
    "op4_pack": op4_pack,
    "op5_language": op5_language,
    "op6_shuffle_shards": op6_shuffle_shards,
    "op7_remove_repeats": op7_remove_repeats,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_encode_dropout": op9_encode_dropout,
    "op10_near_vectors": op10_near_vectors,
    "near_vectors_planted": near_vectors_planted,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": OP1_SQL,
    "op3_format_chat": OP3_SQL,
    "op10_near_vectors": OP10_SQL,
    "near_vectors_planted": PLANTED_SQL,
}
