"""Registered queries of the corpus-preparation operators."""

from __future__ import annotations

from .chat import op4_chat
from .decontaminate import op1_decontaminate
from .divergence import OP12_SQL, op12_source_divergence
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import op10_mixing
from .quality import OP6_SQL, op6_quality
from .secrets import op9_secrets
from .shards import op13_sharding
from .simhash import op7_simhash
from .token_files import op3_token_files
from .tokens import op2_token_counts
from .toxicity import op5_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_sharding": op13_sharding,
}
ORACLE: dict[str, str] = {"op6_quality": OP6_SQL, "op8_warc": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_source_divergence": OP12_SQL}
