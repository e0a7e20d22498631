"""The queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from ranklore.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from ranklore.llm.language_id import op10_language_id
from ranklore.llm.media_store import op4_media
from ranklore.llm.mixing import OP9_SQL, op9_mixing
from ranklore.llm.piece_bpe import op7_piece_bpe
from ranklore.llm.quality import op2_quality
from ranklore.llm.sharding import op6_sharding
from ranklore.llm.simhash_dedup import op3_simhash
from ranklore.llm.token_counts import op5_token_counts
from ranklore.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_media": op4_media,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op9_mixing": OP9_SQL}
