"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .jaccard_join import op4_jaccard_join
from .media import op7_media
from .neighbours import op2_neighbours
from .packing import op9_packing
from .pieces import op5_pieces
from .pii import op6_pii
from .quality import op10_quality
from .sharding import op8_sharding
from .toxicity import op1_toxicity
from .url_filter import op3_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_neighbours, op3_url_filter, op4_jaccard_join, op5_pieces, op6_pii, op7_media, op8_sharding, op9_packing, op10_quality)
}

#: Each of them rests on a trained model, a hash or a tokenizer that DuckDB lacks (crc32 and xxhash64 too), or its SQL is too
#: slow on whole tables; tests/llm holds them against brute force instead.
ORACLE_SQL: dict[str, str] = {}
