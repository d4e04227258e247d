"""The registered queries of this subpackage."""

from __future__ import annotations

from . import embeddings
from .decontaminate import op7_decontaminate
from .embeddings import op1_embeddings
from .licenses import op4_licenses
from .packing import op5_packing
from .pii import op6_personal_data
from .quality import op3_quality
from .sharding import op2_sharding
from .simhash import op9_simhash
from .token_counts import op8_token_counts
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_embeddings, op2_sharding, op3_quality, op4_licenses, op5_packing, op6_personal_data, op7_decontaminate, op8_token_counts, op9_simhash, op10_toxicity)}
ORACLE_SQL = {"op1_embeddings": embeddings.ORACLE}
