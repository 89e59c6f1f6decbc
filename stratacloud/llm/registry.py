"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from stratacloud.llm.embedding_dedup import OP8_SQL, op8_embeddings
from stratacloud.llm.langid import op5_langid
from stratacloud.llm.lm_pitman_yor import op1_lm
from stratacloud.llm.minhash_dedup import OP9_SQL, op9_minhash
from stratacloud.llm.mixing import OP2_SQL, op2_mixing
from stratacloud.llm.quality import op10_quality
from stratacloud.llm.secret_scan import op7_secrets
from stratacloud.llm.sentencepiece_lattice import op4_sentencepiece
from stratacloud.llm.suffix_dedup import op3_suffix
from stratacloud.llm.topk_search import OP6_SQL, op6_topk

QUERIES = {
    "op1_lm": op1_lm,
    "op2_mixing": op2_mixing,
    "op3_suffix": op3_suffix,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_langid": op5_langid,
    "op6_topk": op6_topk,
    "op7_secrets": op7_secrets,
    "op8_embeddings": op8_embeddings,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op6_topk": OP6_SQL,
    "op8_embeddings": OP8_SQL,
    "op9_minhash": OP9_SQL,
}
