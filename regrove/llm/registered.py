"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regrove.llm.decontaminate import OP5_SQL, op5_decontaminate
from regrove.llm.embedding_dedup import op12_embedding_dedup
from regrove.llm.html_text import op10_html_text
from regrove.llm.lm import op4_lm_score
from regrove.llm.mixing import op3_source_mix
from regrove.llm.order_minhash import op7_order_minhash
from regrove.llm.pii import op9_pii
from regrove.llm.resample import OP11_SQL, op11_resample
from regrove.llm.secrets import op6_secrets
from regrove.llm.simhash import op1_simhash_dedup
from regrove.llm.token_alignment import op13_token_alignment
from regrove.llm.toxicity import op2_toxicity
from regrove.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_source_mix": op3_source_mix,
        "op4_lm_score": op4_lm_score,
        "op5_decontaminate": op5_decontaminate,
        "op6_secrets": op6_secrets,
        "op7_order_minhash": op7_order_minhash,
        "op8_warc": op8_warc,
        "op9_pii": op9_pii,
        "op10_html_text": op10_html_text,
        "op11_resample": op11_resample,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_token_alignment": op13_token_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op5_decontaminate": OP5_SQL, "op8_warc": OP8_SQL, "op11_resample": OP11_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
