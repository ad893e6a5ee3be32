"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.decontaminate import op4_decontaminate
from weirflow.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from weirflow.llm.langid import op2_langid
from weirflow.llm.licenses import op5_licenses
from weirflow.llm.line_dedup import op6_line_dedup
from weirflow.llm.lm_score import op1_lm_score
from weirflow.llm.packing import op10_packing
from weirflow.llm.sharding import op8_sharding
from weirflow.llm.simhash import op9_simhash
from weirflow.llm.suffix_dedup import op7_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_langid": op2_langid,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_licenses": op5_licenses,
        "op6_line_dedup": op6_line_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_sharding": op8_sharding,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run: all stages over the whole table `documents`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    """SQL by query, where it can say the same on whole tables."""
    return {"op3_embedding_dedup": OP3_SQL}
