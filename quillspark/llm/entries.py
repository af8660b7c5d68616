"""Queries of the training-data operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillspark.llm.bpe import op1_bpe
from quillspark.llm.fingerprints import op5_fingerprints
from quillspark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from quillspark.llm.language import op10_language
from quillspark.llm.minhash import op4_minhash
from quillspark.llm.packing import op3_packing
from quillspark.llm.perspectives import OP9_SQL, op9_perspectives
from quillspark.llm.quality_knn import op7_quality_knn
from quillspark.llm.quality_rules import op2_quality_rules
from quillspark.llm.runs import op13_periodic_runs
from quillspark.llm.substrings import op6_substrings
from quillspark.llm.toxicity import op8_toxicity
from quillspark.llm.warc import OP12_SQL, op12_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    own = [op1_bpe, op2_quality_rules, op3_packing, op4_minhash, op5_fingerprints, op6_substrings, op7_quality_knn, op8_toxicity, op9_perspectives, op10_language, op11_hard_negatives, op12_warc, op13_periodic_runs]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, where SQL can express it."""
    return {"op9_perspectives": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
