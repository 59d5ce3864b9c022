"""op3: all documents in sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.packing import pack_documents
from tallyman.workload.registry import Workload

work = Workload()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files lie on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@work.query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
