"""Documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and gives the columns of ``documents``; the last gives
pieces of sequences. Every stage's rows are written before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.llm.mixing import mixed_documents
from tallyman.llm.near_dups import drop_near_duplicates
from tallyman.llm.packing import pack_documents
from tallyman.llm.packing_queries import tokenizer_path
from tallyman.llm.quality import drop_low_quality
from tallyman.llm.suffixes import cut_repeats
from tallyman.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored as texts without words; repeated rows are scored alike.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles.

    Rows equal in id and text are one. Null, empty and wordless texts are no duplicates of others.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the copies of passages of 50 words or more; ``n_chars`` follows the text.

    Documents of which nothing is left go; those that had no words before, null ones too, stay.
    """
    cut = cut_repeats(docs, drop_emptied=True)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources as often as the weights say.

    A null source is a source. Null and empty texts count as no tokens and stay.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence of at most 2048 tokens and place there.

    Null and empty texts are their end id alone. Longer documents than a sequence are cut.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]
#: The classifier and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
