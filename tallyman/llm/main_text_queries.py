"""op4: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.main_text import extract_main_text
from tallyman.workload.registry import Workload

work = Workload()


@work.query("op4_html_main_text")
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
