"""op8: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm.html_text import main_text


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op8_html_text": op8_html_text}
#: SQL has no HTML parser: tests hold the result against pages of known articles.
ORACLE: dict[str, str] = {}
