"""The narrow page rules on a stream of pages; site rules need the whole site and stay batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import AuditConfig, page_findings
from ..operators.pages import parsed_pages, responses_from_pages

PAGES = "page_id long, url string, html string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of raw pages as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_findings(pages: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Findings of each new page: stateless, so any output mode and any scale-out works."""
    parsed = parsed_pages(responses_from_pages(pages))
    return parsed.select("page_ord", F.explode(F.array(*page_findings(cfg))).alias("f")).where("f IS NOT NULL").select("page_ord", "f.*")
