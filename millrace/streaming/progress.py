"""Progress of jobs from a stream of lines.

A line is a marker and a JSON object; other lines and unknown stages are dropped. State is a maximum
per (job, stage), so the same aggregate runs over a table and, in update mode, over a stream, and lines that come
twice or late change nothing wrongly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "@@progress "
#: The stages of a job, in order.
STAGES = ("uploading", "preparing", "reading", "verifying", "building", "completed")
_SCHEMA = "stage string, state string, ms long, page int, pages int, page_complete boolean"


def parsed(lines: DataFrame) -> DataFrame:
    """lines (job_id, line) -> job_id and the fields of each readable line."""
    body = F.from_json(F.substring("line", F.lit(len(MARKER) + 1), F.length("line")), _SCHEMA)
    return lines.where(F.col("line").startswith(MARKER)).select(*[c for c in lines.columns if c != "line"], body.alias("b")).select("*", "b.*").drop("b").where(F.col("stage").isin(*STAGES))


def state(lines: DataFrame) -> DataFrame:
    """job_id, stage, ms (the largest reported), pages_done."""
    return parsed(lines).groupBy("job_id", "stage").agg(F.max(F.when(F.col("state") == "done", F.col("ms"))).alias("ms"), F.max(F.when(F.col("page_complete"), F.col("page"))).alias("pages_done"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new text files in a folder; a job's lines are in files named after it."""
    lines = spark.readStream.format("text").load(path)
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("job_id"), F.col("value").alias("line"))
