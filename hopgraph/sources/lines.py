"""Text lines in file order, and the check for malformed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, file, block, seq)``: lines with a sort key for their position.

    ``block`` is the offset of the split inside its file and ``seq`` grows
    along the split, so (file, block, seq) is the reading order without any
    single-task numbering.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


POS = ("file", "block", "seq")


def content(lines: DataFrame) -> DataFrame:
    """Drop ``#`` comments and blank lines, split on white space."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.withColumn("value", text).filter((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn(
        "tok", F.split("value", " ")
    )


def checked(df: DataFrame, ok: Column, mode: str) -> DataFrame:
    """Apply the row rule: ``strict`` fails the job on a bad row, ``drop`` leaves it out."""
    if mode == "drop":
        return df.filter(ok)
    if mode != "strict":
        raise ValueError("mode is 'strict' or 'drop'")
    good = F.coalesce(ok, F.lit(False))
    note = F.concat(F.lit("malformed row: "), F.coalesce(F.col("value"), F.lit("null")))
    return df.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(note).cast("boolean")))


def rejects(df: DataFrame, ok: Column) -> int:
    """Number of rows that break the rule."""
    return df.filter(~F.coalesce(ok, F.lit(False))).count()
