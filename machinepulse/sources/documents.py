"""Guide documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from machinepulse.schemas import GUIDE_PAGES, MESSAGES, conform

GUIDE_JSON = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("page", T.IntegerType()),
                        T.StructField("content", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    """Guide documents, one JSON file each, as one row per page.

    The guide's id is a hash of its source name; pages keep their place in the
    document.
    """
    guides = (
        spark.read.schema(GUIDE_JSON)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )
    pages = guides.select(
        F.xxhash64("source").alias("guide_id"), F.posexplode("pages").alias("pos", "entry")
    ).select(
        "guide_id",
        (F.col("pos") + 1).cast("int").alias("position"),
        F.col("entry.page").alias("page"),
        F.col("entry.content").alias("content"),
    )
    return conform(pages, GUIDE_PAGES, "guide_pages")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Conversation turns."""
    return conform(spark.read.parquet(path), MESSAGES, "messages")
