"""Incremental ingest: a stream of record files merged into a versioned table. The batch engine needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rosterlake.session import exists, names_in
from rosterlake.sources.sinks import upsert_replace


def latest_version(spark: SparkSession, home: str, below: int | None = None) -> int:
    """Number of the newest complete version under `home` (any storage Spark reads), -1 if there is none."""
    found = sorted((int(n[1:]) for n in names_in(spark, home) if n.startswith("v") and n[1:].isdigit()), reverse=True)
    return next((n for n in found if (below is None or n < below) and exists(spark, f"{home}/v{n}/_SUCCESS")), -1)


def merge_stream(spark: SparkSession, source: str, schema: StructType, home: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Start a stream of JSON files in `source`: each batch replaces rows with its keys and writes the next version.

    Of several rows of a key in one batch the one latest by `order` stands. A batch that is run again writes the same
    version again, so a lost executor or driver leaves no half-written state behind.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        before = latest_version(spark, home, number)
        merged = upsert_replace(spark.read.parquet(f"{home}/v{before}"), newest, keys) if before >= 0 else newest
        merged.write.mode("overwrite").parquet(f"{home}/v{number}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
