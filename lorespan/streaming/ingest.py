"""Incremental ingestion of claims with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespan.operators.dedup import resolve_conflicts
from lorespan.schema import CLAIMS, clean_claims, names_of

BUCKETS = 64


def ingest_claims(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Claims of new files in ``incoming`` are added to ``store`` exactly once per claim id.

    The store is partitioned by a hash of the id, so a batch is compared only
    with the buckets its ids fall into.  Files are named after the batch: a
    batch that is run again after a failure replaces its own files.
    """
    stream = spark.readStream.schema(CLAIMS).json(incoming)

    def add(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("id").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "id"]), "ord").alias("r")).select("id", "r.*").select(*batch.columns)
        new = first.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        session = batch.sparkSession
        try:
            known = session.read.parquet(store).where(F.col("batch") != number)
            buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            new = new.join(known.where(F.col("bucket").isin(buckets)).select("id", "bucket"), ["id", "bucket"], "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch has no store yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_claims(spark: SparkSession, store: str) -> DataFrame:
    """The ingested claims with conflicts resolved; late facts take their place by ``valid_from``."""
    return resolve_conflicts(clean_claims(spark.read.parquet(store).select(*names_of(CLAIMS))))


def current_claims_of(spark: SparkSession, store: str, touched: DataFrame) -> DataFrame:
    """As :func:`current_claims`, but only of the (subject_id, relation) that ``touched`` holds: what a new batch can change."""
    keys = touched.select("subject_id", "relation").distinct()
    claims = spark.read.parquet(store).select(*names_of(CLAIMS)).join(keys, ["subject_id", "relation"], "left_semi")
    return resolve_conflicts(clean_claims(claims.select(*names_of(CLAIMS))))


def first_events(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark, for streams delivered at least once."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
