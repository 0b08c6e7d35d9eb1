"""Queries of the general data-processing problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespan.operators.redelivery import redelivered
from lorespan.operators.timestamps import corpus_timestamps
from lorespan.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return corpus_timestamps(table(spark, d, "fetch_corpus"), table(spark, d, "claims"), table(spark, d, "mailboxes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivered(table(spark, d, "fetch_corpus"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found}

_ID = r"nullif(lower(regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g')), '')"
ORACLES = {
    "p5_found": f"SELECT ord FROM (SELECT ord, {_ID} AS id, min(ord) OVER (PARTITION BY {_ID}) AS kept FROM fetch_corpus) WHERE id IS NOT NULL AND ord > kept",
}
