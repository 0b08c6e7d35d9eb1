"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers are stored once per time bucket.  Each bucket has a blocked Bloom
filter: one 64-bit word per identifier, with six of its bits set.  All filters
have the same number of words, so one equi-join by word number probes every
other bucket at once.  An identifier that no other filter knows is definitely
new; one that some filter knows is compared exactly with the storage of just
those buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.functions.text import norm_id
from lorespan.session import stash

#: Width of a time bucket, filter bits per identifier of the fullest bucket, bits set per identifier.
BUCKET_DAYS, BITS_PER_ID, BITS_SET = 30, 32, 6


def identifier_store(messages: DataFrame, id_col: str, ord_col: str, time_col: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(bucket, id, first, copies): each identifier of a time bucket once, pre-aggregated before the shuffle."""
    bucket = F.coalesce(F.floor(F.unix_date(F.col(time_col).cast("date")) / bucket_days).cast("int"), F.lit(-1))
    rows = messages.select(norm_id(F.col(id_col)).alias("id"), F.col(ord_col).alias("ord"), bucket.alias("bucket")).where("id is not null")
    return rows.groupBy("bucket", "id").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("copies"))


def _probe(store: DataFrame, words: int) -> DataFrame:
    h = F.xxhash64("id", F.lit(17))
    mask = F.lit(0).cast("bigint")
    for k in range(BITS_SET):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return store.withColumns({"word": F.pmod(F.xxhash64("id"), F.lit(words)), "mask": mask})


def bloom_filters(store: DataFrame, words: int) -> DataFrame:
    """(word, filters ARRAY<STRUCT<bucket, bits>>): the word of every bucket's filter; at most one entry per bucket."""
    per_bucket = _probe(store, words).groupBy("word", "bucket").agg(F.bit_or("mask").alias("bits"))
    return per_bucket.groupBy("word").agg(F.collect_list(F.struct("bucket", "bits")).alias("filters"))


def repeated_identifiers(store: DataFrame) -> DataFrame:
    """(id, first) of every identifier with more than one copy, in one bucket or in several."""
    fullest = store.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
    words = 1 << max(4, (fullest * BITS_PER_ID // 64 - 1).bit_length())
    probed = _probe(store, words)
    known = F.filter("filters", lambda x: (x.bucket < F.col("bucket")) & (x.bits.bitwiseAND(F.col("mask")) == F.col("mask")))
    possible = probed.join(bloom_filters(store, words), "word").select("id", F.explode(F.transform(known, lambda x: x.bucket)).alias("bucket"))
    verified = possible.join(store, ["bucket", "id"], "left_semi").select("id").union(store.where("copies > 1").select("id")).distinct()
    return store.join(verified, "id", "left_semi").groupBy("id").agg(F.min("first").alias("first"))


def redelivered(messages: DataFrame, id_col: str = "message_id", ord_col: str = "ord", time_col: str = "ingested_at") -> DataFrame:
    """(ord) of every row that is not kept.

    Of the rows with one identifier the one with the smallest ``ord`` is kept;
    rows with a null or blank identifier are all kept; rows that repeat the
    kept ``ord`` itself are the same row and kept with it.  A null time falls
    into a bucket of its own.  An empty table gives an empty result; other
    columns are not read.
    """
    store = stash(identifier_store(messages, id_col, ord_col, time_col), "identifiers")
    repeated = repeated_identifiers(store).withColumnRenamed("first", "kept")
    rows = messages.select(norm_id(F.col(id_col)).alias("id"), F.col(ord_col).alias("ord")).where("id is not null")
    return rows.join(repeated, "id").where("ord > kept").select("ord")


def drop_redelivered(messages: DataFrame, id_col: str = "message_id", ord_col: str = "ord", time_col: str = "ingested_at") -> DataFrame:
    """The rows of ``messages`` that are kept, with all their columns."""
    gone = redelivered(messages, id_col, ord_col, time_col)
    return messages.join(gone.withColumnRenamed("ord", "_rd_ord"), F.col(ord_col) == F.col("_rd_ord"), "left_anti")
