"""Queries of the operators for text and names over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.llm.conversations import conversations
from lorespan.llm.encode import count_tokens, encode_corpus
from lorespan.llm.names import entity_clusters, same_entity_pairs
from lorespan.llm.packing import MAX_KINDS, pack
from lorespan.llm.pii import personal_items, redact
from lorespan.llm.quoted import newly_written
from lorespan.llm.sentences import split_sentences
from lorespan.llm.survivors import representatives, surviving_claims
from lorespan.session import stash, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_entity_pairs(table(spark, d, "entities"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return entity_clusters(table(spark, d, "entities")).select("ord", "representative")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "fetch_corpus"), table(spark, d, "mailboxes"))


def p3_quotes(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, with quotations as links where ids and subjects give none."""
    return conversations(table(spark, d, "fetch_corpus"), table(spark, d, "mailboxes"), quotes=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal_items(table(spark, d, "fetch_corpus"), table(spark, d, "claims"))
    return found.select("src", "ord", "pos", "kind", "found_text").distinct()


def p4_redact(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "fetch_corpus"), table(spark, d, "claims"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return representatives(table(spark, d, "claims")).select("group_ord", "confidence_ord", "valid_from_ord", "evidence_ord")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return surviving_claims(table(spark, d, "claims"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    texts = newly_written(table(spark, d, "fetch_corpus"), table(spark, d, "raw_corpus"))
    return texts.select("src", "ord", "pos", F.md5("new_text").alias("new_md5"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _kinds(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r.kind, r.capacity_tokens) for r in table(spark, d, "containers").limit(MAX_KINDS + 1).collect()]


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """All texts over the tiers of all capacities."""
    return pack(count_tokens(table(spark, d, "documents")), _kinds(spark, d))


def p9_pack_each(spark: SparkSession, d: str) -> DataFrame:
    """All texts once for each capacity alone."""
    sizes = stash(count_tokens(table(spark, d, "documents")), "sizes")
    parts = [pack(sizes, [kind]) for kind in _kinds(spark, d)]
    return reduce(DataFrame.union, parts)


def p9_properties(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind: containers that hold too much, pieces that do not stand right behind one another, documents that are missing."""
    rows = stash(p9_pack(spark, d), "packed")
    caps = table(spark, d, "containers")
    order = Window.partitionBy("kind", "container_no").orderBy("offset", "doc_id", "part")
    placed = rows.where("container_no is not null").withColumn("at", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    wrong = placed.groupBy("kind", "container_no").agg(F.sum("n_tokens").alias("used"), F.count_if(F.coalesce("at", F.lit(0)) != F.col("offset")).alias("misplaced"))
    of_kind = wrong.join(F.broadcast(caps), "kind").groupBy("kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over"), F.sum("misplaced").alias("misplaced"))
    lost = table(spark, d, "documents").select("doc_id").join(rows.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return caps.select("kind").join(of_kind, "kind", "left").crossJoin(F.broadcast(lost)).select("kind", zero("over"), zero("misplaced"), "lost")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_found": p3_found,
    "p3_quotes": p3_quotes,
    "p4_found": p4_found,
    "p4_redact": p4_redact,
    "p6_found": p6_found,
    "p6_survivors": p6_survivors,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_pack": p9_pack,
    "p9_properties": p9_properties,
    "p9_pack_each": p9_pack_each,
    "p10_found": p10_found,
}
ORACLES = {
    "p9_properties": "SELECT kind, 0::BIGINT AS over, 0::BIGINT AS misplaced, 0::BIGINT AS lost FROM containers",
    "p6_found": r"""
WITH c AS (
 SELECT ord, subject_id AS s, lower(trim(relation, E' \t\n\r')) AS r, object_id AS o,
  CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS cf,
  CASE WHEN regexp_matches(trim(valid_from), '^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?$') THEN epoch_us(TRY_CAST(trim(valid_from) || CASE WHEN regexp_matches(trim(valid_from), '(Z|T.*[+-]\d\d:\d\d)$') THEN '' WHEN contains(valid_from, 'T') THEN 'Z' ELSE ' 00:00:00Z' END AS TIMESTAMPTZ)) END AS vf,
  coalesce(len(list_distinct(list_filter(evidence, lambda e: trim(e.source_id) != '' AND trim(e.exact_quote) != '').list_transform(lambda e: {'a': e.source_id, 'b': e.exact_quote}))), 0) AS n
 FROM claims WHERE subject_id IS NOT NULL AND relation IS NOT NULL AND object_id IS NOT NULL)
SELECT min(ord) AS group_ord,
 coalesce(first(ord ORDER BY cf DESC, ord) FILTER (cf IS NOT NULL), 0) AS confidence_ord,
 coalesce(first(ord ORDER BY vf DESC, ord) FILTER (vf IS NOT NULL), 0) AS valid_from_ord,
 coalesce(first(ord ORDER BY n DESC, ord) FILTER (n > 0), 0) AS evidence_ord
FROM c GROUP BY s, r, o HAVING count(*) > 1
""",
}
