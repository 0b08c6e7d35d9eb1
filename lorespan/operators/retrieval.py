"""Questions answered with ranked, grounded context packs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lorespan.operators.graph import Graph, neighbors
from lorespan.schema import Settings
from lorespan.session import bounded_broadcast

DIMENSIONS = 64
#: Most questions of one call whose vectors are sent to all tasks; more of them are joined.
MAX_QUERIES = 10_000


def embed_texts(texts: list[str | None]) -> np.ndarray:
    """Deterministic offline vectors: signed counts of hashed letter trigrams, of unit length.  They do not reach a model's quality.

    The first four hexadecimal digits of a trigram's MD5 give its place, the fifth its sign.
    """
    out = np.zeros((len(texts), DIMENSIONS))
    for k, t in enumerate(texts):
        padded = f"  {(t or '').lower()} "
        for i in range(len(padded) - 2):
            at, sign = _trigram(padded[i : i + 3])
            out[k, at] += sign
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@lru_cache(maxsize=100_000)
def _trigram(gram: str) -> tuple[int, int]:
    digest = hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()
    return int(digest[:4], 16) % DIMENSIONS, 1 if int(digest[4], 16) % 2 else -1


def embed(text: Column, embedder: Callable[[list[str | None]], np.ndarray] = embed_texts) -> Column:
    """Column of vectors by a pluggable embedder."""
    f = F.pandas_udf(lambda s: pd.Series(list(np.asarray(embedder(s.tolist()), float))), ArrayType(DoubleType()))
    return f(text)


def name_index(vertices: DataFrame) -> DataFrame:
    """(entity_id, spos, surface): one row per name and alias that is not empty."""
    surfaces = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return vertices.select(F.col("id").alias("entity_id"), "ord", F.posexplode(surfaces).alias("spos", "surface")).where("surface != ''")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, entity_id, spos, sim): the ``k`` most similar index rows of each query (qid, qvec); ties by id.

    A stated set of queries meets all rows: as matrix products of a batch of rows with blocks of queries, each of which
    leaves its ``k`` best rows (and those equal to the last of them).  Only these are shuffled.  More than MAX_QUERIES
    queries are not sent to the tasks but joined.
    """
    rows = [(r.qid, r.qvec) for r in queries.select("qid", "qvec").where("qvec is not null").limit(MAX_QUERIES + 1).collect()]
    order = [F.desc("sim"), F.col("entity_id"), F.col("spos")]
    best = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    if len(rows) > MAX_QUERIES:
        return best(index.crossJoin(queries.select("qid", "qvec")).select("qid", "entity_id", "spos", dot(F.col("vec"), F.col("qvec")).alias("sim")))
    qids, matrix = [q for q, _ in rows], np.array([v for _, v in rows], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(qids):
                continue
            x, ids, spos = np.stack(b["vec"].to_numpy()).astype(float), b["entity_id"].to_numpy(), b["spos"].to_numpy()
            for at in range(0, len(qids), QUERY_BLOCK):
                sims = matrix[at : at + QUERY_BLOCK] @ x.T
                last = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
                i, j = np.nonzero(sims >= last[:, None])
                yield pd.DataFrame({"qid": np.array(qids[at : at + QUERY_BLOCK])[i], "entity_id": ids[j], "spos": spos[j], "sim": sims[i, j]})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (index, "entity_id"), (index, "spos"))}
    vectors = index.select("entity_id", "spos", "vec").where("vec is not null")
    return best(vectors.mapInPandas(run, f"qid {kinds['qid']}, entity_id {kinds['entity_id']}, spos {kinds['spos']}, sim double"))


#: Queries of one matrix product.
QUERY_BLOCK = 512


#: Most words, and most pairs of a query and one of its words, that are sent to all tasks; more of them are joined by sorting.
MAX_WORDS = 50_000


def _joined_to_few(many: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Inner join that never broadcasts ``many``: the optimiser takes exploded names for much smaller than they are."""
    sent = bounded_broadcast(few, MAX_WORDS)
    return many.join(sent, on) if sent is not few else many.hint("merge").join(few, on)


def _asked_words(queries: DataFrame) -> DataFrame:
    """(qid, words): the different words of three letters or more of each query."""
    words = F.filter(F.split(F.lower("question"), r"\s+"), lambda w: F.length(w) >= 3)
    return queries.select("qid", words.alias("words")).groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))


def _found_words(vertices: DataFrame, asked: DataFrame) -> DataFrame:
    """(entity_id, found): the words of all queries that an entity has in its name or an alias; no row without any.

    A word stands in a name only if its first three letters do, so words and names meet by equal trigrams.  Each word is
    looked for once, however many queries have it.
    """
    words = asked.select(F.explode("words").alias("word")).distinct().withColumn("gram", F.substring("word", 1, 3))
    surfaces = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    s = vertices.select(F.col("id").alias("entity_id"), F.explode(surfaces).alias("surface")).where(F.length("surface") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("surface") - 2), lambda i: F.substring(F.col("surface"), i, F.lit(3))))
    s = s.select("entity_id", "surface", F.explode(grams).alias("gram"))
    return _joined_to_few(s, words, "gram").where(F.contains("surface", "word")).groupBy("entity_id").agg(F.collect_set("word").alias("found"))


def keyword_match(vertices: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, entity_id): entities with a query word of three letters or more in their name or an alias.

    A pair comes out at the first of the query's words that the entity has, so the pairs, which may be far more than the
    entities, are neither compared nor shuffled.
    """
    asked = _asked_words(queries)
    tasks = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by size these few rows would be one task
    found = _found_words(vertices, asked).repartition(tasks, "entity_id").withColumn("word", F.explode("found"))
    pairs = _joined_to_few(found, asked.withColumn("word", F.explode("words")), "word")
    return pairs.where(F.element_at(F.array_intersect("words", "found"), 1) == F.col("word")).select("qid", "entity_id")


def match_entities(graph: Graph, index: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(qid, entity_id, score, rank): blended vector and keyword score, best first.

    Entities found by words alone have equal scores, so those of lowest id rank first.  A query has at most
    ``index_rows`` entities by vector, so among the first ``index_rows + top_entities`` of each word there are all that
    can rank; the others are never paired with queries.
    """
    asked = _asked_words(queries)
    found = _found_words(graph.vertices, asked)
    near = vector_topk(index, queries, settings.index_rows).select("qid", "entity_id", "sim")
    near = near.join(asked, "qid", "left").join(found.hint("merge"), "entity_id", "left").select("qid", "entity_id", "sim", F.coalesce(F.arrays_overlap("words", "found"), F.lit(False)).alias("hit"))
    first = found.select("entity_id", F.explode("found").alias("word"))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("entity_id"))).where(F.col("_r") <= settings.index_rows + settings.top_entities)
    named = _joined_to_few(first, asked.select("qid", F.explode("words").alias("word")), "word").select("qid", "entity_id", F.lit(None).cast("double").alias("sim"), F.lit(True).alias("hit"))
    blended = near.unionByName(named).groupBy("qid", "entity_id").agg(F.max("sim").alias("sim"), F.max("hit").alias("hit"))
    score = F.coalesce("sim", F.lit(settings.keyword_base)) + F.when(F.col("hit"), settings.keyword_boost).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entity_id"))
    return blended.select("qid", "entity_id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= settings.top_entities)


def retrieve(graph: Graph, matched: DataFrame, settings: Settings = Settings(), include_historical: bool = True) -> DataFrame:
    """Ranked context items of each query for its matched entities (:func:`match_entities`).

    Relevance is the entity's score times confidence, more for current and less
    for historical claims; each claim counts for its best entity.  A query that
    matches nothing has no items.
    """
    edges = graph.edges if include_historical else graph.edges.where(F.coalesce("is_current", F.lit(True)))
    around = neighbors(edges, matched.select(F.col("entity_id").alias("id")).distinct(), current_only=False)
    rows = around.join(matched, "entity_id")
    best = Window.partitionBy("qid", "id").orderBy("rank", F.desc("direction"))
    rows = rows.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    current = F.coalesce("is_current", F.lit(True))
    rows = rows.withColumn("relevance", F.col("score") * F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)) * F.when(current, 1.2).otherwise(0.8))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "rank", F.desc("direction"), "ord"))
    top = rows.withColumn("place", place).where(F.col("place") <= settings.top_claims)
    names = graph.vertices.select("id", "name")
    top = top.join(names.toDF("subject_id", "s_name"), "subject_id", "left").join(names.toDF("object_id", "o_name"), "object_id", "left")
    return top.select(
        "qid", "place", F.col("id").alias("claim_id"), F.coalesce("s_name", "subject_id").alias("subject"), "relation", F.coalesce("o_name", "object_id").alias("object"),
        "confidence", current.alias("is_current"), "valid_from", F.coalesce("valid_until", F.lit("")).alias("valid_until"), "evidence", "relevance",
    )


def context_packs(items: DataFrame, matched: DataFrame, vertices: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, pack JSON): question, matched entities and items; scores rounded half to even to three places."""
    e = matched.join(vertices.select(F.col("id").alias("entity_id"), "name", "entity_type", "aliases"), "entity_id")
    entities = e.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity_id", "name", "entity_type", "aliases", F.bround("score", 3).alias("match_score")))), lambda x: x.dropFields("rank")).alias("matched_entities"))
    rows = F.struct("place", "claim_id", "subject", "relation", "object", "confidence", "is_current", "valid_from", "valid_until", "evidence", F.bround("relevance", 3).alias("relevance_score"))
    packed = items.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(rows)), lambda x: x.dropFields("place")).alias("items"))
    out = queries.select("qid", F.col("question").alias("query")).join(entities, "qid", "left").join(packed, "qid", "left")
    return out.select("qid", F.to_json(F.struct("query", "matched_entities", "items")).alias("pack"))


def format_context(items: DataFrame, matched: DataFrame, vertices: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, context): the question, the matched entities and numbered claim blocks as text for a model."""
    e = matched.join(vertices.select(F.col("id").alias("entity_id"), "name", "entity_type", "aliases"), "entity_id")
    also = F.when(F.size("aliases") > 0, F.concat(F.lit(" (aliases: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("  - "), "name", F.lit(" ["), "entity_type", F.lit("]"), also)
    entities = e.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "\n").alias("names"))
    heads = queries.select("qid", "question").join(entities, "qid", "left").join(claim_blocks(items), "qid", "left")
    parts = [F.concat(F.lit("CONTEXT FOR QUERY: "), "question", F.lit("\n")), F.concat(F.lit("MATCHED ENTITIES:\n"), "names", F.lit("\n")), F.lit("RELEVANT CLAIMS (ranked by relevance):"), F.col("blocks")]
    return heads.select("qid", F.concat_ws("\n", *parts).alias("context"))


def claim_blocks(items: DataFrame) -> DataFrame:
    """(qid, blocks): numbered claims with status and evidence, best first."""
    status = F.when(F.col("is_current"), F.lit("CURRENT")).otherwise(F.concat(F.lit("HISTORICAL (until "), "valid_until", F.lit(")")))
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    quote = lambda e: F.concat(F.lit("\n      EVIDENCE [source: "), known(e.source_id), F.lit("]:\n        \""), F.coalesce(e.exact_quote, F.lit("")), F.lit("\"\n        -- "), known(e.author), F.lit(" at "), known(e.timestamp))
    quotes = F.array_join(F.transform(F.coalesce("evidence", F.array().cast(items.schema["evidence"].dataType)), quote), "")
    confidence = F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)).cast("string")
    block = F.concat(
        F.lit("\n  ["), F.col("place").cast("string"), F.lit("] "), "subject", F.lit(" --"), "relation", F.lit("--> "), "object",
        F.lit("\n      Status: "), status, F.lit(" | Confidence: "), confidence, F.lit("\n      Valid from: "), F.coalesce("valid_from", F.lit("None")), quotes,
    )
    return items.select("qid", "place", block.alias("block")).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x.block), "\n").alias("blocks"))


# Fixed value: the answer where nothing was found.
NO_ANSWER = "I couldn't find any relevant information in the memory graph for that query."


def answer(items: DataFrame, queries: DataFrame, generator: Callable[[str, str], str] | None = None) -> DataFrame:
    """(qid, answer): by a pluggable generator; without one the claims themselves, and a fixed text where nothing was found."""
    joined = queries.select("qid", "question").join(claim_blocks(items).withColumnRenamed("blocks", "context"), "qid", "left")
    if generator is None:
        return joined.select("qid", F.coalesce("context", F.lit(NO_ANSWER)).alias("answer"))

    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for question, context in zip(q, c):
            try:
                out.append(generator(question, context) if context else NO_ANSWER)
            except Exception as e:  # noqa: BLE001 - any failure of a model service
                out.append(f"{e}\n{context}")
        return pd.Series(out)

    return joined.select("qid", F.pandas_udf(run, "string")("question", "context").alias("answer"))
