"""Corpus, store and graph on disk: Parquet for the engine, JSON for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.operators.graph import Graph
from lorespan.schema import CLAIMS, ENTITIES, ENTITY_TYPES, MERGE_MEMBERS, MERGE_RECORDS, RELATIONS, THREADS, MergeLog, Store, clean_claims


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Threads of a JSON array (each file is read by one task), or of JSON lines, which are split."""
    return spark.read.schema(THREADS).option("multiLine", not lines).json(path)


def write_corpus(threads: DataFrame, path: str, mode: str = "ignore") -> None:
    """Threads as JSON lines; an existing corpus is left alone unless ``mode`` says otherwise."""
    threads.write.mode(mode).json(path)


def valid_entities(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("entity_type").isin(ENTITY_TYPES)).withColumn("name", F.regexp_replace("name", r"(?U)^\s+|\s+$", ""))


def valid_claims(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("id").isNotNull() & F.col("relation").isin(RELATIONS) & F.col("confidence").between(0, 1))


def save_store(store: Store, path: str, mode: str = "overwrite", form: str = "parquet") -> None:
    """The store as a folder of tables, Parquet or JSON lines (``form``), with a row of its scalars."""
    log = store.merge_log
    tables = {"entities": store.entities, "claims": store.claims, "scalars": _scalars(store)}
    if log is not None:
        tables |= {"merge_records": log.records, "merge_members": log.members}
    for name, df in tables.items():
        df.write.mode(mode).format(form).save(f"{path}/{name}")
    if log is None and mode == "overwrite":
        _remove(store.entities.sparkSession, f"{path}/merge_records", f"{path}/merge_members")


SCALARS = "extraction_version string, corpus_source string"


def _scalars(store: Store) -> DataFrame:
    return store.entities.sparkSession.createDataFrame([(store.extraction_version, store.corpus_source)], SCALARS)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = _path(spark, path)
        fs.delete(where, True)


def load_store(spark: SparkSession, path: str, validate: bool = True, form: str = "parquet") -> Store:
    """The store of a folder; with ``validate`` only records that satisfy the types.  A store without a log has none."""
    read = lambda name, schema: spark.read.schema(schema).format(form).load(f"{path}/{name}")
    e, c = read("entities", ENTITIES), clean_claims(read("claims", CLAIMS))
    log = MergeLog(read("merge_records", MERGE_RECORDS), read("merge_members", MERGE_MEMBERS)) if exists(spark, f"{path}/merge_records") else None
    scalars = read("scalars", SCALARS).first()
    return Store(valid_entities(e) if validate else e, valid_claims(c) if validate else c, log, scalars.extraction_version, scalars.corpus_source)


def save_graph(graph: Graph, path: str, mode: str = "overwrite") -> None:
    """Vertices, edges and the counters of ingestion; the ids that were ingested are those of the records themselves."""
    graph.vertices.write.mode(mode).parquet(f"{path}/vertices")
    graph.edges.write.mode(mode).parquet(f"{path}/edges")
    if graph.counters is not None:
        graph.counters.write.mode(mode).parquet(f"{path}/counters")


def load_graph(spark: SparkSession, path: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Graph(read("vertices"), read("edges"), read("counters") if exists(spark, f"{path}/counters") else None)


def save_packs(packs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Context packs (qid, pack) as JSON lines, one pack a line, in files by their question."""
    packs.orderBy("qid").select("pack").write.mode(mode).text(path)


def copy_outputs(spark: SparkSession, source: str, target: str, names: list[str]) -> list[str]:
    """Copies the named tables of a folder, those that exist, as they are; returns their names."""
    done = [n for n in names if exists(spark, f"{source}/{n}")]
    for n in done:
        fs, where = _path(spark, f"{source}/{n}")
        to_fs, to = _path(spark, f"{target}/{n}")
        to_fs.delete(to, True)
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to_fs, to, False, spark.sparkContext._jsc.hadoopConfiguration())
    return done


def node_link_rows(graph: Graph) -> DataFrame:
    """(kind, json): one JSON object per node and per link, for exchange with other graph tools."""
    nodes = graph.vertices.select(F.lit("node").alias("kind"), F.to_json(F.struct(*graph.vertices.columns)).alias("json"))
    links = graph.edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("id").alias("key"), *[c for c in graph.edges.columns if c not in ("subject_id", "object_id", "id")])).alias("json"))
    return nodes.union(links)
