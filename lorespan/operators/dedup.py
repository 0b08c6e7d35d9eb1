"""Deduplication of artifacts, entities and claims, conflicts, audit and undo."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorespan.functions.text import clean_artifact, evidence_id, strip
from lorespan.operators.components import connected_components
from lorespan.operators.ranking import next_within, text_slice
from lorespan.schema import CLAIMS, ENTITIES, SINGLE_VALUED, MergeLog, Settings, Store, clean_claims
from lorespan.session import stash


def dedup_artifacts(messages: DataFrame, text: str, order: list[str], comment_id: str, min_text: int = 20) -> DataFrame:
    """Adds ``fingerprint``, ``is_duplicate`` and ``duplicate_of`` (first holder); short texts stay unmarked."""
    clean = clean_artifact(F.coalesce(F.col(text), F.lit("")))
    marked = messages.withColumn("fingerprint", F.when(F.length(clean) >= min_text, F.md5(F.lower(clean))))
    first = marked.where("fingerprint is not null").groupBy("fingerprint").agg(F.min_by(F.struct(F.col(comment_id).alias("c"), *order), F.struct(*order)).alias("f"))
    joined = marked.join(first, "fingerprint", "left")
    later = F.col("fingerprint").isNotNull() & (F.struct(*order) != F.struct(*[F.col(f"f.{o}") for o in order]))
    return joined.withColumn("is_duplicate", F.coalesce(later, F.lit(False))).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("f.c"))).drop("f")


def exact_groups(entities: DataFrame) -> DataFrame:
    """(ord, component): entities of equal type and name (trimmed, regardless of case), by the smallest ``ord``."""
    keyed = entities.select("ord", "entity_type", F.lower(strip(F.col("name"))).alias("k"))
    first = keyed.groupBy("entity_type", "k").agg(F.min("ord").alias("component"))
    return keyed.join(first, ["entity_type", "k"]).select("ord", "component")


#: Vectors in one slice of a cell; a task compares two slices.
SLICE = 2048


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "id", block: str = "block", vec: str = "vec", cells: int = 32, slice_rows: int = SLICE) -> DataFrame:
    """(a, b, sim) of all pairs a < b of one block with a cosine of at least ``threshold``.

    Vectors of a block are put into cells around pivots, at most ``cells`` and
    one for every ``slice_rows`` vectors.  Two cells
    whose angular radii rule out any pair are never compared; the others are
    compared slice by slice as matrix products, so no task holds more than two
    slices however large a block is.  Nothing is lost: the bound is exact.
    """
    v = vectors.select(F.col(key).alias("id"), F.col(block).alias("block"), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")
    pivots = np.array([r.vec for r in v.orderBy(F.xxhash64("id")).limit(max(1, min(cells, v.count() // slice_rows))).collect()])
    if not len(pivots):
        return v.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("sim")).limit(0)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    kind = v.schema["id"].dataType.simpleString()
    block_kind = v.schema["block"].dataType.simpleString()

    def place(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vec"].to_numpy())
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cos = x @ pivots.T
            cell = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1))
            yield pd.DataFrame({"id": b["id"], "block": b["block"], "vec": list(x), "cell": cell.astype("int32"), "angle": angle})

    placed = v.mapInPandas(place, f"id {kind}, block {block_kind}, vec array<double>, cell int, angle double")
    sizes = placed.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    sizes = sizes.withColumn("slices", F.ceil(F.col("n") / slice_rows).cast("int"))
    sliced = placed.join(sizes.select("block", "cell", "slices"), ["block", "cell"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    matrix = F.array(*[F.lit(float(x)) for x in between.ravel()])
    one = sizes.select("block", F.col("cell").alias("c1"), F.col("radius").alias("r1"), F.col("slices").alias("s1"))
    two = sizes.select("block", F.col("cell").alias("c2"), F.col("radius").alias("r2"), F.col("slices").alias("s2"))
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    tasks = one.join(two, "block").where("c1 <= c2").where(F.get(matrix, F.col("c1") * len(pivots) + F.col("c2")) <= F.col("r1") + F.col("r2") + F.lit(reach))
    tasks = tasks.withColumn("k1", F.explode(F.sequence(F.lit(0), F.col("s1") - 1))).withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("s2") - 1)))
    tasks = tasks.where("c1 < c2 or k1 <= k2").select("block", "c1", "k1", "c2", "k2", F.concat_ws(":", "c1", "k1", "c2", "k2").alias("task"))
    sides = tasks.select("block", "task", F.col("c1").alias("cell"), F.col("k1").alias("slice")).union(tasks.select("block", "task", "c2", "k2"))
    spread = sides.distinct().join(sliced, ["block", "cell", "slice"])

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        c1, k1, c2, k2 = map(int, df["task"].iloc[0].split(":"))
        left, right = df[(df["cell"] == c1) & (df["slice"] == k1)], df[(df["cell"] == c2) & (df["slice"] == k2)]
        sims = np.stack(left["vec"].to_numpy()) @ np.stack(right["vec"].to_numpy()).T if len(left) and len(right) else np.zeros((0, 0))
        i, j = np.nonzero(sims >= threshold)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        out = pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "sim": sims[i, j]})
        return out[out["a"] != out["b"]].drop_duplicates(["a", "b"])

    return spread.groupBy("block", "task").applyInPandas(compare, f"a {kind}, b {kind}, sim double")


#: Slack of a similarity bound, far above rounding and far below any difference that matters.
SLACK = 1e-9


def entity_components(entities: DataFrame, vectors: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(ord, component): exact groups joined, for types other than User, by similar names of one type."""
    groups = exact_groups(entities)
    if vectors is None:
        return groups
    heads = entities.where("entity_type != 'User'").join(groups.select(F.col("component").alias("ord")).distinct(), "ord").join(vectors, "ord")
    pairs = similar_pairs(heads.withColumnRenamed("entity_type", "block"), settings.similarity - SLACK, key="ord")
    parts = connected_components(pairs, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("root"))
    return groups.join(parts, "component", "left").select("ord", F.coalesce("root", "component").alias("component"))


def canonicalize(entities: DataFrame, components: DataFrame) -> DataFrame:
    """One entity per component: the shortest, earliest, first name; all other names become sorted aliases."""
    rows = entities.join(components, "ord")
    rank = F.struct(F.length("name").alias("n"), F.coalesce("first_seen", F.lit("")).alias("s"), F.col("ord").alias("o"))
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
    grouped = rows.groupBy("component").agg(
        F.min_by(F.struct("ord", "id", "name", "entity_type"), rank).alias("c"), F.array_distinct(F.flatten(F.collect_set(names))).alias("names"), F.min(F.nullif(F.col("first_seen"), F.lit(""))).alias("first_seen"), F.count(F.lit(1)).alias("members"),
    )
    aliases = F.array_sort(F.filter(F.array_except("names", F.array("c.name")), lambda x: x.isNotNull()))
    return grouped.select("c.ord", "c.id", "c.name", "c.entity_type", aliases.alias("aliases"), "first_seen", "component", "members")


def remap_claims(claims: DataFrame, entities: DataFrame, components: DataFrame, canonical: DataFrame) -> DataFrame:
    """Claims with subject and object replaced by canonical ids; unknown ids stay."""
    to = entities.select("ord", "id").join(components, "ord").join(canonical.select("component", F.col("id").alias("to_id")), "component").select("id", "to_id")
    s, o = to.toDF("subject_id", "to_s"), to.toDF("object_id", "to_o")
    out = claims.join(s, "subject_id", "left").join(o, "object_id", "left")
    return out.withColumns({"subject_id": F.coalesce("to_s", "subject_id"), "object_id": F.coalesce("to_o", "object_id")}).select(*claims.columns)


TRIPLE = ["subject_id", "relation", "object_id"]


def dedup_claims(claims: DataFrame) -> DataFrame:
    """One claim per triple: the earliest, with the highest confidence and all distinct evidence in order of time.

    ``ord`` stays that of the base, ``first_ord`` is the group's first; a triple
    with one claim keeps its evidence as it is.
    """
    claims = clean_claims(claims)
    at = F.struct(F.coalesce("valid_from", F.lit("")).alias("v"), F.col("ord").alias("o"))
    fields = ["ord", "id", "valid_from", "valid_until", "is_current", "extraction_version", "evidence"]
    base = claims.groupBy(*TRIPLE).agg(F.min_by(F.struct(*fields), at).alias("b"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("members"), F.min("ord").alias("first_ord"))
    items = claims.select(*TRIPLE, at.alias("at"), F.posexplode("evidence").alias("pos", "e")).withColumn("eid", evidence_id(F.col("e.source_id"), F.col("e.exact_quote")))
    once = items.groupBy(*TRIPLE, "eid").agg(F.min_by("e", F.struct("at", "pos")).alias("e"), F.min(F.struct("at", "pos")).alias("p"))
    merged = once.groupBy(*TRIPLE).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "e"))), lambda x: x.e).alias("all"))
    out = base.join(merged, TRIPLE, "left")
    evidence = F.when(F.col("members") > 1, F.coalesce("all", F.array().cast(claims.schema["evidence"].dataType))).otherwise(F.col("b.evidence"))
    return out.select("b.ord", "b.id", *TRIPLE, evidence.alias("evidence"), "confidence", *[F.col(f"b.{c}") for c in fields[2:6]], "members", "first_ord")


def marked_conflicts(claims: DataFrame, order: str = "ord") -> DataFrame:
    """Claims with conflicts resolved, and ``superseded``.

    Single-valued relations with several objects: each claim ends where the next, different one begins; the last is current.
    """
    keys, at = ["subject_id", "relation"], F.coalesce("valid_from", F.lit(""))
    several = claims.where(F.col("relation").isin(SINGLE_VALUED)).groupBy(*keys).agg(F.min("object_id").alias("_a"), F.max("object_id").alias("_z")).where("_a != _z")
    marked = claims.join(several.select(*keys, F.lit(True).alias("_on")), keys, "left")
    led = next_within(marked, keys, text_slice(F.col("valid_from"), F.col(order)), [at, F.col(order)], F.struct("object_id", "valid_from"), "_next")
    superseded = F.coalesce(F.col("_on") & (F.col("_next.v.object_id") != F.col("object_id")), F.lit(False))
    until = F.when(superseded, F.col("_next.v.valid_from")).otherwise(F.col("valid_until"))
    current = F.when(superseded, F.lit(False)).when(F.col("_on") & F.col("_next").isNull(), F.lit(True)).otherwise(F.col("is_current"))
    return led.withColumns({"valid_until": until, "is_current": current, "superseded": superseded}).select(*claims.columns, "superseded")


def resolve_conflicts(claims: DataFrame, order: str = "ord") -> DataFrame:
    """Claims with conflicts resolved, as in :func:`marked_conflicts`."""
    return marked_conflicts(claims, order).drop("superseded")


def without_orphans(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims whose subject and object are entities."""
    ids = entities.select("id")
    return claims.join(ids.toDF("subject_id"), "subject_id", "left_semi").join(ids.toDF("object_id"), "object_id", "left_semi")


def merge_records(rows: DataFrame, group: list[str], kind: str, target: str, target_ord: str, place: Column, reason: Column, run_ts: str) -> MergeLog:
    """Audit of the groups of ``rows`` with several members.

    ``target`` and ``target_ord`` are the columns that name the group's survivor; ``place`` (text) and then ``ord`` order
    the members.  Members stay rows: nothing is gathered, so a group may hold any share of all records.  Ids may repeat.
    """
    own = [f.name for f in StructType.fromDDL(ENTITIES if kind == "entity" else CLAIMS)]
    merge_id = F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.lit(run_ts), F.col(target), F.col(target_ord).cast("string")), 256), 1, 16)
    groups = rows.groupBy(*group, target, target_ord).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("merge_id", merge_id)
    records = groups.select("merge_id", F.lit(kind).alias("merge_type"), F.col(target).alias("target_id"), F.col(target_ord).alias("target_ord"), "n", reason.alias("reason"), F.lit(run_ts).alias("timestamp"))
    members = rows.join(groups.select(*group, "merge_id"), group).select("merge_id", place.alias("place"), "ord", "id", F.to_json(F.struct(*own)).alias("snapshot"))
    return MergeLog(records, members)


def merge_documents(log: MergeLog) -> DataFrame:
    """One row per merge with ``source_ids`` and ``original_snapshots`` inside, for exchange: each group becomes one document."""
    one = F.struct("place", "ord", "id", "snapshot")
    m = log.members.groupBy("merge_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    snapshots = F.transform("m", lambda x: F.struct(x.id.alias("id"), x.snapshot.alias("snapshot")))
    return log.records.join(m, "merge_id").select("merge_id", "merge_type", F.transform("m", lambda x: x.id).alias("source_ids"), "target_id", "reason", "timestamp", snapshots.alias("original_snapshots"))


def undo_merge(store: Store, merge_id: str) -> Store:
    """The store as before one merge of entities or claims; an unknown id raises ``ValueError``.

    The members come back as they were, the survivor goes unless it is one of them, the record leaves the log.  Records
    are told apart by ``ord``, as ids may repeat; claims that were pointed to the survivor stay so.
    """
    log = store.merge_log
    record = log.records.where(F.col("merge_id") == merge_id).first() if log else None
    if record is None:
        raise ValueError(f"no merge {merge_id}")
    entity = record.merge_type == "entity"
    now = store.entities if entity else store.claims
    old = log.members.where(F.col("merge_id") == merge_id).select(F.from_json("snapshot", ENTITIES if entity else CLAIMS).alias("x")).select("x.*")
    gone = old.select("ord").union(old.sparkSession.createDataFrame([(record.target_ord,)], "ord bigint")).distinct()
    restored = now.join(gone, "ord", "left_anti").select(*old.columns).unionByName(old)
    rest = MergeLog(log.records.where(F.col("merge_id") != merge_id), log.members.where(F.col("merge_id") != merge_id))
    return replace(store, merge_log=rest, **{"entities" if entity else "claims": restored})


def entity_merges(entities: DataFrame, components: DataFrame, canonical: DataFrame, run_ts: str) -> MergeLog:
    """The audit of canonicalised entities, members in the order of the store."""
    targets = canonical.select("component", F.col("id").alias("target_id"), F.col("ord").alias("target_ord"))
    rows = entities.join(components, "ord").join(targets, "component")
    return merge_records(rows, ["component"], "entity", "target_id", "target_ord", F.lit(""), F.concat(F.lit("Dedup: "), F.col("n").cast("string"), F.lit(" entities merged")), run_ts)


def claim_merges(claims: DataFrame, unique: DataFrame, run_ts: str) -> MergeLog:
    """The audit of deduplicated claims, members in the order of time."""
    targets = unique.select(*TRIPLE, F.col("id").alias("target_id"), F.col("ord").alias("target_ord"))
    reason = F.concat(F.lit("Same triple: "), F.concat_ws("::", *TRIPLE))
    return merge_records(clean_claims(claims).join(targets, TRIPLE), TRIPLE, "claim", "target_id", "target_ord", F.coalesce("valid_from", F.lit("")), reason, run_ts)


def run_full_pipeline(store: Store, run_ts: str, vectors: DataFrame | None = None) -> tuple[Store, DataFrame]:
    """The deduplicated store with its merge log, and one row of counters.

    Entities are canonicalised (by equal names, and by similar ones if ``vectors`` (ord, vec) are given), claims pointed
    to the canonical ones and merged by triple, conflicts resolved, claims without both entities dropped.  Every stage is
    written once to the shared folder, as several of the following read it.
    """
    entities, claims = store.entities, clean_claims(store.claims)
    parts = stash(entity_components(entities, vectors, store.settings), "components")
    canonical = stash(canonicalize(entities, parts), "canonical")
    remapped = stash(remap_claims(claims, entities, parts, canonical), "remapped")
    unique = stash(dedup_claims(remapped), "unique")
    resolved = stash(marked_conflicts(unique, "first_ord"), "resolved")
    kept = stash(without_orphans(resolved, canonical), "kept")
    log = entity_merges(entities, parts, canonical, run_ts).union(claim_merges(remapped, unique, run_ts))
    keys = exact_groups(entities).agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("component").alias("keys"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = resolved.agg(F.sum("members").alias("claims"), F.count(F.lit(1)).alias("triples"), F.count_if("superseded").alias("conflicts"))
    row = keys.crossJoin(count(canonical, "components")).crossJoin(both).crossJoin(count(kept, "kept"))
    counters = row.select(
        (F.col("entities") - F.col("keys")).alias("exact_merges"), (F.col("keys") - F.col("components")).alias("semantic_merges"), (F.col("claims") - F.col("triples")).alias("claim_merges"),
        "conflicts", (F.col("triples") - F.col("kept")).alias("orphans"), F.col("components").alias("entities"), F.col("kept").alias("claims"),
    )
    out = replace(store, entities=canonical.select(*entities.columns), claims=kept.select(*claims.columns), merge_log=log)
    return out, counters
