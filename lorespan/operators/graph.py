"""The memory graph: a directed multigraph of entities (vertices) and claims (edges)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.operators.components import connected_components
from lorespan.schema import MergeLog, clean_claims
from lorespan.session import stash

# The counters of ingestion.
COUNTERS = ["total_entities_ingested", "total_claims_ingested", "duplicate_entities_skipped", "duplicate_claims_skipped", "orphan_claims_skipped"]


@dataclass
class Graph:
    """Vertices (entities by id), edges (claims by id) and one row with the counters of all ingestion so far."""

    vertices: DataFrame
    edges: DataFrame
    counters: DataFrame | None = None

    def stored(self) -> Graph:
        """The same graph, written once to the shared folder; for graphs that are read several times."""
        return Graph(stash(self.vertices, "vertices"), stash(self.edges, "edges"), stash(self.counters, "counters") if self.counters is not None else None)


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "ord").alias("r")).select(key, "r.*").select(*rows.columns)


def ingest(entities: DataFrame, claims: DataFrame, graph: Graph | None = None) -> tuple[Graph, DataFrame]:
    """Graph with the new records and the counters so far, and one row of this call's counters; known ids are skipped, claims need both ends.

    Ingesting the same records again changes nothing.  A claim that misses both
    ends counts once; every copy of a claim without its ends is an orphan.
    """
    claims = clean_claims(claims)
    new = _first_of(entities, "id")
    if graph is not None:
        new = new.join(graph.vertices.select("id"), "id", "left_anti")
    vertices = new if graph is None else graph.vertices.unionByName(new, allowMissingColumns=True)
    known = claims.select(F.lit(None).cast("string").alias("id")).limit(0) if graph is None else graph.edges.select("id")
    seen = claims.join(known, "id", "left_anti")
    ids = vertices.select("id")
    ends = seen.join(ids.toDF("subject_id"), "subject_id", "left_semi").join(ids.toDF("object_id"), "object_id", "left_semi")
    fresh = _first_of(ends.select(*claims.columns), "id")
    edges = fresh if graph is None else graph.edges.unionByName(fresh, allowMissingColumns=True)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = count(entities, "n_e").crossJoin(count(new, "new_e")).crossJoin(count(claims, "n_c")).crossJoin(count(seen, "seen_c")).crossJoin(count(ends, "end_c")).crossJoin(count(fresh, "new_c"))
    counters = row.select(
        F.col("new_e").alias(COUNTERS[0]), F.col("new_c").alias(COUNTERS[1]), (F.col("n_e") - F.col("new_e")).alias(COUNTERS[2]),
        (F.col("n_c") - F.col("seen_c") + F.col("end_c") - F.col("new_c")).alias(COUNTERS[3]), (F.col("seen_c") - F.col("end_c")).alias(COUNTERS[4]),
    )
    total = counters
    if graph is not None and graph.counters is not None:
        total = graph.counters.unionByName(counters).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return Graph(vertices, edges, total), counters


def node(graph: Graph, entity_id: str) -> DataFrame:
    return graph.vertices.where(F.col("id") == entity_id)


def claims_for_entity(claims: DataFrame, entity_id: str) -> DataFrame:
    """Claims with the entity at either end; a loop once."""
    return claims.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))


def claims_of_entities(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, claim columns): the claims with each entity of ``ids`` (id) at either end; a loop once."""
    ends = F.array_distinct(F.array("subject_id", "object_id"))
    return claims.withColumn("entity_id", F.explode(ends)).join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", *claims.columns)


def neighbors(edges: DataFrame, ids: DataFrame, current_only: bool = True) -> DataFrame:
    """(entity_id, neighbor_id, direction, edge columns) of all edges out of and into ``ids`` (id); a loop twice."""
    e = edges.where(F.coalesce("is_current", F.lit(True))) if current_only else edges
    own = ids.select(F.col("id").alias("entity_id"))
    out = e.join(own, e.subject_id == own.entity_id).select("entity_id", F.col("object_id").alias("neighbor_id"), F.lit("outgoing").alias("direction"), *[e[c] for c in e.columns])
    into = e.join(own, e.object_id == own.entity_id).select("entity_id", F.col("subject_id").alias("neighbor_id"), F.lit("incoming").alias("direction"), *[e[c] for c in e.columns])
    return out.unionByName(into)


def find_by_name(vertices: DataFrame, query: str) -> DataFrame:
    """Entities whose name or an alias contains the text regardless of case; an empty text fits all."""
    q = F.lit(query.lower())
    return vertices.where(F.contains(F.lower("name"), q) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), q)), F.lit(False)))


def subgraph(graph: Graph, ids: DataFrame, depth: int = 1) -> Graph:
    """Vertices within ``depth`` steps in any direction, and all edges between them; unknown ids give nothing."""
    links = graph.edges.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    links = links.union(links.select("b", "a")).distinct()
    reached = ids.select("id").join(graph.vertices.select("id"), "id", "left_semi").distinct()
    for _ in range(depth):
        step = links.join(reached.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"))
        reached = reached.union(step).distinct()
    return induced(graph, reached)


def induced(graph: Graph, ids: DataFrame) -> Graph:
    keep = ids.select("id").distinct()
    vertices = graph.vertices.join(keep, "id", "left_semi")
    edges = graph.edges.join(keep.toDF("subject_id"), "subject_id", "left_semi").join(keep.toDF("object_id"), "object_id", "left_semi")
    return Graph(vertices, edges.select(*graph.edges.columns))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every vertex, in and out; a loop counts twice."""
    ends = graph.edges.select(F.col("subject_id").alias("id")).union(graph.edges.select("object_id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return graph.vertices.select("id").join(ends, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("degree"))


def top_nodes(graph: Graph, n: int) -> Graph:
    """The ``n`` vertices of highest degree (ties by id) and the edges between them."""
    return induced(graph, degrees(graph).orderBy(F.desc("degree"), "id").limit(n))


def view(graph: Graph, types: list[str] | None = None, relations: list[str] | None = None, min_confidence: float = 0.5, current_only: bool = True, max_nodes: int = 200) -> Graph:
    """Filtered graph without isolated vertices, cut to the vertices of highest degree."""
    vertices = graph.vertices.where(F.col("entity_type").isin(types)) if types else graph.vertices
    edges = graph.edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    edges = edges.where(F.col("relation").isin(relations)) if relations else edges
    edges = edges.where(F.coalesce("is_current", F.lit(True))) if current_only else edges
    part = induced(Graph(vertices, edges), vertices)
    linked = part.edges.select(F.col("subject_id").alias("id")).union(part.edges.select("object_id")).distinct()
    return top_nodes(induced(part, linked), max_nodes)


def weak_components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex; an isolated vertex is its own."""
    parts = connected_components(graph.edges.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))
    return graph.vertices.select("id").join(parts, graph.vertices.id == parts.node, "left").select("id", F.coalesce("component", "id").alias("component"))


def metrics(graph: Graph) -> DataFrame:
    """(section, k, v) of the graph's quality metrics; averages of an empty graph are 0."""
    zero = F.lit(0.0)
    d = lambda c: c.cast("double")
    long = lambda df, section: df.select(F.lit(section).alias("section"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c) for c in df.columns]))).alias("k", "v"))
    n = F.coalesce(F.size("evidence"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    totals = graph.vertices.agg(d(F.count(F.lit(1))).alias("nodes")).crossJoin(graph.edges.agg(d(F.count(F.lit(1))).alias("edges"))).crossJoin(weak_components(graph).agg(d(F.count_distinct("component")).alias("components")))
    valid = F.coalesce("is_current", F.lit(True))
    of_edges = {
        ("evidence", "total"): F.coalesce(F.sum(n), F.lit(0)), ("evidence", "average"): F.coalesce(F.avg(n), zero), ("evidence", "without"): F.count_if(n == 0),
        **{("confidence", k): F.coalesce(f(F.col("confidence")), zero) for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))},
        ("validity", "current"): F.count_if(valid), ("validity", "historical"): F.count_if(~valid),
    }
    cell = lambda section, k, v: F.struct(F.lit(section).alias("section"), F.lit(k).alias("k"), d(v).alias("v"))
    edges = graph.edges.agg(F.array(*[cell(*sk, v) for sk, v in of_edges.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    by = lambda df, c, section: df.groupBy(F.coalesce(c, F.lit("")).alias("k")).agg(d(F.count(F.lit(1))).alias("v")).select(F.lit(section).alias("section"), "k", "v")
    parts = [long(totals, "totals"), edges, by(graph.vertices, "entity_type", "entity_types"), by(graph.edges, "relation", "relations")]
    if graph.counters is not None:
        parts.append(long(graph.counters.select(*[d(F.col(c)).alias(c) for c in COUNTERS]), "ingestion"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Colours by entity type and by relation, with those of all others.
NODE_COLOURS = {
    "User": "#4CAF50", "Component": "#2196F3", "Bug": "#f44336", "Feature": "#FF9800", "Issue": "#9C27B0", "Label": "#607D8B", "Decision": "#E91E63", "Concept": "#00BCD4", "Organization": "#FF5722", "Topic": "#3F51B5", "Project": "#8BC34A",
}
EDGE_COLOURS = {
    "created": "#4CAF50", "reported": "#FF9800", "fixed": "#2196F3", "broke": "#f44336", "mentions": "#9E9E9E", "decided": "#E91E63", "status_changed": "#9C27B0", "assigned_to": "#795548", "related_to": "#607D8B", "caused_by": "#f44336",
    "duplicate_of": "#FF5722", "sent_to": "#4CAF50", "forwarded_to": "#FF9800", "discussed": "#3F51B5", "approved": "#8BC34A", "escalated_to": "#E91E63",
}
NODE_OTHER, EDGE_OTHER, EDGE_PAST = "#00BCD4", "#9E9E9E", "#555555"


def _colour(c: str, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def node_style(graph: Graph) -> DataFrame:
    """(id, label, size, colour, tooltip) of every vertex."""
    v = graph.vertices.join(degrees(graph), "id")
    tip = F.concat(F.col("entity_type"), F.lit(": "), F.col("name"), F.lit(" | "), F.array_join(F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 5), ", "))
    return v.select("id", F.substring("name", 1, 30).alias("label"), (15 + F.least(3 * F.col("degree"), F.lit(30))).cast("bigint").alias("size"), _colour("entity_type", NODE_COLOURS, NODE_OTHER).alias("colour"), tip.alias("tooltip"))


def edge_style(graph: Graph) -> DataFrame:
    """(id, colour, width, dashed, tooltip) of every edge."""
    past = ~F.coalesce("is_current", F.lit(True))
    quotes = F.array_join(F.transform(F.slice(F.coalesce("evidence", F.array().cast(graph.edges.schema["evidence"].dataType)), 1, 3), lambda e: F.substring(F.coalesce(e.exact_quote, F.lit("")), 1, 100)), " / ")
    width = F.greatest(F.lit(1.0), 3 * F.coalesce("confidence", F.lit(0.0)))
    return graph.edges.select("id", F.when(past, EDGE_PAST).otherwise(_colour("relation", EDGE_COLOURS, EDGE_OTHER)).alias("colour"), width.alias("width"), past.alias("dashed"), quotes.alias("tooltip"))


def selector_lists(graph: Graph) -> DataFrame:
    """(kind, value): the distinct types and relations, sorted."""
    types = graph.vertices.select(F.lit("entity_type").alias("kind"), F.col("entity_type").alias("value"))
    return types.union(graph.edges.select(F.lit("relation"), F.col("relation"))).where("value is not null").distinct().orderBy("kind", "value")


def claim_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, line, quotes): each claim as a reader sees it, and its evidence with source, author and time."""
    names = vertices.select("id", "name")
    named = edges.join(names.toDF("subject_id", "_s"), "subject_id", "left").join(names.toDF("object_id", "_o"), "object_id", "left")
    status = F.when(F.coalesce("is_current", F.lit(True)), "Current").otherwise("Historical")
    line = F.format_string("%s → %s → %s (confidence: %.2f, %s)", F.coalesce("_s", "subject_id"), "relation", F.coalesce("_o", "object_id"), F.coalesce("confidence", F.lit(0.0)), status)
    known = lambda c, other: F.coalesce(c, F.lit(other))
    quote = lambda e: F.concat(F.lit('"'), known(e.exact_quote, "N/A"), F.lit('" Source: '), known(e.source_id, "?"), F.lit(" | Author: "), known(e.author, "?"), F.lit(" | Time: "), known(e.timestamp, "?"))
    return named.select("id", line.alias("line"), F.array_join(F.transform(F.coalesce("evidence", F.array().cast(edges.schema["evidence"].dataType)), quote), "\n").alias("quotes"))


def first_matches(vertices: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The first entities whose name or an alias contains the text."""
    return find_by_name(vertices, query).orderBy("ord").limit(n)


def merged_entities(entities: DataFrame, n: int = 50) -> DataFrame:
    """The first entities that have aliases, as they came from a merge."""
    return entities.where(F.size("aliases") > 0).orderBy("ord").limit(n)


def log_lines(log: MergeLog, n: int = 50, sources: int = 10) -> DataFrame:
    """(merge_id, line, sources): the first merges of a log by target, with the ids of their first members."""
    top = log.records.orderBy("merge_type", "target_ord").limit(n)
    place = F.row_number().over(Window.partitionBy("merge_id").orderBy("place", "ord"))
    few = log.members.join(F.broadcast(top.select("merge_id")), "merge_id").select("merge_id", "place", "ord", "id").withColumn("r", place).where(F.col("r") <= sources)
    ids = few.groupBy("merge_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x.id), ", ").alias("sources"))
    line = F.format_string("%s merge: %d items → %s", F.upper("merge_type"), "n", "target_id")
    return top.join(ids, "merge_id").select("merge_id", line.alias("line"), "sources")
