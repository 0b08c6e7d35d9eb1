"""Queries of the operators for knowledge graphs over messages, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import dedup, extraction, graph, retrieval, threads
from lorespan.operators.components import connected_components
from lorespan.schema import CLAIMS, ENTITIES, Settings, Store, clean_claims, names_of
from lorespan.session import scratch_path, stash, table
from lorespan.sources import mail
from lorespan.sources import store as stores
from lorespan.streaming.ingest import current_claims, ingest_claims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _joined(c) -> F.Column:
    return F.array_join(c, "|")


RUN_TS = "2005-01-01T00:00:00"
#: Claims as the engine takes them: a confidence that is not a number is none.
_CLAIMS = "(SELECT * REPLACE (CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence) FROM claims)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return clean_claims(table(spark, d, "claims"))

# ---------------------------------------------------------------- text
_NORM = _strip(rf"regexp_replace({_strip('subject')}, '^(?:(?:re|fwd|fw):\s*){{1,3}}', '', 'i')")
_MID = "CASE WHEN regexp_replace(coalesce(message_id, ''), '^[<> ]+|[<> ]+$', '', 'g') != '' THEN regexp_replace(coalesce(message_id, ''), '^[<> ]+|[<> ]+$', '', 'g') ELSE substr(md5(coalesce(sender, '') || coalesce(\"timestamp\", '') || coalesce(subject, '')), 1, 12) END"
_COMMENTS = "(SELECT r.issue_id, r.title, u.pos - 1 AS pos, u.c FROM raw_corpus r, unnest(r.comments) WITH ORDINALITY AS u(c, pos))"


@query(f"SELECT ord, lower({_NORM}) AS norm FROM fetch_corpus WHERE subject IS NOT NULL")
def subject_normalize(spark, d):
    return table(spark, d, "fetch_corpus").where("subject is not null").select("ord", T.normalize_subject(F.col("subject")).alias("norm"))


@query(f"""SELECT ord, array_to_string(list_filter(list_transform(string_split(array_to_string("to", ','), ','), lambda x: {_strip('x')}), lambda x: contains(x, '@')), '|') AS addresses FROM fetch_corpus WHERE "to" IS NOT NULL""")
def address_split(spark, d):
    return table(spark, d, "fetch_corpus").where("`to` is not null").select("ord", _joined(T.split_addresses(F.array_join("to", ","))).alias("addresses"))


@query(f"SELECT ord, {_MID} AS mid FROM fetch_corpus")
def message_id_default(spark, d):
    m = table(spark, d, "fetch_corpus")
    return m.select("ord", T.default_message_id(F.col("message_id"), F.col("sender"), F.col("timestamp"), F.col("subject")).alias("mid"))


@query("SELECT c.ord, u.pos - 1 AS pos, substr(sha256(coalesce(u.e.source_id, '') || ':' || substr(coalesce(u.e.exact_quote, ''), 1, 100)), 1, 16) AS evidence_id FROM claims c, unnest(c.evidence) WITH ORDINALITY AS u(e, pos)")
def evidence_ids(spark, d):
    c = _claims(spark, d).select("ord", F.posexplode("evidence").alias("pos", "e"))
    return c.select("ord", F.col("pos").cast("bigint").alias("pos"), T.evidence_id(F.col("e.source_id"), F.col("e.exact_quote")).alias("evidence_id"))


@query(f"SELECT ord, concat_ws('::', entity_type, lower({_strip('name')})) AS canonical_key FROM entities")
def canonical_keys(spark, d):
    return table(spark, d, "entities").select("ord", T.canonical_key(F.col("entity_type"), F.col("name")).alias("canonical_key"))


def _comments(spark, d):
    c = table(spark, d, "raw_corpus").select("issue_id", "title", F.posexplode("comments").alias("pos", "c"))
    return c.select(F.col("issue_id").cast("bigint").alias("issue_id"), "title", F.col("pos").cast("bigint").alias("pos"), "c.*")


@query(f"""SELECT issue_id::BIGINT AS issue_id, pos, md5(concat_ws(chr(10), 'Thread: ' || coalesce(title, ''), 'Source: ' || coalesce(c.comment_id, ''), 'Author: ' || coalesce(c.author, ''), 'Time: ' || coalesce(c."timestamp", ''),
  CASE WHEN length(c.text) > 3000 THEN substr(c.text, 1, 3000) || '... [truncated]' ELSE c.text END)) AS prompt_md5 FROM {_COMMENTS} WHERE length({_strip('c.text')}) >= 20""")
def prompt_build(spark, d):
    c = threads.long_enough(_comments(spark, d), "text")
    p = T.extraction_prompt(F.col("title"), F.col("comment_id"), F.col("author"), F.col("timestamp"), F.col("text"), Settings().prompt_chars)
    return c.select("issue_id", "pos", F.md5(p).alias("prompt_md5"))


@query(f"""SELECT ord, 'id' || ord || '@host' AS message_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S+02:00') AS "timestamp", len(list_filter(coalesce("to", []), lambda x: contains(x, '@'))) AS n_to, '(no subject)' AS subject FROM fetch_corpus WHERE length({_strip('body')}) > 0""")
def mail_parse(spark, d):
    """Every mail written as a file of its own headers and read again; those without text are left out."""
    m = table(spark, d, "fetch_corpus")
    to = F.regexp_replace(F.array_join(F.transform(F.coalesce("to", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, ",", " ")), ", "), r"[^\x20-\x7e]", "?")
    date = F.date_format("ingested_at", "EEE, dd MMM yyyy HH:mm:ss")
    head = F.concat(F.lit("Message-ID: <id"), F.col("ord").cast("string"), F.lit("@host>\nTo: "), to, F.lit("\nDate: "), date, F.lit(" +0200\n\n"))
    files = m.select(F.col("ord").cast("string").alias("path"), F.encode(F.concat(head, F.coalesce("body", F.lit(""))), "utf-8").alias("content"))
    n = F.size(F.filter("to", lambda x: F.contains(x, F.lit("@")))).cast("bigint")
    return mail.parse_files(files).select(F.col("filepath").cast("bigint").alias("ord"), "message_id", "timestamp", n.alias("n_to"), "subject")


# ---------------------------------------------------------------- threads
_FIRST = rf"(SELECT * FROM (SELECT *, {_MID} AS mid, row_number() OVER (PARTITION BY {_MID} ORDER BY filepath, ord) AS rn FROM fetch_corpus WHERE length({_strip('body')}) > 0) WHERE rn = 1)"
_THREADED = f"(SELECT *, lower({_strip(_NORM.replace('subject', 'coalesce(subject, ' + chr(39) + '(no subject)' + chr(39) + ')'))}) AS norm FROM {_FIRST})"


@query(f"SELECT ord, mid FROM {_FIRST}")
def mail_first(spark, d):
    return threads.first_by_id(table(spark, d, "fetch_corpus")).select("ord", "mid")


@query(f"""SELECT ord, norm, row_number() OVER (PARTITION BY norm ORDER BY coalesce("timestamp", ''), ord) AS pos, row_number() OVER (PARTITION BY norm ORDER BY coalesce("timestamp", ''), ord) = 1 AS is_issue_body FROM {_THREADED} WHERE norm != ''""")
def thread_build(spark, d):
    t = threads.group_threads(threads.first_by_id(table(spark, d, "fetch_corpus")))
    return t.select("ord", "norm", F.col("pos").cast("bigint").alias("pos"), "is_issue_body")


@query(f"""WITH t AS (SELECT * FROM {_THREADED} WHERE norm != ''), s AS (SELECT norm, count(*) AS n, min(ord) AS f FROM t GROUP BY norm HAVING count(*) BETWEEN 5 AND 15),
 b AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS issue_id FROM s)
 SELECT issue_id, first(subject ORDER BY coalesce("timestamp", ''), ord) AS title, first(sender ORDER BY coalesce("timestamp", ''), ord) AS author, min(nullif("timestamp", '')) AS created_at, max(nullif("timestamp", '')) AS closed_at,
 count(*) AS n, string_agg(substr(mid, 1, 32), '|' ORDER BY coalesce("timestamp", ''), ord) AS comment_ids, array_to_string(list_sort(list_distinct(flatten(list(list_concat([sender], coalesce("to", [])))))), '|') AS participants FROM t JOIN b USING (norm) WHERE issue_id <= 12 GROUP BY issue_id""")
def thread_select(spark, d):
    t = threads.select_threads(threads.first_by_id(table(spark, d, "fetch_corpus")))
    return t.select(F.col("issue_id").cast("bigint").alias("issue_id"), "title", "author", "created_at", "closed_at", F.size("comments").cast("bigint").alias("n"), _joined(F.transform("comments", lambda c: c.comment_id)).alias("comment_ids"), _joined("participants").alias("participants"))


@query("SELECT count(*) AS threads, sum(coalesce(len(comments), 0))::BIGINT AS messages FROM raw_corpus")
def thread_totals(spark, d):
    n = F.when(F.size("comments") > 0, F.size("comments")).otherwise(0)
    return table(spark, d, "raw_corpus").agg(F.count(F.lit(1)).alias("threads"), F.sum(n).alias("messages"))


@query("SELECT r.issue_id::BIGINT AS issue_id FROM raw_corpus r WHERE len(r.comments) % 2 = 1")
def completed_skip(spark, d):
    """Threads that are pending after those with an even or unknown number of comments were completed."""
    t = table(spark, d, "raw_corpus")
    return extraction.pending(t, t.where("comments is null or size(comments) % 2 = 0")).select(F.col("issue_id").cast("bigint").alias("issue_id"))


# ---------------------------------------------------------------- extraction
def _answers(spark, d, wrap):
    c = _claims(spark, d)
    claim = F.struct("id", "subject_id", "relation", "object_id", "confidence", "evidence")
    body = F.to_json(F.struct(F.array(claim).alias("claims")))
    a = c.withColumn("json", body)
    return a.select(F.col("ord").cast("int").alias("thread"), F.lit(0).alias("pos"), F.lit("s").alias("source_id"), F.lit("2001-01-01").alias("timestamp"), F.lit("a").alias("author"), wrap(F.col("json"), F.col("ord")).alias("answer"))


_RELATIONS = ", ".join(f"'{r}'" for r in extraction.RELATIONS)


@query(f"""SELECT ord, 'clm_' || ord || '_' || id AS claim_id, CASE WHEN relation IN ({_RELATIONS}) THEN relation ELSE 'related_to' END AS relation, coalesce(confidence, 0.7::DOUBLE) AS confidence, len(evidence) AS n_evidence
 FROM {_CLAIMS} WHERE len(evidence) > 0 AND coalesce(confidence, 0.7::DOUBLE) BETWEEN 0.5 AND 1""")
def extract_validate(spark, d):
    built = extraction.build_records(_answers(spark, d, lambda j, _: F.concat(F.lit("```json\n"), j, F.lit("\n```"))))
    c = built.select("thread", F.explode("claims").alias("c"))
    return c.select(F.col("thread").cast("bigint").alias("ord"), F.col("c.id").alias("claim_id"), "c.relation", "c.confidence", F.size("c.evidence").cast("bigint").alias("n_evidence"))


_ENTITY_TYPES = ", ".join(f"'{t}'" for t in extraction.ENTITY_TYPES)


@query(f"""SELECT ord, 'ent_' || ord || '_' || id AS entity_id, {_strip('name')} AS name, CASE WHEN entity_type IN ({_ENTITY_TYPES}) AND ord % 3 > 0 THEN entity_type ELSE 'Concept' END AS entity_type, coalesce(array_to_string(aliases, '|'), '') AS aliases, '2001-01-01' AS first_seen
 FROM entities WHERE name IS NOT NULL""")
def extract_entities(spark, d):
    """Entities built from answers; every third one names a type that does not exist."""
    e = table(spark, d, "entities").withColumn("entity_type", F.when(F.col("ord") % 3 > 0, F.col("entity_type")).otherwise("Unheard"))
    one = F.struct("id", "name", "entity_type", "aliases")
    answers = e.select(F.col("ord").cast("int").alias("thread"), F.lit(0).alias("pos"), F.lit("s").alias("source_id"), F.lit("2001-01-01").alias("timestamp"), F.lit("a").alias("author"), F.to_json(F.struct(F.array(one).alias("entities"))).alias("answer"))
    x = extraction.build_records(answers.where("answer like '%\"name\"%'")).select("thread", F.explode("entities").alias("e"))
    return x.select(F.col("thread").cast("bigint").alias("ord"), F.col("e.id").alias("entity_id"), "e.name", "e.entity_type", F.coalesce(_joined("e.aliases"), F.lit("")).alias("aliases"), "e.first_seen")


@query(f"SELECT ord, CASE WHEN ord % 4 < 2 AND len(evidence) > 0 AND coalesce(confidence, 0.7::DOUBLE) BETWEEN 0.5 AND 1 THEN 1 ELSE 0 END AS n_claims FROM {_CLAIMS}")
def json_repair(spark, d):
    wrap = lambda j, o: F.when(o % 4 == 0, F.concat(F.lit("Sure! "), j, F.lit(" done"))).when(o % 4 == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```\n"))).when(o % 4 == 2, F.concat(j, F.lit(" and "), j)).otherwise(F.concat(F.lit("{'claims': "), j, F.lit("}")))
    built = extraction.build_records(_answers(spark, d, wrap))
    return built.select(F.col("thread").cast("bigint").alias("ord"), F.size("claims").alias("n_claims"))


@query(f"SELECT id, min(ord) AS first_ord, arg_max(subject_id, ord) AS subject_id, arg_max(coalesce(confidence, -9), ord) AS confidence FROM {_CLAIMS} GROUP BY id")
def upsert_last_wins(spark, d):
    c = _claims(spark, d).select("id", "ord", "subject_id", F.coalesce("confidence", F.lit(-9.0)).alias("confidence"))
    return extraction.upsert(c.withColumnRenamed("ord", "seq"), "id", "seq").select("id", F.col("ord").alias("first_ord"), "subject_id", "confidence")


@query(f"SELECT count(*) AS n, count_if(len(evidence) > 0)::BIGINT AS with_evidence, count_if(coalesce(confidence >= 0.5, false))::BIGINT AS confident, count_if(len(evidence) > 0 AND coalesce(confidence >= 0.5 AND confidence <= 1, false))::BIGINT AS kept FROM {_CLAIMS}")
def quality_gates(spark, d):
    has, sure = F.coalesce(F.size("evidence") > 0, F.lit(False)), F.coalesce(F.col("confidence") >= 0.5, F.lit(False))
    return _claims(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("with_evidence"), F.count_if(sure).alias("confident"), F.count_if(has & sure & (F.col("confidence") <= 1)).alias("kept"))


# ---------------------------------------------------------------- deduplication
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(c.text, ''), '(?m)^>+.*$', '', 'g'), '(?is)-{2,}[\s\p{Z}]*Original Message[\s\p{Z}]*-{2,}.*', '', 'g'), '(?is)-{2,}[\s\p{Z}]*Forwarded by.*', '', 'g'), '(?s)\n--[\s\p{Z}]*\n.*', '', 'g'), '[\s\p{Z}]+', ' ', 'g'))"""


@query(f"""WITH t AS (SELECT issue_id::BIGINT AS issue_id, pos, c.comment_id AS comment_id, {_CLEAN} AS clean FROM {_COMMENTS}), f AS (SELECT *, CASE WHEN length(clean) >= 20 THEN md5(lower(clean)) END AS fingerprint FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY issue_id, pos) AS rn, first_value(comment_id) OVER (PARTITION BY fingerprint ORDER BY issue_id, pos) AS fc FROM f)
 SELECT issue_id, pos, fingerprint, fingerprint IS NOT NULL AND rn > 1 AS is_duplicate, CASE WHEN fingerprint IS NOT NULL AND rn > 1 THEN fc END AS duplicate_of FROM r""")
def artifact_dedup(spark, d):
    out = dedup.dedup_artifacts(_comments(spark, d), "text", ["issue_id", "pos"], "comment_id")
    return out.select("issue_id", "pos", "fingerprint", "is_duplicate", "duplicate_of")


@query(f"""WITH t AS (SELECT CASE WHEN length({_CLEAN}) >= 20 THEN md5(lower({_CLEAN})) END AS fingerprint FROM {_COMMENTS}) SELECT count(*) AS messages, count(fingerprint) AS fingerprints, count(fingerprint) - count(DISTINCT fingerprint) AS duplicates FROM t""")
def artifact_counts(spark, d):
    out = dedup.dedup_artifacts(_comments(spark, d), "text", ["issue_id", "pos"], "comment_id")
    return out.agg(F.count(F.lit(1)).alias("messages"), F.count("fingerprint").alias("fingerprints"), F.count_if("is_duplicate").alias("duplicates"))


_GROUPS = f"(SELECT *, min(ord) OVER (PARTITION BY entity_type, lower({_strip('name')})) AS component FROM entities)"
_CANON = f"(SELECT component, first(ord ORDER BY length(name), coalesce(first_seen, ''), ord) AS ord, first(id ORDER BY length(name), coalesce(first_seen, ''), ord) AS id, first(name ORDER BY length(name), coalesce(first_seen, ''), ord) AS name, any_value(entity_type) AS entity_type, flatten(list(list_append(coalesce(aliases, []), name))) AS names, min(nullif(first_seen, '')) AS first_seen, count(*) AS members FROM {_GROUPS} GROUP BY component)"


@query(f"SELECT ord, component FROM {_GROUPS}")
def entity_exact(spark, d):
    return dedup.exact_groups(table(spark, d, "entities"))


@query(f"SELECT ord, id, name, entity_type, array_to_string(list_sort(list_filter(list_distinct(names), lambda x: x != name)), '|') AS aliases, first_seen, members FROM {_CANON}")
def entity_canonical(spark, d):
    e = table(spark, d, "entities")
    return dedup.canonicalize(e, dedup.exact_groups(e)).select("ord", "id", "name", "entity_type", _joined("aliases").alias("aliases"), "first_seen", "members")


@query("SELECT count(*) AS n, count(DISTINCT entity_type || '::' || lower(" + _strip("name") + ")) AS keys, count(*) - count(DISTINCT entity_type || '::' || lower(" + _strip("name") + ")) AS exact_merges FROM entities")
def merge_counters(spark, d):
    g = dedup.exact_groups(table(spark, d, "entities"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("keys")).withColumn("exact_merges", F.col("n") - F.col("keys"))


_SNAP = "e.ord || '~' || e.id || '~' || e.name || '~' || coalesce(array_to_string(e.aliases, '|'), '-') || '~' || coalesce(e.first_seen, '-')"


@query(f"SELECT g.component, g.n, g.ids AS source_ids, c.id AS target_id, 'Dedup: ' || g.n || ' entities merged' AS reason, g.snapshots FROM (SELECT e.component, count(*) AS n, string_agg(e.id, '|' ORDER BY e.ord) AS ids, string_agg({_SNAP}, '#' ORDER BY e.ord) AS snapshots FROM {_GROUPS} e GROUP BY e.component HAVING count(*) > 1) g JOIN {_CANON} c USING (component)")
def merge_log(spark, d):
    """The audit of exact merges, each with its members' snapshots."""
    e = table(spark, d, "entities")
    parts = dedup.exact_groups(e)
    log = dedup.entity_merges(e, parts, dedup.canonicalize(e, parts), RUN_TS)
    kept = F.from_json("x.snapshot", ENTITIES)
    told = F.concat_ws("~", kept.ord.cast("string"), kept.id, kept["name"], F.coalesce(_joined(kept.aliases), F.lit("-")), F.coalesce(kept.first_seen, F.lit("-")))
    snaps = log.members.select("merge_id", F.struct("ord", "snapshot").alias("x")).select("merge_id", "x.ord", told.alias("told"))
    snaps = snaps.groupBy("merge_id").agg(F.min("ord").alias("component"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "told"))), lambda x: x.told), "#").alias("snapshots"))
    docs = dedup.merge_documents(log).select("merge_id", _joined("source_ids").alias("source_ids"), "target_id", "reason", F.size("original_snapshots").cast("bigint").alias("n"))
    return docs.join(snaps, "merge_id").drop("merge_id")


def _entity_store(spark, d) -> tuple[Store, DataFrame]:
    e = table(spark, d, "entities").select(*names_of(ENTITIES))
    parts = stash(dedup.exact_groups(e), "parts")
    canon = stash(dedup.canonicalize(e, parts), "canon")
    return Store(canon.select(*e.columns), _claims(spark, d), dedup.entity_merges(e, parts, canon, RUN_TS)), canon


_BIG = f"(SELECT component FROM {_GROUPS} GROUP BY component HAVING count(*) > 1 ORDER BY count(*) DESC, component LIMIT 1)"


@query(f"""SELECT ord, id, name, coalesce(array_to_string(aliases, '|'), '-') AS aliases, coalesce(first_seen, '-') AS first_seen FROM {_GROUPS} WHERE component IN {_BIG}
 UNION ALL SELECT ord, id, name, coalesce(array_to_string(list_sort(list_filter(list_distinct(names), lambda x: x != name)), '|'), '-'), coalesce(first_seen, '-') FROM {_CANON} WHERE component NOT IN {_BIG}""")
def merge_undo(spark, d):
    """The entities after all exact merges but one: the largest is undone, its members are as before, the others stay merged."""
    store, canon = _entity_store(spark, d)
    largest = canon.where("members > 1").orderBy(F.desc("members"), "component").select(F.col("ord").alias("target_ord")).limit(1)
    merge_id = store.merge_log.records.join(largest, "target_ord").first().merge_id
    e = dedup.undo_merge(store, merge_id).entities
    return e.select("ord", "id", "name", F.coalesce(_joined("aliases"), F.lit("-")).alias("aliases"), F.coalesce("first_seen", F.lit("-")).alias("first_seen"))


_PAIRS = "(SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)"


def _pairs(spark, d):
    return dedup.similar_pairs(table(spark, d, "embeddings"), 0.35, "vec_id", "label", "embedding")


@query(f"SELECT a, b, round(sim, 4) AS sim FROM {_PAIRS}")
def entity_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", F.round("sim", 4).alias("sim"))


@query(f"WITH RECURSIVE p AS (SELECT a, b FROM {_PAIRS} UNION SELECT b, a FROM {_PAIRS}), r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v) SELECT v AS vec_id, min(c) AS component FROM r GROUP BY v")
def entity_components(spark, d):
    parts = connected_components(_pairs(spark, d)).withColumnRenamed("node", "vec_id")
    return table(spark, d, "embeddings").select("vec_id").join(parts, "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))


@query(f"WITH m AS (SELECT g.id, c.id AS to_id FROM {_GROUPS} g JOIN {_CANON} c USING (component)) SELECT c.ord, coalesce(s.to_id, c.subject_id) AS subject_id, coalesce(o.to_id, c.object_id) AS object_id FROM claims c LEFT JOIN m s ON s.id = c.subject_id LEFT JOIN m o ON o.id = c.object_id")
def claim_remap(spark, d):
    e = table(spark, d, "entities")
    parts = dedup.exact_groups(e)
    return dedup.remap_claims(_claims(spark, d), e, parts, dedup.canonicalize(e, parts)).select("ord", "subject_id", "object_id")


def _deduplicated(claims: str) -> str:
    return f"""(SELECT first(ord ORDER BY coalesce(valid_from, ''), ord) AS ord, first(id ORDER BY coalesce(valid_from, ''), ord) AS id, subject_id, relation, object_id, max(confidence) AS confidence, first(valid_from ORDER BY coalesce(valid_from, ''), ord) AS valid_from,
 first(valid_until ORDER BY coalesce(valid_from, ''), ord) AS valid_until, first(is_current ORDER BY coalesce(valid_from, ''), ord) AS is_current, count(*) AS members, min(ord) AS first_ord, first(evidence ORDER BY coalesce(valid_from, ''), ord) AS own FROM {claims} GROUP BY subject_id, relation, object_id)"""


_DEDUP = _deduplicated(_CLAIMS)


@query(f"""WITH e AS (SELECT c.subject_id, c.relation, c.object_id, coalesce(c.valid_from, '') AS vf, c.ord, u.pos, u.e.exact_quote AS quote, substr(sha256(coalesce(u.e.source_id, '') || ':' || substr(coalesce(u.e.exact_quote, ''), 1, 100)), 1, 16) AS eid FROM claims c, unnest(c.evidence) WITH ORDINALITY AS u(e, pos)),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, relation, object_id, eid ORDER BY vf, ord, pos) AS rn FROM e) WHERE rn = 1),
 g AS (SELECT subject_id, relation, object_id, string_agg(eid, '|' ORDER BY vf, ord, pos) AS ids FROM o GROUP BY subject_id, relation, object_id),
 s AS (SELECT ord, string_agg(eid, '|' ORDER BY pos) AS ids FROM e GROUP BY ord)
 SELECT d.ord, d.id, d.subject_id, d.relation, d.object_id, d.confidence, d.valid_from, d.members, d.first_ord, coalesce(CASE WHEN members > 1 THEN g.ids ELSE s.ids END, '') AS evidence_ids
 FROM {_DEDUP} d LEFT JOIN g USING (subject_id, relation, object_id) LEFT JOIN s ON s.ord = d.ord""")
def claim_dedup(spark, d):
    c = dedup.dedup_claims(_claims(spark, d))
    ids = F.coalesce(_joined(F.transform("evidence", lambda e: T.evidence_id(e.source_id, e.exact_quote))), F.lit(""))
    return c.select("ord", "id", *dedup.TRIPLE, "confidence", "valid_from", "members", "first_ord", ids.alias("evidence_ids"))


_CSNAP = "ord || '~' || id || '~' || coalesce(valid_from, '-') || '~' || coalesce(is_current::VARCHAR, '-') || '~' || coalesce(len(evidence), -1)"
_CLOG = f"(SELECT subject_id, relation, object_id, count(*) AS n, string_agg(id, '|' ORDER BY coalesce(valid_from, ''), ord) AS source_ids, first(id ORDER BY coalesce(valid_from, ''), ord) AS target_id, first(ord ORDER BY coalesce(valid_from, ''), ord) AS target_ord, string_agg({_CSNAP}, '#' ORDER BY coalesce(valid_from, ''), ord) AS snapshots FROM {_CLAIMS} GROUP BY subject_id, relation, object_id HAVING count(*) > 1)"


def _claim_store(spark, d) -> tuple[Store, DataFrame]:
    c = _claims(spark, d).select(*names_of(CLAIMS))
    unique = stash(dedup.dedup_claims(c), "unique")
    return Store(table(spark, d, "entities"), unique.select(*c.columns), dedup.claim_merges(c, unique, RUN_TS)), unique


def _told(snapshot) -> F.Column:
    kept = F.from_json(snapshot, CLAIMS)
    return F.concat_ws("~", kept.ord.cast("string"), kept.id, F.coalesce(kept.valid_from, F.lit("-")), F.coalesce(kept.is_current.cast("string"), F.lit("-")), F.coalesce(F.size(kept.evidence), F.lit(-1)).cast("string"))


@query(f"SELECT n, source_ids, target_id, target_ord, 'Same triple: ' || concat_ws('::', subject_id, relation, object_id) AS reason, snapshots FROM {_CLOG}")
def claim_merge_log(spark, d):
    """The audit of merged claims, each with its members' snapshots; ids may repeat within a merge."""
    log = _claim_store(spark, d)[0].merge_log
    told = log.members.select("merge_id", "place", "ord", "id", _told(F.col("snapshot")).alias("told")).groupBy("merge_id").agg(F.sort_array(F.collect_list(F.struct("place", "ord", "id", "told"))).alias("m"))
    out = log.records.join(told, "merge_id")
    return out.select("n", _joined(F.transform("m", lambda x: x.id)).alias("source_ids"), "target_id", "target_ord", "reason", F.array_join(F.transform("m", lambda x: x.told), "#").alias("snapshots"))


_CBIG = f"(SELECT target_ord FROM {_CLOG} ORDER BY n DESC, target_ord LIMIT 1)"


@query(f"""WITH u AS (SELECT c.* FROM {_CLAIMS} c JOIN {_CLOG} g USING (subject_id, relation, object_id) WHERE g.target_ord IN {_CBIG})
 SELECT ord, id, subject_id, relation, object_id, coalesce(valid_from, '-') AS valid_from, coalesce(confidence, -9) AS confidence FROM u
 UNION ALL SELECT ord, id, subject_id, relation, object_id, coalesce(valid_from, '-'), coalesce(confidence, -9) FROM {_DEDUP} WHERE ord NOT IN {_CBIG}""")
def claim_merge_undo(spark, d):
    """The claims after all merges but one: the largest is undone."""
    store, unique = _claim_store(spark, d)
    merge_id = store.merge_log.records.orderBy(F.desc("n"), "target_ord").first().merge_id
    c = dedup.undo_merge(store, merge_id).claims
    return c.select("ord", "id", *dedup.TRIPLE, F.coalesce("valid_from", F.lit("-")).alias("valid_from"), F.coalesce("confidence", F.lit(-9.0)).alias("confidence"))


@query(f"""WITH w AS (SELECT *, relation IN ('status_changed', 'assigned_to', 'labeled', 'approved') AND min(object_id) OVER p != max(object_id) OVER p AS applies, lead(object_id) OVER o AS nxt, lead(valid_from) OVER o AS nvf, row_number() OVER o = count(*) OVER p AS last_one
 FROM {_DEDUP} WINDOW p AS (PARTITION BY subject_id, relation), o AS (PARTITION BY subject_id, relation ORDER BY coalesce(valid_from, ''), first_ord))
 SELECT ord, subject_id, relation, object_id, CASE WHEN applies AND nxt != object_id THEN nvf ELSE valid_until END AS valid_until, CASE WHEN applies AND nxt != object_id THEN false WHEN applies AND last_one THEN true ELSE is_current END AS is_current FROM w""")
def conflict_resolve(spark, d):
    c = dedup.resolve_conflicts(dedup.dedup_claims(_claims(spark, d)), "first_ord")
    return c.select("ord", *dedup.TRIPLE, "valid_until", "is_current")


@query("SELECT ord FROM claims WHERE subject_id IN (SELECT id FROM entities) AND object_id IN (SELECT id FROM entities)")
def orphan_semi(spark, d):
    return dedup.without_orphans(_claims(spark, d), table(spark, d, "entities")).select("ord")


# The whole pipeline on real names: components by equal names, joined by trigram vectors with a cosine of 0.9 or more.
_SIMILAR = f"""g AS (SELECT * FROM {_GROUPS}), h AS (SELECT ord, entity_type, '  ' || lower(coalesce(name, '')) || ' ' AS padded FROM g WHERE ord = component AND entity_type != 'User'),
 grams AS (SELECT ord, entity_type, md5(substr(padded, i::BIGINT, 3)) AS m FROM h, unnest(generate_series(1, length(padded) - 2)) AS u(i)),
 v AS (SELECT ord, entity_type, ('0x' || substr(m, 1, 4))::INT % 64 AS at, sum(CASE WHEN ('0x' || substr(m, 5, 1))::INT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM grams GROUP BY ALL),
 norms AS (SELECT ord, greatest(sqrt(sum(x * x)), 1e-9) AS nn FROM v GROUP BY ord),
 near AS (SELECT p.a, p.b FROM (SELECT a.ord AS a, b.ord AS b, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.entity_type = b.entity_type AND a.at = b.at AND a.ord < b.ord GROUP BY a.ord, b.ord) p JOIN norms n ON n.ord = p.a JOIN norms o ON o.ord = p.b WHERE p.dot / (n.nn * o.nn) >= 0.9 - 1e-9),
 links AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(v, c) AS (SELECT ord, ord FROM h UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v), roots AS (SELECT v, min(c) AS root FROM reach GROUP BY v),
 parts AS (SELECT g.* EXCLUDE (component), coalesce(r.root, g.component) AS component FROM g LEFT JOIN roots r ON r.v = g.component),
 canon AS (SELECT component, first(ord ORDER BY length(name), coalesce(first_seen, ''), ord) AS ord, first(id ORDER BY length(name), coalesce(first_seen, ''), ord) AS id, first(name ORDER BY length(name), coalesce(first_seen, ''), ord) AS name, flatten(list(list_append(coalesce(aliases, []), name))) AS names, count(*) AS members FROM parts GROUP BY component),
 moved AS (SELECT p.id, c.id AS to_id FROM parts p JOIN canon c USING (component)),
 remapped AS (SELECT c.* REPLACE (coalesce(s.to_id, c.subject_id) AS subject_id, coalesce(o.to_id, c.object_id) AS object_id) FROM {_CLAIMS} c LEFT JOIN moved s ON s.id = c.subject_id LEFT JOIN moved o ON o.id = c.object_id),
 uni AS (SELECT * FROM {_deduplicated('remapped')}),
 w AS (SELECT *, relation IN ('status_changed', 'assigned_to', 'labeled', 'approved') AND min(object_id) OVER p != max(object_id) OVER p AS applies, lead(object_id) OVER o AS nxt, lead(valid_from) OVER o AS nvf, row_number() OVER o = count(*) OVER p AS last_one FROM uni WINDOW p AS (PARTITION BY subject_id, relation), o AS (PARTITION BY subject_id, relation ORDER BY coalesce(valid_from, ''), first_ord)),
 res AS (SELECT * REPLACE (CASE WHEN applies AND nxt != object_id THEN nvf ELSE valid_until END AS valid_until, CASE WHEN applies AND nxt != object_id THEN false WHEN applies AND last_one THEN true ELSE is_current END AS is_current), coalesce(applies AND nxt != object_id, false) AS superseded FROM w),
 kept AS (SELECT * FROM res WHERE subject_id IN (SELECT id FROM canon) AND object_id IN (SELECT id FROM canon))"""


def _pipeline(spark, d) -> tuple[Store, DataFrame]:
    e = table(spark, d, "entities").select(*names_of(ENTITIES))
    vectors = e.select("ord", retrieval.embed(F.col("name")).alias("vec"))
    return dedup.run_full_pipeline(Store(e, _claims(spark, d).select(*names_of(CLAIMS))), RUN_TS, vectors)


@query(f"WITH RECURSIVE {_SIMILAR} SELECT ord, id, name, array_to_string(list_sort(list_filter(list_distinct(names), lambda x: x != name)), '|') AS aliases FROM canon")
def pipeline_entities(spark, d):
    return _pipeline(spark, d)[0].entities.select("ord", "id", "name", _joined("aliases").alias("aliases"))


@query(f"WITH RECURSIVE {_SIMILAR} SELECT ord, id, subject_id, relation, object_id, coalesce(confidence, -9) AS confidence, valid_from, valid_until, is_current FROM kept")
def pipeline_claims(spark, d):
    c = _pipeline(spark, d)[0].claims
    return c.select("ord", "id", *dedup.TRIPLE, F.coalesce("confidence", F.lit(-9.0)).alias("confidence"), "valid_from", "valid_until", "is_current")


@query(f"""WITH RECURSIVE {_SIMILAR} SELECT (SELECT count(*) FROM entities) - (SELECT count(DISTINCT component) FROM g) AS exact_merges, (SELECT count(DISTINCT component) FROM g) - (SELECT count(*) FROM canon) AS semantic_merges,
 (SELECT count(*) FROM claims) - (SELECT count(*) FROM uni) AS claim_merges, (SELECT count_if(superseded)::BIGINT FROM res) AS conflicts, (SELECT count(*) FROM uni) - (SELECT count(*) FROM kept) AS orphans, (SELECT count(*) FROM canon) AS entities, (SELECT count(*) FROM kept) AS claims,
 (SELECT count(*) FROM canon WHERE members > 1) + (SELECT count(*) FROM uni WHERE members > 1) AS log_records""")
def pipeline_counters(spark, d):
    store, counters = _pipeline(spark, d)
    return counters.crossJoin(store.merge_log.records.agg(F.count(F.lit(1)).alias("log_records")))


# ---------------------------------------------------------------- graph
_EDGES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM {_CLAIMS} WHERE subject_id IN (SELECT id FROM entities) AND object_id IN (SELECT id FROM entities)) WHERE rn = 1)"
_ENDS = f"(SELECT subject_id AS id FROM {_EDGES} UNION ALL SELECT object_id FROM {_EDGES})"
_DEGREE = f"(SELECT e.id, count(x.id) AS degree FROM entities e LEFT JOIN {_ENDS} x ON x.id = e.id GROUP BY e.id)"
#: Lookups ask for every entity whose ord is divisible by 100, against all rows.
_SEEDS = "(SELECT id FROM entities WHERE ord % 100 = 0)"


def _graph(spark, d) -> graph.Graph:
    return graph.ingest(table(spark, d, "entities"), _claims(spark, d))[0].stored()


def _seeds(g: graph.Graph) -> DataFrame:
    return g.vertices.where("ord % 100 = 0")


_COUNTS = f"SELECT (SELECT count(*) FROM entities) AS total_entities_ingested, (SELECT count(*) FROM {_EDGES}) AS total_claims_ingested, 0::BIGINT AS duplicate_entities_skipped, (SELECT count(*) FROM claims WHERE subject_id IN (SELECT id FROM entities) AND object_id IN (SELECT id FROM entities)) - (SELECT count(*) FROM {_EDGES}) AS duplicate_claims_skipped, (SELECT count(*) FROM claims WHERE subject_id NOT IN (SELECT id FROM entities) OR object_id NOT IN (SELECT id FROM entities)) AS orphan_claims_skipped"


@query(_COUNTS)
def ingest_counts(spark, d):
    return graph.ingest(table(spark, d, "entities"), _claims(spark, d))[1]


@query(f"SELECT (SELECT count(*) FROM {_EDGES}) AS edges, 0::BIGINT AS again")
def ingest_again(spark, d):
    e, c = table(spark, d, "entities"), _claims(spark, d)
    g = graph.ingest(e, c)[0]
    twice, counters = graph.ingest(e, c, g)
    return twice.edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(counters.select(F.col("total_claims_ingested").alias("again")))


@query("SELECT id, name, entity_type FROM entities WHERE ord % 100 = 0")
def node_lookup(spark, d):
    g = _graph(spark, d)
    one = [graph.node(g, r.id) for r in _seeds(g).orderBy("ord").select("id").limit(1).collect()]
    rest = g.vertices.join(_seeds(g).select("id"), "id", "left_semi")
    return (rest if not one else one[0].select(*rest.columns).union(rest)).select("id", "name", "entity_type").distinct()


@query(f"SELECT s.id AS entity_id, c.ord, c.id FROM claims c, {_SEEDS} s WHERE c.subject_id = s.id OR c.object_id = s.id")
def claims_for_entity(spark, d):
    e = table(spark, d, "entities").where("ord % 100 = 0")
    return graph.claims_of_entities(_claims(spark, d), e).select("entity_id", "ord", "id")


_AROUND = f"(SELECT subject_id AS entity_id, object_id AS neighbor_id, 'outgoing' AS direction, id, is_current FROM {_EDGES} WHERE subject_id IN {_SEEDS} UNION ALL SELECT object_id, subject_id, 'incoming', id, is_current FROM {_EDGES} WHERE object_id IN {_SEEDS})"


@query(f"SELECT entity_id, neighbor_id, direction, id FROM {_AROUND} WHERE is_current")
def neighbors(spark, d):
    g = _graph(spark, d)
    return graph.neighbors(g.edges, _seeds(g)).select("entity_id", "neighbor_id", "direction", "id")


@query("SELECT id FROM entities WHERE contains(lower(name), 'gas') OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'gas'))) > 0")
def entity_search(spark, d):
    return graph.find_by_name(table(spark, d, "entities"), "gas").select("id")


def _parts(g: graph.Graph) -> DataFrame:
    """Vertices and edges of a graph as (kind, id)."""
    return g.vertices.select(F.lit("vertex").alias("kind"), "id").union(g.edges.select(F.lit("edge"), "id"))


_SUB = "SELECT 'vertex' AS kind, id FROM entities WHERE id IN (SELECT id FROM {t}) UNION ALL SELECT 'edge', id FROM {e} WHERE subject_id IN (SELECT id FROM {t}) AND object_id IN (SELECT id FROM {t})"


@query(f"WITH l AS (SELECT subject_id AS a, object_id AS b FROM {_EDGES} UNION SELECT object_id, subject_id FROM {_EDGES}), k1 AS (SELECT id FROM {_SEEDS} UNION SELECT b FROM l WHERE a IN {_SEEDS}), k2 AS (SELECT id FROM k1 UNION SELECT b FROM l JOIN k1 ON l.a = k1.id) {_SUB.format(t='k2', e=_EDGES)}")
def subgraph_2hop(spark, d):
    g = _graph(spark, d)
    return _parts(graph.subgraph(g, _seeds(g), 2))


@query(f"SELECT id, degree FROM {_DEGREE}")
def node_degree(spark, d):
    return graph.degrees(_graph(spark, d))


@query(f"WITH t AS (SELECT id FROM {_DEGREE} ORDER BY degree DESC, id LIMIT 200) {_SUB.format(t='t', e=_EDGES)}")
def top_nodes(spark, d):
    return _parts(graph.top_nodes(_graph(spark, d), 200))


_TYPES, _RELS = ["User", "Organization", "Project"], ["mentions", "discussed", "approved", "decided", "sent_to"]


@query(f"""WITH v AS (SELECT id FROM entities WHERE entity_type IN ('User', 'Organization', 'Project')), e AS (SELECT * FROM {_EDGES} WHERE coalesce(confidence, 0) >= 0.5 AND is_current AND relation IN ('mentions', 'discussed', 'approved', 'decided', 'sent_to') AND subject_id IN (SELECT id FROM v) AND object_id IN (SELECT id FROM v)),
 g AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM e UNION ALL SELECT object_id FROM e) GROUP BY id), t AS (SELECT id FROM g ORDER BY degree DESC, id LIMIT 200)
 {_SUB.format(t='t', e='e')}""")
def graph_view(spark, d):
    return _parts(graph.view(_graph(spark, d), _TYPES, _RELS))


@query(f"WITH RECURSIVE p AS (SELECT subject_id AS a, object_id AS b FROM {_EDGES} UNION SELECT object_id, subject_id FROM {_EDGES}), r(v, c) AS (SELECT id, id FROM entities UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v) SELECT v AS id, min(c) AS component FROM r GROUP BY v")
def weak_components(spark, d):
    return graph.weak_components(_graph(spark, d))


@query(f"""WITH RECURSIVE p AS (SELECT subject_id AS a, object_id AS b FROM {_EDGES} UNION SELECT object_id, subject_id FROM {_EDGES}), r(v, c) AS (SELECT id, id FROM entities UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v), m AS (SELECT v, min(c) AS c FROM r GROUP BY v), n AS ({_COUNTS})
 SELECT 'totals' AS section, 'components' AS k, count(DISTINCT c)::DOUBLE AS v FROM m UNION ALL SELECT 'ingestion', name, value::DOUBLE FROM (UNPIVOT n ON COLUMNS(*) INTO NAME name VALUE value)
 UNION ALL SELECT 'entity_types' AS section, entity_type AS k, count(*)::DOUBLE AS v FROM entities GROUP BY entity_type UNION ALL SELECT 'relations', relation, count(*)::DOUBLE FROM {_EDGES} GROUP BY relation
 UNION ALL SELECT 'totals', 'nodes', count(*)::DOUBLE FROM entities UNION ALL SELECT 'totals', 'edges', count(*)::DOUBLE FROM {_EDGES}
 UNION ALL SELECT 'evidence', 'total', sum(coalesce(len(evidence), 0))::DOUBLE FROM {_EDGES} UNION ALL SELECT 'evidence', 'average', round(avg(coalesce(len(evidence), 0)), 6) FROM {_EDGES} UNION ALL SELECT 'evidence', 'without', count_if(coalesce(len(evidence), 0) = 0)::DOUBLE FROM {_EDGES}
 UNION ALL SELECT 'confidence', 'mean', round(avg(confidence), 6) FROM {_EDGES} UNION ALL SELECT 'confidence', 'min', min(confidence) FROM {_EDGES} UNION ALL SELECT 'confidence', 'max', max(confidence) FROM {_EDGES}
 UNION ALL SELECT 'validity', 'current', count_if(is_current)::DOUBLE FROM {_EDGES} UNION ALL SELECT 'validity', 'historical', count_if(NOT is_current)::DOUBLE FROM {_EDGES}""")
def graph_metrics(spark, d):
    return graph.metrics(_graph(spark, d)).select("section", "k", F.round("v", 6).alias("v"))


def _case(c: str, colours: dict[str, str], other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in colours.items()) + f" ELSE '{other}' END"


@query(f"SELECT e.id, substr(e.name, 1, 30) AS label, (15 + least(3 * g.degree, 30))::BIGINT AS size, {_case('entity_type', graph.NODE_COLOURS, graph.NODE_OTHER)} AS colour, entity_type || ': ' || name || ' | ' || coalesce(array_to_string(aliases[1:5], ', '), '') AS tooltip FROM entities e JOIN {_DEGREE} g USING (id)")
def node_style(spark, d):
    return graph.node_style(_graph(spark, d))


@query(f"SELECT id, CASE WHEN NOT is_current THEN '{graph.EDGE_PAST}' ELSE {_case('relation', graph.EDGE_COLOURS, graph.EDGE_OTHER)} END AS colour, greatest(1.0::DOUBLE, 3 * coalesce(confidence, 0)) AS width, NOT is_current AS dashed, coalesce(array_to_string(list_transform(evidence[1:3], lambda e: substr(coalesce(e.exact_quote, ''), 1, 100)), ' / '), '') AS tooltip FROM {_EDGES}")
def edge_style(spark, d):
    return graph.edge_style(_graph(spark, d))


@query(f"SELECT 'entity_type' AS kind, entity_type AS value FROM entities UNION SELECT 'relation', relation FROM {_EDGES}")
def selector_lists(spark, d):
    return graph.selector_lists(_graph(spark, d))


@query("SELECT id, len(aliases) AS n_aliases FROM entities WHERE len(aliases) > 0 ORDER BY ord LIMIT 50")
def merged_entities(spark, d):
    return graph.merged_entities(table(spark, d, "entities")).select("id", F.size("aliases").cast("bigint").alias("n_aliases"))


@query("SELECT id FROM entities WHERE contains(lower(name), 'gas') OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'gas'))) > 0 ORDER BY ord LIMIT 10")
def first_matches(spark, d):
    return graph.first_matches(table(spark, d, "entities"), "gas").select("id")


@query(f"""SELECT upper('claim') || ' merge: ' || n || ' items → ' || target_id AS line, array_to_string(string_split(source_ids, '|')[1:10], ', ') AS sources FROM {_CLOG} ORDER BY target_ord LIMIT 50""")
def log_lines(spark, d):
    return graph.log_lines(_claim_store(spark, d)[0].merge_log).select("line", "sources")


@query(f"""SELECT c.id, coalesce(s.name, c.subject_id) || ' → ' || c.relation || ' → ' || coalesce(o.name, c.object_id) || ' (confidence: ' || printf('%.2f', round(coalesce(c.confidence, 0)::DECIMAL(18, 6), 2)::DOUBLE) || ', ' || CASE WHEN c.is_current THEN 'Current' ELSE 'Historical' END || ')' AS line,
 coalesce(array_to_string(list_transform(c.evidence, lambda e: '"' || coalesce(e.exact_quote, 'N/A') || '" Source: ' || coalesce(e.source_id, '?') || ' | Author: ' || coalesce(e.author, '?') || ' | Time: ' || coalesce(e."timestamp", '?')), chr(10)), '') AS quotes
 FROM {_EDGES} c LEFT JOIN entities s ON s.id = c.subject_id LEFT JOIN entities o ON o.id = c.object_id""")
def claim_lines(spark, d):
    g = _graph(spark, d)
    return graph.claim_lines(g.vertices, g.edges)


# ---------------------------------------------------------------- retrieval
#: Five questions show the context packs; searches ask one question for every entity whose ord is divisible by 100.
QUESTIONS = ["Which topics did Richard discuss about gas", "Who are the most active correspondents", "Which decisions were made about energy trading", "Which projects or deals were discussed", "Who communicated with Katherine"]
_SHOWN = "(SELECT qid::BIGINT AS qid, question FROM (VALUES " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(QUESTIONS)) + ") q(qid, question))"
_ASKED = "(SELECT ord AS qid, 'What is known about ' || name AS question FROM entities WHERE ord % 100 = 0 AND name IS NOT NULL)"
_INDEX = "(SELECT e.id AS entity_id, e.ord, u.spos - 1 AS spos, u.surface FROM entities e, unnest(list_prepend(e.name, coalesce(e.aliases, []))) WITH ORDINALITY AS u(surface, spos) WHERE u.surface != '')"
_VECS = f"(SELECT i.entity_id, i.spos, v.embedding::DOUBLE[] AS vec FROM {_INDEX} i JOIN embeddings v ON v.vec_id = (i.ord * 31 + i.spos * 97) % (SELECT count(*) FROM embeddings))"
def _sims(q: str) -> str:
    return f"(SELECT q.qid, i.entity_id, i.spos, list_dot_product(i.vec, w.embedding::DOUBLE[]) AS sim FROM {_VECS} i, {q} q JOIN embeddings w ON w.vec_id = q.qid % (SELECT count(*) FROM embeddings))"


def _topk(q: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, entity_id, spos) AS rn FROM {_sims(q)}) WHERE rn <= 15)"


def _hits(q: str) -> str:
    return f"(SELECT DISTINCT q.qid, i.entity_id FROM (SELECT id AS entity_id, list_transform(list_prepend(name, coalesce(aliases, [])), lambda s: lower(s)) AS names FROM entities) i, (SELECT DISTINCT qid, unnest(regexp_split_to_array(lower(question), '\\s+')) AS w FROM {q}) q WHERE length(q.w) >= 3 AND len(list_filter(i.names, lambda s: contains(s, q.w))) > 0)"


def _match(q: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity_id) AS rank FROM (SELECT coalesce(s.qid, h.qid) AS qid, coalesce(s.entity_id, h.entity_id) AS entity_id, coalesce(s.sim, 0.3::DOUBLE) + CASE WHEN h.qid IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END AS score FROM (SELECT qid, entity_id, max(sim) AS sim FROM {_topk(q)} GROUP BY qid, entity_id) s FULL JOIN {_hits(q)} h ON h.qid = s.qid AND h.entity_id = s.entity_id)) WHERE rank <= 5)"


def _items(q: str) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank, direction DESC, ord) AS place FROM (SELECT *, score * coalesce(confidence, 0) * CASE WHEN is_current THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END AS relevance FROM (
 SELECT m.qid, m.score, m.rank, x.*, row_number() OVER (PARTITION BY m.qid, x.id ORDER BY m.rank, x.direction DESC) AS b FROM {_match(q)} m JOIN (SELECT subject_id AS entity_id, 'outgoing' AS direction, * FROM {_EDGES} UNION ALL SELECT object_id, 'incoming', * FROM {_EDGES}) x ON x.entity_id = m.entity_id) WHERE b = 1)) WHERE place <= 10)"""


def _vectored(spark, d, q: DataFrame) -> DataFrame:
    v = table(spark, d, "embeddings")
    return q.withColumn("vec_id", F.col("qid") % v.count()).join(v.select("vec_id", F.col("embedding").alias("qvec")), "vec_id").select("qid", "question", "qvec")


def _questions(spark, d) -> DataFrame:
    return _vectored(spark, d, spark.createDataFrame(list(enumerate(QUESTIONS)), "qid bigint, question string"))


def _asked(spark, d) -> DataFrame:
    e = table(spark, d, "entities").where("ord % 100 = 0 and name is not null")
    return _vectored(spark, d, e.select(F.col("ord").alias("qid"), F.concat(F.lit("What is known about "), "name").alias("question")))


def _index(spark, d, g: graph.Graph) -> DataFrame:
    v = table(spark, d, "embeddings")
    n = v.count()
    i = retrieval.name_index(g.vertices).withColumn("vec_id", (F.col("ord") * 31 + F.col("spos") * 97) % n)
    return i.join(v.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("entity_id", "spos", "vec")


@query(f"SELECT entity_id, spos, surface FROM {_INDEX}")
def name_index(spark, d):
    return retrieval.name_index(table(spark, d, "entities")).select("entity_id", F.col("spos").cast("bigint").alias("spos"), "surface")


@query(f"SELECT qid, entity_id FROM {_hits(_ASKED)}")
def keyword_match(spark, d):
    return retrieval.keyword_match(table(spark, d, "entities"), _asked(spark, d))


@query(f"SELECT qid, entity_id, spos, round(sim, 6) AS sim FROM {_topk(_ASKED)}")
def vector_topk(spark, d):
    t = retrieval.vector_topk(_index(spark, d, _graph(spark, d)), _asked(spark, d), 15)
    return t.select("qid", "entity_id", F.col("spos").cast("bigint").alias("spos"), F.round("sim", 6).alias("sim"))


@query("SELECT q.vec_id AS qid, k.vec_id AS found, round(k.sim, 6) AS sim FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q, LATERAL (SELECT e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings e ORDER BY sim DESC, e.vec_id LIMIT 10) k")
def embedding_search(spark, d):
    """The ten nearest rows of every vector whose id is divisible by 100, against all rows."""
    v = table(spark, d, "embeddings")
    index = v.select(F.col("vec_id").alias("entity_id"), F.lit(0).alias("spos"), F.col("embedding").alias("vec"))
    t = retrieval.vector_topk(index, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 10)
    return t.select("qid", F.col("entity_id").alias("found"), F.round("sim", 6).alias("sim"))


@query(f"SELECT qid, entity_id, round(score, 6) AS score, rank FROM {_match(_ASKED)}")
def blend_scores(spark, d):
    g = _graph(spark, d)
    m = retrieval.match_entities(g, _index(spark, d, g), _asked(spark, d))
    return m.select("qid", "entity_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _retrieved(spark, d, questions: DataFrame, **options) -> tuple[graph.Graph, DataFrame, DataFrame]:
    """Graph, matched entities and items; matching is done once for both."""
    g = _graph(spark, d)
    matched = stash(retrieval.match_entities(g, _index(spark, d, g), questions), "matched")
    return g, matched, retrieval.retrieve(g, matched, **options)


@query(f"SELECT i.qid, i.place, i.id AS claim_id, coalesce(s.name, i.subject_id) AS subject, i.relation, coalesce(o.name, i.object_id) AS object, round(i.relevance, 6) AS relevance FROM {_items(_ASKED)} i LEFT JOIN entities s ON s.id = i.subject_id LEFT JOIN entities o ON o.id = i.object_id")
def retrieve_items(spark, d):
    r = _retrieved(spark, d, _asked(spark, d))[2]
    return r.select("qid", F.col("place").cast("bigint").alias("place"), "claim_id", "subject", "relation", "object", F.round("relevance", 6).alias("relevance"))


@query(f"SELECT qid, place, id AS claim_id, is_current, round(relevance, 6) AS relevance FROM {_items(_ASKED).replace(_EDGES, f'(SELECT * FROM {_EDGES} WHERE is_current)')}")
def retrieve_current(spark, d):
    r = _retrieved(spark, d, _asked(spark, d), include_historical=False)[2]
    return r.select("qid", F.col("place").cast("bigint").alias("place"), "claim_id", "is_current", F.round("relevance", 6).alias("relevance"))


_BLOCKS = f"""b AS (SELECT i.qid, string_agg(chr(10) || '  [' || i.place || '] ' || coalesce(s.name, i.subject_id) || ' --' || i.relation || '--> ' || coalesce(o.name, i.object_id) || chr(10) || '      Status: ' || CASE WHEN i.is_current THEN 'CURRENT' ELSE 'HISTORICAL (until ' || coalesce(i.valid_until, '') || ')' END || ' | Confidence: ' || coalesce(i.confidence, 0::DOUBLE) || chr(10) || '      Valid from: ' || coalesce(i.valid_from, 'None') ||
 coalesce(array_to_string(list_transform(i.evidence, lambda e: chr(10) || '      EVIDENCE [source: ' || coalesce(e.source_id, 'unknown') || ']:' || chr(10) || '        "' || coalesce(e.exact_quote, '') || '"' || chr(10) || '        -- ' || coalesce(e.author, 'unknown') || ' at ' || coalesce(e."timestamp", 'unknown')), ''), ''), chr(10) ORDER BY i.place) AS blocks FROM {_items(_SHOWN)} i LEFT JOIN entities s ON s.id = i.subject_id LEFT JOIN entities o ON o.id = i.object_id GROUP BY i.qid)"""


@query(f"""WITH {_BLOCKS},
 n AS (SELECT m.qid, string_agg('  - ' || e.name || ' [' || e.entity_type || ']' || CASE WHEN len(e.aliases) > 0 THEN ' (aliases: ' || array_to_string(e.aliases, ', ') || ')' ELSE '' END, chr(10) ORDER BY m.rank) AS names FROM {_match(_SHOWN)} m JOIN entities e ON e.id = m.entity_id GROUP BY m.qid)
 SELECT q.qid, concat_ws(chr(10), 'CONTEXT FOR QUERY: ' || q.question || chr(10), 'MATCHED ENTITIES:' || chr(10) || n.names || chr(10), 'RELEVANT CLAIMS (ranked by relevance):', b.blocks) AS context FROM {_SHOWN} q LEFT JOIN n USING (qid) LEFT JOIN b USING (qid)""")
def format_context(spark, d):
    q = _questions(spark, d)
    g, matched, items = _retrieved(spark, d, q)
    return retrieval.format_context(items, matched, g.vertices, q)


_PACK = "query string, matched_entities array<struct<entity_id:string,name:string,entity_type:string,aliases:array<string>,match_score:double>>, items array<struct<claim_id:string,subject:string,relation:string,object:string,confidence:double,is_current:boolean,valid_from:string,valid_until:string,evidence:array<struct<source_id:string>>,relevance_score:double>>"


@query(f"""WITH n AS (SELECT m.qid, string_agg(e.id || '~' || e.name || '~' || e.entity_type || '~' || coalesce(array_to_string(e.aliases, ','), '-') || '~' || printf('%.3f', m.score), '#' ORDER BY m.rank) AS entities FROM {_match(_SHOWN)} m JOIN entities e ON e.id = m.entity_id GROUP BY m.qid),
 i AS (SELECT i.qid, string_agg(i.id || '~' || coalesce(s.name, i.subject_id) || '~' || i.relation || '~' || coalesce(o.name, i.object_id) || '~' || printf('%.3f', coalesce(i.confidence, 0)) || '~' || i.is_current || '~' || coalesce(i.valid_from, '-') || '~' || coalesce(i.valid_until, '') || '~' || coalesce(len(i.evidence), -1) || '~' || printf('%.3f', i.relevance), '#' ORDER BY i.place) AS items FROM {_items(_SHOWN)} i LEFT JOIN entities s ON s.id = i.subject_id LEFT JOIN entities o ON o.id = i.object_id GROUP BY i.qid)
 SELECT q.qid, q.question AS query, coalesce(n.entities, '') AS entities, coalesce(i.items, '') AS items FROM {_SHOWN} q LEFT JOIN n USING (qid) LEFT JOIN i USING (qid)""")
def context_dict(spark, d):
    """The packs as they are written (JSON) and read again, flattened."""
    q = _questions(spark, d)
    g, matched, items = _retrieved(spark, d, q)
    path = scratch_path(spark, "packs")
    stores.save_packs(retrieval.context_packs(items, matched, g.vertices, q), path)
    p = spark.read.text(path).select(F.from_json("value", _PACK).alias("p")).select("p.*").join(q.select("qid", F.col("question").alias("query")), "query")
    three = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))
    none = lambda c, other="-": F.coalesce(c, F.lit(other))
    entity = lambda e: F.concat_ws("~", e.entity_id, e["name"], e.entity_type, none(_joined_by(e.aliases, ",")), three(e.match_score))
    item = lambda i: F.concat_ws("~", i.claim_id, i.subject, i.relation, i.object, three(i.confidence), i.is_current.cast("string"), none(i.valid_from), none(i.valid_until, ""), none(F.size(i.evidence).cast("string"), "-1"), three(i.relevance_score))
    text = lambda c, f: none(F.array_join(F.transform(c, f), "#"), "")
    return p.select("qid", "query", text("matched_entities", entity).alias("entities"), text("items", item).alias("items"))


def _joined_by(c, by: str) -> F.Column:
    return F.array_join(c, by)


@query(f"WITH {_BLOCKS} SELECT q.qid, coalesce(b.blocks, '{retrieval.NO_ANSWER.replace(chr(39), chr(39) * 2)}') AS answer FROM {_SHOWN} q LEFT JOIN b USING (qid)")
def answer_question(spark, d):
    q = _questions(spark, d)
    return retrieval.answer(_retrieved(spark, d, q)[2], q)


# ---------------------------------------------------------------- stores and streams
_STORED = "SELECT ord, id, relation, confidence, len(evidence) AS n_evidence, 'v9' AS extraction_version, 'mail' AS corpus_source FROM "


def _roundtrip(spark, d, form: str) -> DataFrame:
    path = scratch_path(spark, "store")
    e = table(spark, d, "entities")
    stores.save_store(Store(e, _claims(spark, d), extraction_version="v9", corpus_source="mail"), path, form=form)
    s = stores.load_store(spark, path, validate=False, form=form)
    return s.claims.select("ord", "id", "relation", "confidence", F.nullif(F.size("evidence"), F.lit(-1)).cast("bigint").alias("n_evidence"), F.lit(s.extraction_version).alias("extraction_version"), F.lit(s.corpus_source).alias("corpus_source"))


@query(_STORED + _CLAIMS)
def store_roundtrip(spark, d):
    return _roundtrip(spark, d, "parquet")


@query(_STORED + _CLAIMS)
def store_json_roundtrip(spark, d):
    return _roundtrip(spark, d, "json")


@query("SELECT issue_id::BIGINT AS issue_id, title, coalesce(len(comments), -1) AS n FROM raw_corpus")
def corpus_roundtrip(spark, d):
    """The corpus written as JSON and read again; a second write leaves it alone."""
    path = scratch_path(spark, "corpus")
    t = table(spark, d, "raw_corpus")
    stores.write_corpus(t, path)
    stores.write_corpus(t.limit(0), path)
    return stores.read_corpus(spark, path, lines=True).select(F.col("issue_id").cast("bigint").alias("issue_id"), "title", F.coalesce(F.size("comments"), F.lit(-1)).cast("bigint").alias("n"))


@query(f"WITH n AS ({_COUNTS}) SELECT id, subject_id, object_id, n.* FROM {_EDGES}, n")
def graph_roundtrip(spark, d):
    """Edges and counters of a graph saved, copied to the outputs and loaded again."""
    path = scratch_path(spark, "graph")
    stores.save_graph(_graph(spark, d), f"{path}/data")
    stores.copy_outputs(spark, f"{path}/data", f"{path}/outputs", ["vertices", "edges", "counters", "nothing"])
    g = stores.load_graph(spark, f"{path}/outputs")
    return g.edges.select("id", "subject_id", "object_id").crossJoin(g.counters)


@query("""WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM claims) WHERE rn = 1),
 w AS (SELECT *, relation IN ('status_changed', 'assigned_to', 'labeled', 'approved') AND min(object_id) OVER p != max(object_id) OVER p AS applies, lead(object_id) OVER o AS nxt, lead(valid_from) OVER o AS nvf, row_number() OVER o = count(*) OVER p AS last_one FROM u WINDOW p AS (PARTITION BY subject_id, relation), o AS (PARTITION BY subject_id, relation ORDER BY coalesce(valid_from, ''), ord))
 SELECT id, ord, CASE WHEN applies AND nxt != object_id THEN nvf ELSE valid_until END AS valid_until, CASE WHEN applies AND nxt != object_id THEN false WHEN applies AND last_one THEN true ELSE is_current END AS is_current FROM w""")
def incremental_ingest(spark, d):
    path = scratch_path(spark, "stream")
    c = _claims(spark, d)
    for part in range(2):  # two deliveries, the second repeats the first
        c.write.mode("append").json(f"{path}/in")
        ingest_claims(spark, f"{path}/in", f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return current_claims(spark, f"{path}/store").select("id", "ord", "valid_until", "is_current")
