"""Redelivery, components, numbering and the micro-fixtures of the reference's operators."""

import io
import random

import pytest
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import dedup, extraction, graph, retrieval, threads
from lorespan.operators.components import connected_components
from lorespan.operators.ranking import next_within, number_within
from lorespan.operators.redelivery import drop_redelivered, redelivered
from lorespan.schema import CLAIMS, ENTITIES, Settings, Store
from lorespan.sources.mail import parse_message, read_archive, read_maildir

MAIL = "ord bigint, message_id string, ingested_at timestamp_ntz, bucket int, id string"


def test_redelivered_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([f"<A{rng.randint(0, 60)}@x>", f" a{rng.randint(0, 60)}@X ", None, "", " <> "]), None, 1, "z") for k in range(400)]
    df = spark.createDataFrame(rows, MAIL).withColumn("ingested_at", F.expr("cast(date_add(date'2002-01-01', cast(pmod(ord * 37, 900) as int)) as timestamp_ntz)"))
    norm = lambda x: (x or "").strip(" <>").lower()
    seen, want = set(), set()
    for o, i, *_ in rows:
        if norm(i) and norm(i) in seen:
            want.add(o)
        seen.add(norm(i))
    assert {r.ord for r in redelivered(df).collect()} == want
    assert drop_redelivered(df).count() == len(rows) - len(want)


def test_redelivered_one_hot_id_null_times_and_empty(spark):
    df = spark.range(300).selectExpr("id as ord", "case when id % 3 = 0 then 'hot@x' else concat(id, '@x') end as message_id", "cast(null as timestamp_ntz) as ingested_at", "'c' as first", "1 as copies")
    assert redelivered(df).count() == 99
    assert redelivered(df.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)] + [(1, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_a_hot_node(spark, monkeypatch):
    from lorespan.operators import components

    monkeypatch.setattr(components, "HOT_EDGES", 50)
    edges = [(7, k) for k in range(100, 300)] + [(k, k + 1000) for k in range(100, 160)] + [(k, k + 1) for k in range(2000, 2020)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in [7, *range(100, 300), *range(1100, 1160)]} == {7} and {got[k] for k in range(2000, 2021)} == {2000}
    both = spark.createDataFrame([(1, k) for k in range(2, 500)], "u long, v long")
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    plan = components._linked(both, low, 498)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_numbering_and_next_of_a_hot_group(spark):
    rows = [("hot", k // 3, k) for k in range(200)] + [("b", 1, 5), ("b", 0, 9), (None, 2, 1)]
    df = spark.createDataFrame(rows, "k string, t int, o int")
    ranked = number_within(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("o")], "n").collect()
    assert sorted(r.n for r in ranked if r.k == "hot") == list(range(1, 201)) and all(r.n == r.o + 1 for r in ranked if r.k == "hot")
    led = {(r.k, r.o): r.nx for r in next_within(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("o")], F.col("o"), "nx").collect()}
    assert all(led["hot", k].v == k + 1 for k in range(199)) and led["hot", 199] is None and led["b", 9].v == 5 and led["b", 5] is None


def test_subject_and_addresses(spark):
    df = spark.createDataFrame([("RE: Fwd: re: Re: Hello",), ("  FW:x ",), ("Regards",)], "s string")
    assert [r[0] for r in df.select(T.normalize_subject(F.col("s"))).collect()] == ["re: hello", "x", "regards"]
    a = spark.createDataFrame([("Doe, Jo <j@x.com>, k@x.com",), ("",)], "s string")
    assert [r[0] for r in a.select(T.split_addresses(F.col("s"))).collect()] == [["Jo <j@x.com>", "k@x.com"], []]


def test_artifact_dedup(spark):
    base = "Please review the attached gas contract today."
    rows = [(1, "m1", base), (2, "m2", base.lower().replace("the", "  the") + "\n> old line"), (3, "m3", "ok thanks"), (4, "m4", "ok thanks"), (5, "m5", f"FYI\n----- Forwarded by X -----\n{base}"), (6, "m6", base + "\n-- \nJo"), (7, None, None)]
    out = {r.k: r for r in dedup.dedup_artifacts(spark.createDataFrame(rows, "k int, c string, t string"), "t", ["k"], "c").collect()}
    assert [out[k].duplicate_of for k in range(1, 8)] == [None, "m1", None, None, None, "m1", None]
    assert out[5].fingerprint is None


def test_json_repair():
    assert extraction.repair_json('```json\n{"entities":[],"claims":[]}\n```') == {"entities": [], "claims": []}
    assert extraction.repair_json('Sure! {"entities": []} done') == {"entities": []}
    for bad in ('{"a":1} and {"b":2}', "{'a':1}", '{"a":1,}', "no json", None, "[1]"):
        assert extraction.repair_json(bad) == {}


def test_validation():
    e, _ = extraction.validate('{"entities":[{"name":" X ","entity_type":"Person"}, {"name": 3}]}', 7, "s", "t", "a")
    assert [(x["name"], x["entity_type"]) for x in e] == [("X", "Concept")] and e[0]["id"].startswith("ent_7_")
    ev = [{"exact_quote": "q"}]
    claims = [{"id": str(k), "subject_id": "a", "object_id": "b", "relation": "likes", "evidence": ev, "confidence": c} for k, c in enumerate([0.49, "0.8", 1.2, "x"])]
    claims += [{"id": "9", "evidence": []}, {"id": "10", "evidence": [{"timestamp": None}]}, {"id": "11", "evidence": [{"exact_quote": "q"}]}]
    import json

    _, c = extraction.validate(json.dumps({"claims": claims}), 7, "s", "t", "a")
    assert [(x["id"], x["relation"], x["confidence"]) for x in c] == [("clm_7_1", "related_to", 0.8), ("clm_7_11", "related_to", 0.7)]
    assert c[1]["evidence"][0]["timestamp"] == "t"
    assert extraction.validate('{"entities": null}', 1, "s", "t", "a") == ([], [])


def test_extract_retries_and_upsert(spark):
    p = spark.createDataFrame([(1, 0, "s", "t", "Jo", "Thread: x\nSource: s\nAuthor: Jo\nTime: t\nMet Ann Lee today")], "thread int, pos int, source_id string, timestamp string, author string, prompt string")
    built = extraction.build_records(extraction.extract(p)).first()
    assert [e.name for e in built.entities] == ["Jo", "Met Ann"] or "Ann Lee" in [e.name for e in built.entities]

    def broken(_):
        raise RuntimeError

    assert extraction.extract(p, broken).first().answer == "{}"
    calls = []

    def moody(prompts):
        calls.append(prompts)
        if "bad" in prompts[0] or len(calls) % 2:
            raise RuntimeError
        return ["[1]"]

    two = p.union(p.selectExpr("2", "pos", "source_id", "timestamp", "author", "'bad'")).coalesce(1)
    assert {r.thread: r.answer for r in extraction.extract(two, moody).collect()} == {1: "[1]", 2: "{}"}
    u = spark.createDataFrame([("a", 1, "1"), ("b", 2, "2"), ("a", 3, "3")], "id string, seq int, v string")
    assert [(r.id, r.v) for r in extraction.upsert(u, "id", "seq").orderBy("ord").collect()] == [("a", "3"), ("b", "2")]


def test_entities(spark):
    rows = [(1, "e1", "Risk Management", "Topic", None, "2001-02"), (2, "e2", "risk management", "Topic", [], "2001-01"), (3, "e3", "risk management", "Project", None, "2001-03"), (4, "e4", "A@x", "User", None, None), (5, "e5", "a@x ", "User", None, None)]
    e = spark.createDataFrame(rows, ENTITIES)
    parts = dedup.entity_components(e)
    canon = {r.id: r for r in dedup.canonicalize(e, parts).collect()}
    assert set(canon) == {"e2", "e3", "e4"} and canon["e2"].aliases == ["Risk Management"] and canon["e2"].first_seen == "2001-01" and canon["e4"].aliases == ["a@x "]
    c = spark.createDataFrame([(1, "c", "e1", "approved", "e3", None, 0.5, None, None, True, "v1")], CLAIMS)
    assert dedup.remap_claims(c, e, parts, dedup.canonicalize(e, parts)).first().subject_id == "e2"
    merged = dedup.canonicalize(e, parts)
    store = Store(merged.select(*e.columns), c, dedup.entity_merges(e, parts, merged, "t"))
    found = {r.target_id: r for r in dedup.merge_documents(store.merge_log).collect()}
    assert found["e2"].source_ids == ["e1", "e2"] and found["e4"].source_ids == ["e4", "e5"] and found["e2"].reason == "Dedup: 2 entities merged"
    assert [s.id for s in found["e2"].original_snapshots] == ["e1", "e2"]
    undone = dedup.undo_merge(store, found["e2"].merge_id)
    assert {(r.id, tuple(r.aliases or ())) for r in undone.entities.collect()} == {("e1", ()), ("e2", ()), ("e3", ()), ("e4", ("a@x ",))}
    assert undone.merge_log.records.count() == 1 and undone.claims is c
    with pytest.raises(ValueError):
        dedup.undo_merge(store, "nope")
    with pytest.raises(ValueError):
        dedup.undo_merge(undone, found["e2"].merge_id)


def test_merges_of_claims_with_repeated_ids_are_undone(spark):
    rows = [(1, "c", "u", "approved", "p", [ev("A")], 0.6, "2001-03", None, True, "v1"), (2, "c", "u", "approved", "p", [ev("B")], float("nan"), "2001-01", None, True, "v1"), (3, "c", "u", "decided", "p", None, None, None, None, True, "v1"), (4, "d", "u", "decided", "p", [], 0.5, None, None, None, None)]
    claims = spark.createDataFrame(rows, CLAIMS)
    unique = dedup.dedup_claims(claims)
    assert {r.ord: r.confidence for r in unique.collect()} == {2: 0.6, 3: 0.5}
    store = Store(spark.createDataFrame([], ENTITIES), unique.select(*claims.columns), dedup.claim_merges(claims, unique, "t"))
    one = store.merge_log.records.where("target_ord = 2").first()
    undone = dedup.undo_merge(store, one.merge_id)
    got = {r.ord: r for r in undone.claims.collect()}
    assert set(got) == {1, 2, 3} and got[1].confidence == 0.6 and got[2].confidence is None and got[2].evidence[0].source_id == "B" and got[3].confidence == 0.5
    assert [r.target_ord for r in undone.merge_log.records.collect()] == [3]


def test_full_pipeline(spark):
    e = [(1, "e1", "Gas", "Topic", None, "2001"), (2, "e2", "gas ", "Topic", None, "2000"), (3, "e3", "Gas desk Houston", "Topic", None, None), (4, "e4", "gas desk houston.", "Topic", None, None), (5, "e5", "Jo Doe", "User", None, None), (6, "e6", "Jo Doe.", "User", None, None)]
    c = [(1, "1", "e1", "approved", "e3", [ev("A")], 0.5, "2001", None, True, "v1"), (2, "2", "e2", "approved", "e4", [ev("B")], 0.9, "2002", None, True, "v1"), (3, "3", "e1", "approved", "e5", [ev("C")], 0.9, "2003", None, True, "v1"), (4, "4", "e1", "mentions", "lost", None, 0.9, None, None, True, "v1")]
    entities, claims = spark.createDataFrame(e, ENTITIES), spark.createDataFrame(c, CLAIMS)
    vectors = entities.select("ord", retrieval.embed(F.col("name")).alias("vec"))
    store, counters = dedup.run_full_pipeline(Store(entities, claims), "t", vectors)
    assert {r.id for r in store.entities.collect()} == {"e1", "e3", "e5", "e6"}
    assert counters.first().asDict() == {"exact_merges": 1, "semantic_merges": 1, "claim_merges": 1, "conflicts": 1, "orphans": 1, "entities": 4, "claims": 2}
    got = {r.id: r for r in store.claims.collect()}
    assert got["1"].confidence == 0.9 and got["1"].valid_until == "2003" and not got["1"].is_current and got["3"].is_current
    assert store.merge_log.records.count() == 3
    empty, none = dedup.run_full_pipeline(Store(entities.limit(0), claims.limit(0)), "t")
    assert empty.claims.count() == 0 and none.first().exact_merges == 0


def test_similar_chain_is_one_component(spark):
    import math

    angle = math.acos(0.95)
    rows = [(k, f"e{k}", f"name {k}", "Topic", None, None) for k in range(3)]
    v = spark.createDataFrame([(k, [math.cos(k * angle), math.sin(k * angle)]) for k in range(3)], "ord bigint, vec array<double>")
    parts = dedup.entity_components(spark.createDataFrame(rows, ENTITIES), v, Settings(similarity=0.9)).collect()
    assert {r.component for r in parts} == {0}


def test_similar_pairs_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, int(i % 2), [float(z) for z in v]) for i, v in enumerate(x)], "id bigint, block int, vec array<double>")
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if i % 2 == j % 2 and x[i] @ x[j] >= 0.8}
    got = [(r.a, r.b) for r in dedup.similar_pairs(df, 0.8, slice_rows=13).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, 0.8).collect()} == want


def ev(name):
    return (name, name, None, None, "t", None)


def test_claims_and_conflicts(spark):
    c = [
        (1, "c1", "u", "approved", "p", [ev("A"), ev("B")], 0.6, "2001-03", None, True, "v1"), (2, "c2", "u", "approved", "p", [ev("B"), ev("C")], 0.9, "2001-01", None, True, "v1"),
        (3, "c3", "u", "approved", "q", [ev("A"), ev("A")], 0.9, "2001-02", None, True, "v1"), (4, "c4", "u", "discussed", "q", None, 0.9, None, None, True, "v1"), (5, "c5", "u", "discussed", "p", [], None, "2001", None, True, "v1"),
    ]
    d = dedup.dedup_claims(spark.createDataFrame(c, CLAIMS))
    got = {r.id: r for r in d.collect()}
    assert [e.source_id for e in got["c2"].evidence] == ["B", "C", "A"] and got["c2"].confidence == 0.9 and got["c2"].valid_from == "2001-01"
    assert len(got["c3"].evidence) == 2 and got["c4"].evidence is None
    r = {x.id: x for x in dedup.resolve_conflicts(d, "first_ord").collect()}
    assert r["c2"].valid_until == "2001-02" and not r["c2"].is_current and r["c3"].is_current
    assert r["c4"].valid_until is None and r["c4"].is_current and r["c5"].is_current


def small_graph(spark):
    e = spark.createDataFrame([(k, i, i, "Topic", None, None) for k, i in enumerate(["a", "b", "a"])], ENTITIES)
    c = spark.createDataFrame([(1, "1", "a", "mentions", "b", [], 0.9, None, None, True, "v1"), (2, "1", "a", "mentions", "b", [], 0.9, None, None, True, "v1"), (3, "3", "a", "mentions", "z", [], 0.9, None, None, True, "v1"), (4, "4", "y", "mentions", "z", [], 0.9, None, None, True, "v1"), (5, "5", "a", "mentions", "a", [], 0.5, None, None, False, "v1")], CLAIMS)
    return e, c


def test_graph(spark):
    e, c = small_graph(spark)
    g, counters = graph.ingest(e, c)
    assert list(counters.first()) == [2, 2, 1, 1, 2]
    again, counters = graph.ingest(e, c, g)
    assert again.edges.count() == 2 and counters.first()[:2] == (0, 0)
    assert list(again.counters.first()) == [2, 2, 4, 4, 4]  # then 3 entities and 3 claims are known, 2 claims have no end
    a = g.vertices.where("id = 'a'")
    assert sorted(r.direction for r in graph.neighbors(g.edges.where("id = '5'"), a, current_only=False).collect()) == ["incoming", "outgoing"]
    assert {r.id: r.degree for r in graph.degrees(g).collect()} == {"a": 3, "b": 1}
    assert graph.subgraph(g, spark.createDataFrame([("nobody",)], "id string"), 2).vertices.count() == 0
    empty = {(r.section, r.k): r.v for r in graph.metrics(graph.Graph(g.vertices.limit(0), g.edges.limit(0))).collect()}
    assert empty["confidence", "mean"] == 0 and empty["evidence", "average"] == 0
    assert graph.find_by_name(g.vertices, "").count() == 2


def test_blend_and_ranking(spark):
    v = spark.createDataFrame([(1, "x", "gas desk", "Topic", None, None), (2, "y", "gas hub", "Topic", [], None), (3, "z", "other", "Topic", ["Gaz"], None)], ENTITIES)
    c = spark.createDataFrame([(1, "1", "x", "mentions", "y", [], 0.9, None, None, True, "v1"), (2, "2", "y", "mentions", "z", [], 1.0, None, None, True, "v1"), (3, "3", "x", "mentions", "z", [], 0.9, None, "2002", False, "v1")], CLAIMS)
    g = graph.ingest(v, c)[0]
    index = spark.createDataFrame([("x", 0, [0.8, 0.6])], "entity_id string, spos int, vec array<double>")
    q = spark.createDataFrame([(0, "gas of", [1.0, 0.0])], "qid int, question string, qvec array<double>")
    m = {r.entity_id: round(r.score, 6) for r in retrieval.match_entities(g, index, q).collect()}
    assert m == {"x": 1.1, "y": 0.6}
    items = [(r.claim_id, round(r.relevance, 4)) for r in retrieval.retrieve(g, retrieval.match_entities(g, index, q)).orderBy("place").collect()]
    assert items == [("1", 1.188), ("3", 0.792), ("2", 0.72)]
    assert retrieval.keyword_match(v, spark.createDataFrame([(0, "gas? a")], "qid int, question string")).count() == 0
    nothing = spark.createDataFrame([(5, "zzz", None)], "qid int, question string, qvec array<double>")
    assert retrieval.answer(retrieval.retrieve(g, retrieval.match_entities(g, index.limit(0), nothing)), nothing).first().answer == retrieval.NO_ANSWER
    assert len(v.select(retrieval.embed(F.col("name"))).first()[0]) == retrieval.DIMENSIONS


def test_thread_selection(spark):
    sizes = {"a": 5, "b": 16, "c": 4, "d": 7, "e": 5}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, f"id{k}", "x@y", ["z@y"], f"Re: {s}", f"2001-01-{k:03d}", "body", f"p{k:03d}"))
            k += 1
    mail = spark.createDataFrame(rows, "ord bigint, message_id string, sender string, `to` array<string>, subject string, timestamp string, body string, filepath string")
    got = {r.issue_id: r for r in threads.select_threads(threads.first_by_id(mail)).collect()}
    assert {i: r.title for i, r in got.items()} == {1: "Re: d", 2: "Re: a", 3: "Re: e"} and got[1].comments[0].is_issue_body and len(got[1].comments) == 7


RAW = b"Message-ID: <1@x>\r\nFrom: a@x\r\nTo: b@x, c@x\r\nSubject: Hi\r\nDate: Sat, 05 Jan 2002 16:24:12 +0100\r\n\r\nHello\r\n"


def test_mail_sources(spark, tmp_path):
    m = parse_message(RAW, "p")
    assert (m["message_id"], m["to"], m["timestamp"], m["body"].strip()) == ("1@x", ["b@x", "c@x"], "2002-01-05T16:24:12+01:00", "Hello")
    assert parse_message(b"From: a@x\n\n  \n", "p") is None
    folder = tmp_path / "maildir" / "doe-j" / "inbox"
    folder.mkdir(parents=True)
    (folder / "1").write_bytes(RAW)
    assert read_maildir(spark, str(tmp_path / "maildir"), folders=["inbox"]).count() == 1
    import tarfile

    with tarfile.open(tmp_path / "m.tar", "w") as tar:
        tar.add(folder / "1", "maildir/doe-j/inbox/1")
        tar.add(folder / "1", "maildir/roe-k/inbox/1")
    assert [r.filepath for r in read_archive(spark, str(tmp_path / "m.tar"), ["doe-j/"]).collect()] == ["doe-j/inbox/1"]
    with tarfile.open(tmp_path / "n.tar.gz", "w:gz") as tar:
        for name in ("maildir/doe-j/inbox/2", "maildir/../doe-j/3", "/doe-j/4"):
            info = tarfile.TarInfo(name)  # add() would make an absolute name relative
            info.size = len(RAW)
            tar.addfile(info, io.BytesIO(RAW))
    both = [str(tmp_path / "m.tar"), str(tmp_path / "n.tar.gz")]
    assert sorted(r.filepath for r in read_archive(spark, both, ["doe-j/"]).collect()) == ["doe-j/inbox/1", "doe-j/inbox/2"]


def test_nearest_rows_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)  # rounded, so that there are ties
    index = spark.createDataFrame([(f"e{k % 50:03d}", k // 50, [float(z) for z in v]) for k, v in enumerate(x)], "entity_id string, spos int, vec array<double>").repartition(3)
    q = spark.createDataFrame([(k, [float(z) for z in x[k]]) for k in range(7)], "qid bigint, qvec array<double>")
    got = {}
    for r in retrieval.vector_topk(index, q, 9).collect():
        got.setdefault(r.qid, set()).add((r.entity_id, r.spos))
    for k in range(7):
        rows = sorted((-float(x[j] @ x[k]), f"e{j % 50:03d}", j // 50) for j in range(300))
        assert {s for s, *_ in [(round(-r[0], 9), r) for r in rows[:9]]} and len(got[k]) == 9
        least = -rows[8][0]
        assert all(float(x[int(e[1:]) + 50 * s] @ x[k]) >= least - 1e-9 for e, s in got[k])
    few = retrieval.MAX_QUERIES
    try:
        retrieval.MAX_QUERIES = 2
        assert {(r.qid, r.entity_id, r.spos) for r in retrieval.vector_topk(index, q, 9).collect() if r.qid == 3}.__len__() == 9
    finally:
        retrieval.MAX_QUERIES = few
    assert retrieval.vector_topk(index.limit(0), q, 9).count() == 0 == retrieval.vector_topk(index, q.limit(0), 9).count()


def test_keywords_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    names = [(k, f"e{k}", f"{word()} {word().upper()}", "Topic", rng.choice([None, [], [word(), None]]), None) for k in range(80)] + [(99, "e99", None, "Topic", None, None)]
    asked = [(k, " ".join(word() for _ in range(3))) for k in range(20)] + [(77, None)]
    got = {(r.qid, r.entity_id) for r in retrieval.keyword_match(spark.createDataFrame(names, ENTITIES), spark.createDataFrame(asked, "qid int, question string")).collect()}
    want = {(q, i) for q, text in asked if text for _, i, n, _, a, _ in names for w in text.split() if len(w) >= 3 and any(s and w in s.lower() for s in [n, *(a or [])])}
    assert got == want


def test_store_and_graph_on_disk(spark, tmp_path):
    from lorespan.sources import store as stores

    e, c = small_graph(spark)
    g = graph.ingest(e, c)[0]
    stores.save_graph(g, str(tmp_path / "g"))
    assert stores.copy_outputs(spark, str(tmp_path / "g"), str(tmp_path / "o"), ["vertices", "edges", "counters", "none"]) == ["vertices", "edges", "counters"]
    again, counters = graph.ingest(e, c, stores.load_graph(spark, str(tmp_path / "o")))
    assert counters.first().total_claims_ingested == 0 and again.counters.first().total_claims_ingested == 2
    unique = dedup.dedup_claims(c)
    store = Store(e, unique.select(*c.columns), dedup.claim_merges(c, unique, "t"), "v2", "mail")
    for form in ("parquet", "json"):
        stores.save_store(store, str(tmp_path / form), form=form)
        back = stores.load_store(spark, str(tmp_path / form), form=form)
        assert (back.extraction_version, back.corpus_source) == ("v2", "mail") and back.claims.count() == unique.count()
        assert dedup.undo_merge(back, back.merge_log.records.first().merge_id).claims.count() == unique.count() + 1
    stores.save_store(Store(e, c), str(tmp_path / "json"), form="json")
    assert stores.load_store(spark, str(tmp_path / "json"), form="json").merge_log is None
    assert graph.log_lines(store.merge_log).first().line == "CLAIM merge: 2 items → 1"
    assert graph.claim_lines(g.vertices, g.edges.where("id = '1'")).first().line == "a → mentions → b (confidence: 0.90, Current)"


def test_a_corpus_needs_messages(spark):
    assert threads.enough(spark.range(60)).count() == 60
    with pytest.raises(ValueError):
        threads.enough(spark.range(49))


def test_claims_of_entities_and_late_facts(spark, tmp_path):
    from lorespan.streaming.ingest import current_claims, current_claims_of, ingest_claims

    c = [(k, f"c{k}", "u", "approved", o, [], 0.9, at, None, True, "v1") for k, o, at in [(1, "p", "2001"), (2, "q", "2003")]]
    ids = spark.createDataFrame([("u",), ("p",)], "id string")
    assert sorted((r.entity_id, r.id) for r in graph.claims_of_entities(spark.createDataFrame(c, CLAIMS), ids).collect()) == [("p", "c1"), ("u", "c1"), ("u", "c2")]
    at = {k: str(tmp_path / k) for k in ("in", "store", "checkpoint")}
    spark.createDataFrame(c, CLAIMS).write.json(at["in"])
    ingest_claims(spark, at["in"], at["store"], at["checkpoint"]).awaitTermination()
    late = spark.createDataFrame([(3, "c3", "u", "approved", "r", [], 0.9, "2002", None, True, "v1")], CLAIMS)
    late.write.mode("append").json(at["in"])
    ingest_claims(spark, at["in"], at["store"], at["checkpoint"]).awaitTermination()
    want = {"c1": "2002", "c3": "2003", "c2": None}
    assert {r.id: r.valid_until for r in current_claims(spark, at["store"]).collect()} == want == {r.id: r.valid_until for r in current_claims_of(spark, at["store"], late).collect()}


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    from lorespan.streaming import ingest

    at = {k: str(tmp_path / k) for k in ("in", "store", "checkpoint")}
    spark.createDataFrame([(1, "c1", "u", "mentions", "p", [], 0.9, None, None, True, "v1")], CLAIMS).write.json(at["in"])
    real, failed = ingest.F.pmod, []

    def once(*a):
        if not failed:
            failed.append(1)
            raise RuntimeError("lost")
        return real(*a)

    monkeypatch.setattr(ingest.F, "pmod", once)
    with pytest.raises(Exception):
        ingest.ingest_claims(spark, at["in"], at["store"], at["checkpoint"]).awaitTermination()
    ingest.ingest_claims(spark, at["in"], at["store"], at["checkpoint"]).awaitTermination()
    assert [r.id for r in ingest.current_claims(spark, at["store"]).collect()] == ["c1"]


def _broadcast_rows(df, holding):
    """Rows of the largest broadcast that holds a column, as it ran."""
    df.collect()
    at, most = [df._jdf.queryExecution().executedPlan()], 0
    while at:
        p = at.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            at.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            at.append(p.plan())
        elif p.getClass().getSimpleName() == "BroadcastExchangeExec" and holding in p.output().mkString(" "):
            most = max(most, p.metrics().apply("numOutputRows").value())
        at += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_keywords_keep_names_out_of_broadcasts(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id as ord", "concat('e', id) as id", "concat('Gas ', md5(string(id))) as name", "'Topic' as entity_type", "cast(null as array<string>) as aliases", "'' as first_seen").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    q = spark.createDataFrame([(k, f"what gas {k}gas what") for k in range(3)], "qid int, question string")
    for most in (retrieval.MAX_WORDS, 2):  # words sent to all tasks, words joined by sorting
        monkeypatch.setattr(retrieval, "MAX_WORDS", most)
        df = retrieval.keyword_match(v, q)
        assert df.count() == df.distinct().count() == 6000
        assert _broadcast_rows(df, "surface") == 0 == _broadcast_rows(df, "found")


def test_blend_against_all_pairs(spark, monkeypatch):
    from lorespan.schema import Settings

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(2, 4)))
    v = spark.createDataFrame([(k, f"e{k:02d}", f"{word()} {word()}", "Topic", rng.choice([None, [word()]]), None) for k in range(60)], ENTITIES)
    index = spark.createDataFrame([(f"e{k:02d}", s, [rng.random(), rng.random()]) for k in range(60) for s in (0, 1)], "entity_id string, spos int, vec array<double>")
    q = spark.createDataFrame([(k, f"{word()} {word()}", [rng.random() - 0.5, rng.random() - 0.5] if k else None) for k in range(12)], "qid int, question string, qvec array<double>")
    settings = Settings(index_rows=4, top_entities=3)
    sims, want = {}, set()
    for r in retrieval.vector_topk(index, q, 4).collect():
        sims[r.qid, r.entity_id] = max(r.sim, sims.get((r.qid, r.entity_id), r.sim))
    hits = {(r.qid, r.entity_id) for r in retrieval.keyword_match(v, q).collect()}
    for k in range(12):
        scores = {e: sims.get((k, e), 0.3) + 0.3 * ((k, e) in hits) for x, e in {*sims, *hits} if x == k}
        want |= {(k, e, round(scores[e], 9), n + 1) for n, e in enumerate(sorted(scores, key=lambda e: (-scores[e], e))[:3])}
    for most in (retrieval.MAX_WORDS, 2):
        monkeypatch.setattr(retrieval, "MAX_WORDS", most)
        m = retrieval.match_entities(graph.Graph(v, None), index, q, settings)
        assert {(r.qid, r.entity_id, round(r.score, 9), r.rank) for r in m.collect()} == want


def test_matching_keeps_names_out_of_broadcasts(spark, tmp_path):
    spark.range(2000).selectExpr("id as ord", "concat('e', id) as id", "concat('Gas ', md5(string(id))) as name", "'Topic' as entity_type", "cast(null as array<string>) as aliases", "'' as first_seen").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    index = spark.createDataFrame([("e7", 0, [0.8, 0.6])], "entity_id string, spos int, vec array<double>")
    q = spark.createDataFrame([(0, "what gas", [1.0, 0.0])], "qid int, question string, qvec array<double>")
    m = retrieval.match_entities(graph.Graph(v, None), index, q)
    assert [r.entity_id for r in m.orderBy("rank").collect()] == ["e7", "e0", "e1", "e10", "e100"]
    assert _broadcast_rows(m, "surface") == 0 == _broadcast_rows(m, "found")
