"""Model answers turned into entities and claims.

The extractor is pluggable: any function from a batch of prompts to answers.
The default is a deterministic rule, which does not reach a model's quality.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.schema import ENTITY_TYPES, EVIDENCE, RELATIONS, Settings

Extractor = Callable[[list[str]], list[str]]
ENTITY = "struct<id:string,name:string,entity_type:string,aliases:array<string>,first_seen:string>"
CLAIM = f"struct<id:string,subject_id:string,relation:string,object_id:string,evidence:array<{EVIDENCE}>,confidence:double,valid_from:string,valid_until:string,is_current:boolean,extraction_version:string>"


def repair_json(text: str | None) -> dict:
    """The answer as an object: without code fences, else between the outermost braces, else empty."""
    bare = re.sub(r"\s*(?:```\s*)+$", "", re.sub(r"^```(?:json)?\s*", "", (text or "").strip()))
    spans = [bare]
    if "{" in bare and "}" in bare:
        spans.append(bare[bare.index("{") : bare.rindex("}") + 1])
    for span in spans:
        try:
            value = json.loads(span)
        except ValueError:
            continue
        return value if isinstance(value, dict) else {}
    return {}


def _short(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]


def _entity(raw: dict, thread: int, timestamp: str) -> dict | None:
    name = raw.get("name", "unknown")
    if not isinstance(raw, dict) or not isinstance(name, str):
        return None
    kind = raw.get("entity_type")
    aliases = raw.get("aliases") or []
    if not isinstance(aliases, list) or not all(isinstance(a, str) for a in aliases):
        return None
    return {"id": f"ent_{thread}_{raw.get('id', _short(name))}", "name": name.strip(), "entity_type": kind if kind in ENTITY_TYPES else "Concept", "aliases": aliases, "first_seen": timestamp}


def _claim(raw: dict, thread: int, source_id: str, timestamp: str, author: str | None, settings: Settings) -> dict | None:
    relation = raw.get("relation")
    relation = relation if relation in RELATIONS else "related_to"
    evidence = []
    for e in raw.get("evidence") or []:
        one = {"source_id": e.get("source_id", source_id), "exact_quote": e.get("exact_quote", ""), "char_offset_start": e.get("char_offset_start"), "char_offset_end": e.get("char_offset_end"), "timestamp": e.get("timestamp", timestamp), "author": e.get("author", author)}
        if any(not isinstance(one[k], str) for k in ("source_id", "exact_quote", "timestamp")):
            return None
        evidence.append(one)
    confidence = float(raw.get("confidence", settings.default_confidence))
    if not evidence or not 0 <= confidence <= 1 or confidence < settings.min_confidence:
        return None
    subject, object_ = raw.get("subject_id", ""), raw.get("object_id", "")
    return {
        "id": f"clm_{thread}_{raw.get('id', _short(f'{subject}_{relation}_{object_}'))}", "subject_id": f"ent_{thread}_{subject}", "relation": relation, "object_id": f"ent_{thread}_{object_}",
        "evidence": evidence, "confidence": confidence, "valid_from": timestamp, "valid_until": None, "is_current": True, "extraction_version": settings.version,
    }


def validate(answer: str | None, thread: int, source_id: str, timestamp: str, author: str | None, settings: Settings = Settings()) -> tuple[list[dict], list[dict]]:
    """Valid entities and claims of one answer; a record that fails is left out, the others stay."""
    raw = repair_json(answer)
    out: tuple[list[dict], list[dict]] = ([], [])
    for kind, place in (("entities", 0), ("claims", 1)):
        records = raw.get(kind)
        for record in records if isinstance(records, list) else []:
            try:
                built = _entity(record, thread, timestamp) if place == 0 else _claim(record, thread, source_id, timestamp, author, settings)
            except (AttributeError, TypeError, ValueError):
                continue
            if built:
                out[place].append(built)
    return out


def build_records(answers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(thread, pos, entities, claims) of answers (thread, pos, source_id, timestamp, author, answer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            built = [validate(a, t, s, ts, au, settings) for a, t, s, ts, au in zip(b["answer"], b["thread"], b["source_id"], b["timestamp"], b["author"])]
            yield pd.DataFrame({"thread": b["thread"], "pos": b["pos"], "entities": [x for x, _ in built], "claims": [y for _, y in built]})

    return answers.mapInPandas(run, f"thread int, pos int, entities array<{ENTITY}>, claims array<{CLAIM}>")


def rule_extractor(prompts: list[str]) -> list[str]:
    """Offline default: names written with two capitalised words become entities that are mentioned by the author."""
    answers = []
    for p in prompts:
        body = p.split("\n", 4)[-1]
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", body)))
        author = (re.search(r"^Author: (.*)$", p, re.M) or [None, "unknown"])[1]
        entities = [{"id": "a", "name": author or "unknown", "entity_type": "User"}] + [{"id": f"e{k}", "name": n, "entity_type": "Concept"} for k, n in enumerate(names)]
        claims = [{"id": f"c{k}", "subject_id": "a", "relation": "mentions", "object_id": f"e{k}", "evidence": [{"exact_quote": n}], "confidence": 0.7} for k, n in enumerate(names)]
        answers.append(json.dumps({"entities": entities, "claims": claims}))
    return answers


def extract(prompts: DataFrame, extractor: Extractor = rule_extractor, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """Adds ``answer`` to prompts (thread, pos, source_id, timestamp, author, prompt).

    Every prompt is a call of its own: one that fails is tried again ``retries`` times, ``pause`` seconds apart, and then
    answered by an empty object; its neighbours are not concerned.  A bad answer is not tried again.
    """
    schema = prompts.drop("prompt").schema.add("answer", "string")

    def ask(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return extractor([prompt])[0]
            except Exception:  # noqa: BLE001 - any failure of a model service
                if attempt < retries:
                    time.sleep(pause)
        return "{}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="prompt").assign(answer=[ask(p) for p in b["prompt"]])

    return prompts.mapInPandas(run, schema)


def upsert(records: DataFrame, key: str, seq: str) -> DataFrame:
    """Last record of each key, with ``ord`` = sequence of its first."""
    others = [c for c in records.columns if c != key]
    last = records.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("r"), F.min(seq).alias("ord"))
    return last.select(key, *[F.col(f"r.{c}") for c in others if c != "ord"], "ord")


def pending(threads: DataFrame, completed: DataFrame, key: str = "issue_id") -> DataFrame:
    """Threads that are not completed yet."""
    return threads.join(completed.select(key).distinct(), key, "left_anti")
