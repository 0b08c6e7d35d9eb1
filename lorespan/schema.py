"""Types of the store, the corpus and the graph, and the engine's settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "struct<source_id:string,exact_quote:string,char_offset_start:int,char_offset_end:int,timestamp:string,author:string>"
COMMENT = "struct<comment_id:string,author:string,timestamp:string,text:string,is_issue_body:boolean>"
EMAILS = "message_id string, sender string, `to` array<string>, cc array<string>, subject string, timestamp string, body string, in_reply_to string, `references` string, filepath string"
THREADS = f"issue_id int, title string, state string, author string, created_at string, closed_at string, labels array<string>, url string, comments array<{COMMENT}>"
ENTITIES = "ord bigint, id string, name string, entity_type string, aliases array<string>, first_seen string"
CLAIMS = f"ord bigint, id string, subject_id string, relation string, object_id string, evidence array<{EVIDENCE}>, confidence double, valid_from string, valid_until string, is_current boolean, extraction_version string"
MERGE_RECORDS = "merge_id string, merge_type string, target_id string, target_ord bigint, n bigint, reason string, timestamp string"
MERGE_MEMBERS = "merge_id string, place string, ord bigint, id string, snapshot string"

# The closed sets of entity types and relations, and the relations that hold one value at a time.
ENTITY_TYPES = ["User", "Component", "Bug", "Feature", "Issue", "Label", "Decision", "Concept", "Organization", "Topic", "Project"]
RELATIONS = [
    "created", "reported", "fixed", "broke", "depends_on", "mentions", "decided", "assigned_to", "labeled", "status_changed", "duplicate_of",
    "related_to", "caused_by", "blocked_by", "implements", "reverted", "sent_to", "forwarded_to", "discussed", "approved", "escalated_to",
]
SINGLE_VALUED = ["status_changed", "assigned_to", "labeled", "approved"]


def names_of(schema: str) -> list[str]:
    """Column names of a flat schema text."""
    return [c.split()[0].strip("`") for c in schema.split(", ")]


def clean_claims(claims: DataFrame) -> DataFrame:
    """Claims as every operator takes them: a confidence that is not a number is none."""
    return claims.withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits; each is a feature of an operator, none is there to save work."""

    similarity: float = 0.90
    min_confidence: float = 0.5
    default_confidence: float = 0.7
    min_text: int = 20
    prompt_chars: int = 3000
    thread_sizes: tuple[int, int] = (5, 15)
    threads: int = 12
    index_rows: int = 15
    top_entities: int = 5
    top_claims: int = 10
    keyword_boost: float = 0.3
    keyword_base: float = 0.3
    max_nodes: int = 200
    version: str = "v1"


@dataclass
class MergeLog:
    """What was merged: one row per merge, and one row per member with its snapshot (members stand in the order of place, ord)."""

    records: DataFrame
    members: DataFrame

    def union(self, other: MergeLog) -> MergeLog:
        return MergeLog(self.records.unionByName(other.records), self.members.unionByName(other.members))


@dataclass
class Store:
    """Entities, claims and the merge log; ``ord`` carries the order of first insertion."""

    entities: DataFrame
    claims: DataFrame
    merge_log: MergeLog | None = None
    extraction_version: str = "v1"
    corpus_source: str = ""
    settings: Settings = field(default_factory=Settings)
