"""Mail folders and archives as DataFrames."""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator
from email import message_from_string, policy
from email.utils import parsedate_to_datetime

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.schema import EMAILS, names_of

# The folders of a mailbox that are read.
FOLDERS = ["sent_items", "sent", "inbox", "all_documents", "_sent_mail"]


def parse_message(raw: bytes, path: str) -> dict | None:
    """One message as a record; None if its text is blank.  The first plain text part counts."""
    m = message_from_string(raw.decode("utf-8", "replace"), policy=policy.compat32)
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain" and p.get_payload()), None) if m.is_multipart() else m
    payload = part.get_payload(decode=True) if part is not None else None
    body = payload.decode("utf-8", "replace") if payload else ""
    if not body.strip():
        return None
    head = {k: str(m.get(k) or "") for k in ("Message-ID", "From", "To", "Cc", "Subject", "Date", "In-Reply-To", "References")}
    subject = head["Subject"] or "(no subject)"
    try:
        stamp = parsedate_to_datetime(head["Date"]).isoformat()
    except (ValueError, TypeError):
        stamp = head["Date"]
    addresses = lambda s: [a.strip() for a in s.split(",") if "@" in a]
    digest = hashlib.md5((head["From"] + head["Date"] + subject).encode()).hexdigest()[:12]
    return {
        "message_id": head["Message-ID"].strip("<> ") or digest, "sender": head["From"], "to": addresses(head["To"]), "cc": addresses(head["Cc"]), "subject": subject, "timestamp": stamp,
        "body": body, "in_reply_to": head["In-Reply-To"], "references": head["References"], "filepath": path,
    }


def _records(parsed: Iterator[dict | None]) -> pd.DataFrame:
    return pd.DataFrame([r for r in parsed if r], columns=names_of(EMAILS))


def read_maildir(spark: SparkSession, root: str, users: list[str] | None = None, folders: list[str] = FOLDERS) -> DataFrame:
    """Messages of ``root/user/folder/file``; only the given users and folders are listed."""
    paths = [f"{root}/{u}/{f}/*" for u in (users or ["*"]) for f in folders]
    return parse_files(spark.read.format("binaryFile").load(paths))


def parse_files(files: DataFrame) -> DataFrame:
    """Messages of files (path, content); files without text give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _records(parse_message(c, p) for c, p in zip(b["content"], b["path"]))

    return files.select("path", "content").mapInPandas(run, EMAILS)


def read_archive(spark: SparkSession, paths: str | list[str], prefixes: list[str]) -> DataFrame:
    """Messages of tar archives whose members lie below the given prefixes; unsafe member names are skipped.

    One task reads one archive as a stream, compressed or not: no more than a batch of messages is in memory.
    """
    names = spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "path string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                source, inside = FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with source.open_input_stream(inside, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                    parsed = []
                    for member in tar:
                        name = member.name.removeprefix("maildir/")
                        if member.isfile() and not name.startswith("/") and ".." not in name.split("/") and any(name.startswith(p) for p in prefixes):
                            parsed.append(parse_message(tar.extractfile(member).read(), name))
                            if len(parsed) == 1000:
                                yield _records(iter(parsed))
                                parsed = []
                    yield _records(iter(parsed))

    return names.repartition("path").mapInPandas(run, EMAILS)


def with_order(mail: DataFrame) -> DataFrame:
    """Adds ``ord``, a number that follows the path; unique, not dense."""
    return mail.repartitionByRange("filepath").sortWithinPartitions("filepath").withColumn("ord", F.monotonically_increasing_id())
