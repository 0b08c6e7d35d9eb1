"""Column expressions for text, identifiers and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove surrounding white space of any script (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def norm_id(c: Column) -> Column:
    """Message id without surrounding blanks and angle brackets, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^[\s<>]+|[\s<>]+$", "")), F.lit(""))


def address_of(c: Column) -> Column:
    """Bare address of a sender such as ``"Last, First" <a@b>``, in lower case."""
    inside = F.regexp_extract(c, r"<([^<>]*)>[^<>]*$", 1)
    return F.lower(strip(F.when(inside != "", inside).otherwise(c)))


def normalize_subject(c: Column) -> Column:
    """Subject without up to three leading reply or forward prefixes, trimmed, in lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), r"(?i)^(?:(?:re|fwd|fw):\s*){1,3}", "")))


def split_addresses(c: Column) -> Column:
    """Pieces between commas that contain an at sign, trimmed."""
    return F.filter(F.transform(F.split(c, ","), lambda x: strip(x)), lambda x: F.contains(x, F.lit("@")))


def default_message_id(message_id: Column, sender: Column, date: Column, subject: Column) -> Column:
    """Id without brackets and blanks around it; without one, a digest of sender, date and subject."""
    bare = F.regexp_replace(F.coalesce(message_id, F.lit("")), "^[<> ]+|[<> ]+$", "")
    digest = F.substring(F.md5(F.concat(*[F.coalesce(x, F.lit("")) for x in (sender, date, subject)])), 1, 12)
    return F.when(bare != "", bare).otherwise(digest)


def clean_artifact(c: Column) -> Column:
    """Text without quoted lines, forwarded or original parts and signature, with single blanks."""
    c = F.regexp_replace(c, r"(?dm)^>+.*$", "")
    c = F.regexp_replace(c, rf"(?isU)-{{2,}}{WS}*Original Message{WS}*-{{2,}}.*", "")
    c = F.regexp_replace(c, rf"(?isU)-{{2,}}{WS}*Forwarded by.*", "")
    c = F.regexp_replace(c, rf"(?sU)\n--{WS}*\n.*", "")
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def evidence_id(source_id: Column, quote: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(source_id, F.lit("")), F.lit(":"), F.substring(F.coalesce(quote, F.lit("")), 1, 100)), 256), 1, 16)


def canonical_key(entity_type: Column, name: Column) -> Column:
    return F.concat_ws("::", entity_type, F.lower(strip(name)))


def extraction_prompt(title: Column, source_id: Column, author: Column, timestamp: Column, text: Column, limit: int) -> Column:
    """What an extractor is given of one message; longer texts are cut at ``limit`` characters."""
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("... [truncated]"))).otherwise(text)
    return F.concat_ws("\n", *[F.concat(F.lit(k), F.coalesce(v, F.lit(""))) for k, v in (("Thread: ", title), ("Source: ", source_id), ("Author: ", author), ("Time: ", timestamp), ("", cut))])
