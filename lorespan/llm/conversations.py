"""Conversations rebuilt from message rows.

Every message answers at most one other, so the reply links form trees and
circles.  Large-star and small-star joins find what belongs together without
identifiers of the conversations; a component is a conversation exactly if it
holds an opener (a broken message or a circle leaves it without one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions.text import address_of, is_blank, norm_id, strip
from lorespan.llm.quoted import quoted_messages
from lorespan.operators.components import connected_components
from lorespan.operators.ranking import number_within
from lorespan.operators.redelivery import redelivered
from lorespan.operators.timestamps import US, normalize_timestamps
from lorespan.session import stash

# Marks of replies and forwarded mail by language and mailer.
MARKS = [
    "re", "ré", "aw", "antw", "antwort", "sv", "svar", "vs", "vb", "vl", "fw", "fwd", "wg", "tr", "rv", "enc", "rif", "res", "resp", "ref", "r", "i", "odp", "pd", "ynt", "ilt", "bls", "trs", "doorst", "vá", "továbbítás",
    "回复", "回覆", "答复", "答覆", "转发", "轉寄", "轉發", "返信", "転送", "ответ", "отв", "ha", "пересл", "fwd", "απ", "πρθ", "σχετ", "رد", "إعادة توجيه", "답장", "회신", "전달", "ตอบกลับ", "ส่งต่อ", "השב", "הועבר", "उत्तर",
]
MARK = r"(?iU)^(?:\s*\[?\s*(?:" + "|".join(dict.fromkeys(MARKS)) + r")\s*(?:\[\d+\]|\(\d+\)|\*?\^?\d+)?\s*[:：]\s*)+"
TAIL_MARK = r"(?iU)\s*\((?:fwd|fw|re)\)\s*\]?$"


def bare_subject(subject: Column) -> Column:
    """Subject without marks of reply or forwarding, in lower case, with single blanks."""
    text = F.regexp_replace(F.regexp_replace(subject, MARK, ""), TAIL_MARK, "")
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def has_mark(subject: Column) -> Column:
    return F.coalesce(F.regexp_like(subject, F.lit(MARK + ".*")) | F.regexp_like(subject, F.lit("(?s).*" + TAIL_MARK.replace("(?iU)", "(?iU)"))), F.lit(False))


def named_ids(text: Column) -> Column:
    """Message ids in a header: those in angle brackets, else every word with an at sign, else the only word."""
    inside = F.regexp_extract_all(text, F.lit(r"<\s*([^<>\s]+)\s*>"), 1)
    words = F.regexp_extract_all(text, F.lit(r"([^\s<>,;\"']+@[^\s<>,;\"']+)"), 1)
    single = F.when(F.regexp_like(strip(text), F.lit(r"^[^\s]+$")), F.array(strip(text))).otherwise(F.array().cast("array<string>"))
    ids = F.when(F.size(inside) > 0, inside).when(F.size(words) > 0, words).otherwise(single)
    return F.coalesce(F.filter(F.transform(ids, norm_id), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(ord, parent): which first copy each message answers; ``messages`` has ord, id, in_reply_to, references, subject."""
    m = messages.select("ord", "id", named_ids(F.col("in_reply_to")).alias("direct"), named_ids(F.col("references")).alias("refs"), has_mark(F.col("subject")).alias("mark"), bare_subject(F.col("subject")).alias("bare"))
    wanted = m.select(F.col("ord"), F.posexplode(F.concat("direct", F.reverse("refs"))).alias("rank", "id"))
    targets = m.where("id is not null").select("id", F.col("ord").alias("parent"))
    by_id = wanted.join(targets, "id").groupBy("ord").agg(F.min_by("parent", "rank").alias("parent"))
    silent = m.where((F.size("direct") == 0) & (F.size("refs") == 0))
    openers = silent.where("not mark and bare != ''").groupBy("bare").agg(F.min("ord").alias("parent"), F.count(F.lit(1)).alias("n")).where("n = 1")
    by_subject = silent.where("mark").join(openers, "bare").select("ord", "parent")
    return by_id.union(by_subject)


def quote_links(messages: DataFrame, mail: DataFrame, links: DataFrame) -> DataFrame:
    """(ord, parent): what a marked message without ids quotes, if neither ids nor the subject say what it answers."""
    silent = messages.where((F.size(named_ids(F.col("in_reply_to"))) == 0) & (F.size(named_ids(F.col("references"))) == 0) & has_mark(F.col("subject")))
    lost = silent.select("ord").join(links.select("ord"), "ord", "left_anti")
    bodies = mail.join(messages.select("ord"), "ord", "left_semi").where(~is_blank(F.col("body")))
    texts = bodies.select(F.lit("mail").alias("src"), F.col("ord").cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("pos"), "sender", "body")
    return quoted_messages(texts).select(F.shiftright("mid", 1).alias("ord"), F.shiftright("parent", 1).alias("parent")).join(lost, "ord", "left_semi").where("ord != parent")


def conversations(mail: DataFrame, mailboxes: DataFrame, quotes: bool = False) -> DataFrame:
    """(conv_id, pos, message_id, role) of every kept conversation.

    With ``quotes`` a message that ids and subject leave unplaced answers the message whose text it quotes.

    Only first copies count.  A message answers the message named by
    ``in_reply_to``, else the last of ``references`` that is present, else (no
    id named, marked subject) the only opener of the same bare subject.
    Conversations with a broken link, a circle, a blank body, an unreadable
    time or a single sender are left out.  Nulls in any column are allowed: a
    message without an identifier takes part but cannot be named; equal times
    are ordered by ``ord``.  An empty table gives an empty result.
    """
    path = F.filter(F.split("filepath", "/"), lambda x: x != "")
    rows = mail.select(
        "ord", norm_id(F.col("message_id")).alias("id"), "in_reply_to", "references", "subject", "timestamp",
        address_of(F.col("sender")).alias("address"), is_blank(F.col("body")).alias("blank"), F.get(F.reverse(path), F.lit(2)).alias("mailbox"),
    )
    rows = rows.join(redelivered(mail), "ord", "left_anti")
    homes = mailboxes.select("mailbox", "zone", "date_order").dropna(subset=["mailbox"]).dropDuplicates(["mailbox"])
    timed = normalize_timestamps(rows.join(homes, "mailbox", "left"), "timestamp", "zone", "date_order")
    messages = stash(timed.select("ord", "id", "in_reply_to", "references", "subject", "address", "blank", "epoch_us"), "messages")

    links = stash(reply_links(messages), "links")
    if quotes:
        links = stash(links.union(quote_links(messages, mail, links)), "quote_links")
    parts = connected_components(links, "ord", "parent")
    facts = messages.select("ord", "id", "address", "blank", "epoch_us").join(parts.withColumnRenamed("node", "ord"), "ord")
    facts = facts.join(links.select("ord", F.lit(True).alias("answers")), "ord", "left")
    opens = messages.where((F.size(named_ids(F.col("in_reply_to"))) == 0) & (F.size(named_ids(F.col("references"))) == 0) & ~has_mark(F.col("subject"))).select("ord", F.lit(True).alias("opener"))
    facts = stash(facts.join(opens, "ord", "left"), "facts")
    kept = facts.groupBy("component").agg(
        F.max_by(F.col("id"), F.when(F.col("opener"), 1)).alias("conv_id"), F.max_by(F.col("address"), F.when(F.col("opener"), 1)).alias("opener_address"),
        F.count_if(F.col("opener")).alias("openers"), F.count_if(F.col("blank")).alias("blanks"), F.count_if(F.col("epoch_us").isNull()).alias("untimed"),
        F.min("address").alias("a"), F.max("address").alias("z"),
    )
    kept = kept.where("openers = 1 and blanks = 0 and untimed = 0 and a != z").select("component", "conv_id", "opener_address")
    placed = facts.join(kept, "component")
    minute = F.floor(F.col("epoch_us") / (60 * US))
    ranked = number_within(placed, ["component"], minute, [F.col("epoch_us"), F.col("ord")], "pos")
    role = F.when(F.col("address") == F.col("opener_address"), "opener").otherwise("replier")
    return ranked.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("id").alias("message_id"), role.alias("role"))
