"""Mail grouped into threads, and the selection of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.functions.text import default_message_id, is_blank, normalize_subject, strip
from lorespan.operators.ranking import number_within, text_slice
from lorespan.schema import Settings


def first_by_id(mail: DataFrame) -> DataFrame:
    """One mail per message id, the first by path (ties by ``ord``), without blank bodies; adds ``mid``."""
    mid = default_message_id(F.col("message_id"), F.col("sender"), F.col("timestamp"), F.col("subject"))
    kept = mail.where(~is_blank(F.col("body"))).withColumn("mid", mid)
    first = kept.groupBy("mid").agg(F.min_by("ord", F.struct("filepath", "ord")).alias("ord"))
    return kept.join(first, ["mid", "ord"])


def enough(mail: DataFrame, least: int = 50) -> DataFrame:
    """The same mail; ``ValueError`` if it has fewer messages than a corpus needs."""
    if (n := mail.limit(least).count()) < least:
        raise ValueError(f"only {n} messages, {least} are needed")
    return mail


def long_enough(messages: DataFrame, text: str, settings: Settings = Settings()) -> DataFrame:
    """Messages whose text is worth an extraction."""
    return messages.where(F.length(strip(F.col(text))) >= settings.min_text)


def group_threads(mail: DataFrame) -> DataFrame:
    """Mail with ``norm`` (its thread), ``pos`` by timestamp text and ``is_issue_body`` of the first message."""
    subject = F.coalesce(F.col("subject"), F.lit("(no subject)"))
    norm = mail.withColumn("norm", normalize_subject(subject)).where("norm != ''")
    order = [F.coalesce("timestamp", F.lit("")), F.col("ord")]
    numbered = number_within(norm, ["norm"], text_slice(F.col("timestamp"), F.col("ord")), order, "pos")
    return numbered.withColumn("is_issue_body", F.col("pos") == 1)


def select_threads(mail: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The longest threads of allowed size as issues with their comments in order."""
    norm = mail.withColumn("norm", normalize_subject(F.coalesce(F.col("subject"), F.lit("(no subject)")))).where("norm != ''")
    low, high = settings.thread_sizes
    sizes = norm.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")).where(F.col("n").between(low, high))
    best = sizes.orderBy(F.desc("n"), "first_ord").limit(settings.threads)
    ranked = best.withColumn("issue_id", F.row_number().over(Window.orderBy(F.desc("n"), "first_ord")))
    rows = norm.join(F.broadcast(ranked), "norm")
    ts = F.coalesce("timestamp", F.lit(""))
    comment = F.struct(ts.alias("at"), F.col("ord"), F.substring("mid", 1, 32).alias("comment_id"), F.col("sender").alias("author"), F.col("timestamp"), F.col("body").alias("text"), F.col("subject"), F.col("to"))
    grouped = rows.groupBy("issue_id").agg(F.sort_array(F.collect_list(comment)).alias("c"), F.min(F.nullif(F.col("timestamp"), F.lit(""))).alias("created_at"), F.max(F.nullif(F.col("timestamp"), F.lit(""))).alias("closed_at"))
    comments = F.transform("c", lambda x, i: F.struct(x.comment_id.alias("comment_id"), x.author.alias("author"), x.timestamp.alias("timestamp"), x.text.alias("text"), (i == 0).alias("is_issue_body")))
    people = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda x: F.concat(F.array(x.author), F.coalesce(x.to, F.array().cast("array<string>")))))))
    return grouped.select(
        F.col("issue_id").cast("int").alias("issue_id"), F.get("c", F.lit(0)).subject.alias("title"), F.lit("closed").alias("state"), F.get("c", F.lit(0)).author.alias("author"), "created_at", "closed_at",
        F.array().cast("array<string>").alias("labels"), F.concat(F.lit("mail://thread/"), F.col("issue_id").cast("string")).alias("url"), comments.alias("comments"), people.alias("participants"),
    )


def messages_of(threads: DataFrame) -> DataFrame:
    """One row per comment: (issue_id, title, pos, comment_id, author, timestamp, text, is_issue_body)."""
    return threads.select("issue_id", "title", F.posexplode("comments").alias("pos", "c")).select("issue_id", "title", "pos", "c.*")
