"""Numbering of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... within the rows of equal ``keys``.

    Rows are ordered by ``slice_by`` and then ``order``; ``order`` must refine
    ``slice_by``.  Only rows of one slice are sorted in one task: the slices'
    sizes are summed up beforehand, so a group may hold any share of all rows.
    """
    df = df.withColumn("_rk_slice", slice_by)
    same = [F.col(k) for k in [*keys, "_rk_slice"]]
    sizes = df.groupBy(*same).agg(F.count(F.lit(1)).alias("_rk_n"))
    upto = Window.partitionBy(*keys).orderBy("_rk_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_rk_{k}") for k in [*keys, "_rk_slice"]], F.coalesce(F.sum("_rk_n").over(upto), F.lit(0)).alias("_rk_before"))
    ranked = df.withColumn("_rk_in", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
    on = [ranked[k].eqNullSafe(offsets[f"_rk_{k}"]) for k in [*keys, "_rk_slice"]]
    out = ranked.join(offsets, on).withColumn(name, F.col("_rk_before") + F.col("_rk_in"))
    return out.drop(*[f"_rk_{k}" for k in [*keys, "_rk_slice"]], "_rk_slice", "_rk_in", "_rk_before")


def text_slice(text: Column, ord_: Column, letters: int = 13) -> Column:
    """Slice of rows ordered by (text, ord): the beginning of the text; equal short texts are cut by ``ord``."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.substring(t, 1, letters).alias("t"), F.when(F.length(t) < letters, F.floor(ord_ / 65536)).otherwise(F.lit(0)).alias("o"))


def next_within(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], column: Column, name: str) -> DataFrame:
    """Add ``name``: ``column`` of the next row among the rows of equal ``keys``; null behind the last.

    Rows are sorted within slices only; the first row of each slice is handed
    to the last row of the slice before it.
    """
    df = df.withColumns({"_nx_slice": slice_by, "_nx_v": F.struct(column.alias("v"))})
    same = [F.col(k) for k in [*keys, "_nx_slice"]]
    firsts = df.groupBy(*same).agg(F.min_by("_nx_v", F.struct(*order)).alias("_nx_first"))
    firsts = firsts.withColumn("_nx_after", F.lead("_nx_first").over(Window.partitionBy(*keys).orderBy("_nx_slice")))
    firsts = firsts.select(*[F.col(k).alias(f"_nx_{k}") for k in keys], F.col("_nx_slice").alias("_nx_s"), "_nx_after")
    led = df.withColumn("_nx_in", F.lead("_nx_v").over(Window.partitionBy(*same).orderBy(*order)))
    on = [led[k].eqNullSafe(firsts[f"_nx_{k}"]) for k in keys] + [led["_nx_slice"].eqNullSafe(firsts["_nx_s"])]
    out = led.join(firsts, on).withColumn(name, F.coalesce("_nx_in", "_nx_after"))
    return out.drop("_nx_slice", "_nx_s", "_nx_v", "_nx_in", "_nx_after", *[f"_nx_{k}" for k in keys])
