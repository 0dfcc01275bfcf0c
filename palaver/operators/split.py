"""Leakage-safe splitting: groups, stable assignment, manifests, drift and release reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions.hashing import assign, bucket
from palaver.functions.numbers import rounded

RATIOS = (0.8, 0.1, 0.1)
SPLITS = ("train", "validation", "test")


def assign_splits(rows: DataFrame, key: str, seed: str, ratios=RATIOS) -> DataFrame:
    return rows.withColumn("position", bucket(seed, F.col(key))).withColumn("split", assign(F.col("position"), ratios))


def with_manifest(rows: DataFrame, manifest: DataFrame, key: str, seed: str, ratios=RATIOS) -> DataFrame:
    """split of the manifest (group_key, split), else by hash; listed says which. Small manifests are broadcast by the planner."""
    known = manifest.select(F.col("group_key").alias(key), F.col("split").alias("_split"))
    out = rows.join(known, key, "left")
    return out.withColumn("listed", F.col("_split").isNotNull()).withColumn("split", F.coalesce("_split", assign(bucket(seed, F.col(key)), ratios))).drop("_split")


def report(rows: DataFrame, group: str = "group_key", seconds: Column | None = None, silent: Column | None = None, turns: Column | None = None) -> DataFrame:
    """Per split and in total: conversations, share, groups, turns, hours, share without an assistant."""
    aggs = [F.count("*").alias("conversations"), F.countDistinct(group).alias("groups")]
    aggs += [F.sum(turns).alias("turns")] if turns is not None else []
    aggs += [rounded(F.sum(seconds) / 3600, 6).alias("hours")] if seconds is not None else []
    aggs += [rounded(F.avg(silent.cast("double")), 6).alias("silent_share")] if silent is not None else []
    # The total is one of the few rows of the roll-up, so its window sorts nothing large.
    out = rows.rollup("split").agg(*aggs).withColumn("split", F.coalesce("split", F.lit("total")))
    total = F.max(F.when(F.col("split") == "total", F.col("conversations"))).over(Window.partitionBy())
    return out.withColumn("share", rounded(F.col("conversations") / total, 6))


def leakage(rows: DataFrame, group: str = "group_key") -> DataFrame:
    """Groups in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def category_gap(rows: DataFrame, category: str, splits=SPLITS) -> DataFrame:
    """Categories that some split lacks, with the splits they lack."""
    have = rows.groupBy(category).agg(F.collect_set("split").alias("have"))
    return have.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, splits)), "have"))).where(F.size("missing") > 0).drop("have")


def drift(old: DataFrame, new: DataFrame, key: str = "group_key") -> DataFrame:
    """moved, added or removed for each key whose split differs between two manifests."""
    a, b = old.select(key, F.col("split").alias("old_split")), new.select(key, F.col("split").alias("new_split"))
    change = F.when(F.col("old_split").isNull(), "added").when(F.col("new_split").isNull(), "removed").when(F.col("old_split") != F.col("new_split"), "moved")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null")
