"""Recompute only what changed: pending rows, content hashes, ledgers, fingerprints, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions import text as tx


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows not done yet; nulls in keys match nulls."""
    a, b = rows.alias("a"), done.select(*keys).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    return a.join(b, same, "left_anti")


def cache_status(index: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """status of each indexed key: new without an output, cached with no or an equal recorded hash, else stale.

    index: key, hash; recorded: key, recorded_hash, has_output. Keys that left the index are dropped.
    """
    out = index.join(recorded, key, "left")
    status = F.when(~F.coalesce("has_output", F.lit(False)), "new").when(F.col("recorded_hash").isNull() | (F.col("recorded_hash") == F.col("hash")), "cached").otherwise("stale")
    return out.withColumn("status", status)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries replace old ones of their key; the others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def manifest_rows(manifest: DataFrame, key: str, paths: str = "paths", texts: str = "texts") -> DataFrame:
    """One row per pair of a manifest's parallel arrays, as many as the shorter has."""
    n = F.least(F.size(paths), F.size(texts))
    pairs = F.slice(F.arrays_zip(F.col(paths).alias("path"), F.col(texts).alias("text")), 1, n)
    rows = manifest.select(key, F.posexplode(pairs).alias("i", "p"))
    return rows.select(key, "i", F.col("p.path").alias("path"), F.col("p.text").alias("text"))


def config_changes(current: DataFrame, stored: DataFrame, key: str, file: str) -> DataFrame:
    """added, removed or changed for each file whose hash differs."""
    a, b = current.select(key, file, F.col("hash").alias("now")), stored.select(key, file, F.col("hash").alias("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return a.join(b, [key, file], "full_outer").withColumn("change", change).where("change is not null").drop("now", "was")


def regenerate(scenarios: DataFrame, ledger: DataFrame, key: str, code_version: str) -> DataFrame:
    """reason to regenerate each scenario, the first that holds, or null.

    scenarios: key, files (map of hashes), composite; ledger: key, code_version, config_hash, composite_hash.
    """
    none = ledger.limit(1).agg((F.count("*") == 0).alias("_none"))
    out = scenarios.join(ledger, key, "left").join(F.broadcast(none), F.lit(True))
    stored = F.coalesce("config_hash", F.create_map().cast("map<string,string>"))
    names = F.array_union(F.map_keys("files"), F.map_keys(stored))
    changed = F.array_sort(F.filter(names, lambda f: ~F.element_at("files", f).eqNullSafe(F.element_at(stored, f))))
    reason = (
        F.when(F.col("_none"), "no version data").when(F.col("tracked").isNull(), "untracked").when(F.col("code_version").isNull(), "no code version")
        .when(tx.must_regenerate(F.col("code_version"), F.lit(code_version)), "code version").when(F.size(changed) > 0, F.concat(F.lit("config: "), F.array_join(changed, ",")))
        .when(F.col("composite") != F.col("composite_hash"), "hash")
    )
    return out.withColumn("reason", reason)


def stale_listing(ledger: DataFrame, scenarios: DataFrame, key: str, code_version: str) -> tuple[DataFrame, DataFrame]:
    """(ledger entries to regenerate with their reason, keys that are not of the form a/b/c).

    Entries without a scenario any more are listed as such.
    """
    well = F.size(F.split(key, "/")) == 3
    entries = ledger.where(well)
    current = entries.select(key).join(scenarios.withColumn("_known", F.lit(True)), key, "left")
    found = regenerate(current, entries, key, code_version)
    reason = F.when(F.col("_known").isNull(), "config missing").otherwise(F.col("reason"))
    stale = found.withColumn("reason", reason).where("reason is not null").drop("_known", "_none")
    return stale, ledger.where(~F.coalesce(well, F.lit(False))).select(key)


def speech_staleness(rows: DataFrame, code_version: str) -> DataFrame:
    """full, background_only or none for has_output, recorded version and hashes against current ones."""
    full = ~F.col("has_output") | F.col("code_version").isNull() | tx.must_regenerate(F.col("code_version"), F.lit(code_version)) | ~F.col("recorded_hash").eqNullSafe(F.col("speech_hash"))
    background = ~F.col("recorded_background").eqNullSafe(F.col("background_hash"))
    return rows.withColumn("redo", F.when(full, "full").when(background, "background_only").otherwise("none"))


def usable(utterances: DataFrame, key: str, expected: str) -> DataFrame:
    """Whether all expected files of a key are there, readable, and of one rate."""
    out = utterances.groupBy(key).agg(F.count("*").alias("files"), F.max(expected).alias("expected"), F.countDistinct("rate").alias("rates"), F.count_if(F.col("rate").isNull()).alias("bad"))
    return out.select(key, ((F.col("files") == F.col("expected")) & (F.col("rates") == 1) & (F.col("bad") == 0)).alias("usable"))


def fingerprint(files: DataFrame, folder: str, name: str, hash_: str) -> DataFrame:
    """SHA-256 over the sorted `name:hash` lines of each folder."""
    line = F.concat_ws(":", F.col(name).cast("string"), hash_)
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def composite_hash(files: Column) -> Column:
    """MD5 of a map of hashes as JSON with sorted keys and a space after commas and colons."""
    entries = F.transform(F.array_sort(F.map_entries(files)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')))
    return F.md5(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).cast("binary"))


def resolve(rows: DataFrame, index: DataFrame, key: str, candidates: list[Column]) -> DataFrame:
    """config of the first candidate key that the index (key, config) has; null without one."""
    listed = rows.select(key, F.posexplode(F.array(*candidates)).alias("priority", "candidate")).where("candidate is not null")
    found = listed.join(index, F.col("candidate") == F.col("config_key")).groupBy(key).agg(F.min(F.struct("priority", "config")).alias("best"))
    return rows.join(found, key, "left").withColumns({"config": F.col("best.config"), "priority": F.col("best.priority")}).drop("best")


def fallback_keys(variant: Column, stem: Column, scenario: Column, kind: Column) -> list[Column]:
    """The keys under which a conversation's config is looked up, in order."""
    cut = lambda c, suffix: F.when(c.rlike(suffix + "$"), F.regexp_replace(c, suffix + "$", ""))
    return [variant, stem, cut(variant, "_long"), cut(variant, "_[0-9]+"), cut(stem, "_long"), cut(stem, "_[0-9]+"), F.concat_ws("/", scenario, kind)]


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
