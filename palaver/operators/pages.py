"""What pages about the corpus are made of: first files, voice cards, compared pairs, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palaver.functions.numbers import rounded


def first_files(files: DataFrame, scenario: str, suffix: str, excluded: str = "_background_debug") -> DataFrame:
    """The first path of each scenario that ends in the suffix and does not run through the excluded folder."""
    fits = F.col("path").endswith(suffix) & ~F.array_contains(F.split("path", "/"), excluded)
    return files.where(fits).groupBy(scenario).agg(F.min("path").alias("path"))


def voice_cards(samples: DataFrame, mapping: DataFrame, intros: DataFrame) -> DataFrame:
    """A card for each sample (name, voice_id) with its description, intro and fault.

    fault: `no intro` or `voice differs` where the mapping (name, voice_id, description, gender)
    does not list the sample's voice; a page is built only without faults.
    """
    listed = mapping.select("name", F.col("voice_id").alias("_listed"), "description", "gender")
    rows = samples.join(listed, "name", "left").join(intros.select("name", F.trim("text").alias("intro")), "name", "left")
    fault = F.when(F.col("intro").isNull(), "no intro").when(~F.col("voice_id").eqNullSafe(F.col("_listed")), "voice differs")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("description", "gender")}
    return rows.withColumns(blank).withColumn("fault", fault).drop("_listed")


def compared_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """pairs (ours, real) with both durations, a label, and whether both files are there."""
    side = lambda s: files.select(F.col("name").alias(s), rounded("duration", 1).alias(f"{s}_seconds"))
    rows = pairs.join(side("ours"), "ours", "left").join(side("real"), "real", "left")
    label = F.translate(F.regexp_replace("ours", "^no_va_", ""), "_", " ")
    return rows.withColumns({"label": label, "complete": F.col("ours_seconds").isNotNull() & F.col("real_seconds").isNotNull()})


def merged_role(base: Column, role: Column, context: Column) -> Column:
    """A variation's role, else the base's, with the variation's further context behind it."""
    own = F.coalesce(role, base)
    return F.when(context.isNotNull(), F.concat(own, F.lit(" "), context)).otherwise(own)


def prompt(*parts: Column, between: str = "\n\n") -> Column:
    """The parts that say something, one below the other."""
    return F.concat_ws(between, *(F.when(F.trim(p) != "", p) for p in parts))


def file_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes; null for a file that could not be read."""
    return F.when(content.isNotNull(), F.sha2(content, 256))


def provenance(files: DataFrame, facts: dict[str, str]) -> DataFrame:
    """name, bytes and hash of each file (name, content), with given facts, such as a commit, on every row."""
    rows = files.select("name", F.length("content").alias("bytes"), file_hash(F.col("content")).alias("sha256"))
    return reduce(lambda r, kv: r.withColumn(kv[0], F.lit(kv[1])), facts.items(), rows)
