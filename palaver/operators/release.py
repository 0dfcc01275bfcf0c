"""The release: transcripts with their audio, configs and onsets, what is left out and why, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palaver.functions import text as tx
from palaver.operators import incremental, quality

#: Intermediates, which are no part of a release.
INTERMEDIATE = r"(-take[1-9]|.*director_notes.*)$"
LAYOUTS = (("text_corpora", "speech_corpora"), ("text", "audio"))


def layout(spark, root: str) -> tuple[str, str]:
    """(text folder, audio folder): of the known layouts the first that is there whole."""
    for pair in LAYOUTS:
        paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}") for name in pair]
        if all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths):
            return tuple(f"{root.rstrip('/')}/{name}" for name in pair)
    raise FileNotFoundError(f"{root} holds none of the layouts {LAYOUTS}")


def collect(transcripts: DataFrame, wavs: DataFrame, configs: DataFrame, onsets: DataFrame, assistants) -> DataFrame:
    """Every transcript with its problem, if any, and whether it is exported.

    transcripts: rel (path without suffix), scenario, variant_type, stem, variant_name, parsed,
    turns (array of structs with speaker and time); wavs: rel, duration, rate, channels; configs:
    config_key, config (the category); onsets: rel, onsets. A mismatch of onsets keeps the row on
    its planned times; every other problem leaves it out. All joins are on rel or on a config's keys.
    """
    rows = transcripts.where(~F.col("stem").rlike(INTERMEDIATE))
    name = F.coalesce("variant_name", "stem")
    keys = incremental.fallback_keys(name, F.col("stem"), F.col("scenario"), F.col("variant_type"))
    rows = incremental.resolve(rows.withColumn("variant_name", name), configs, "rel", keys).withColumnRenamed("config", "category").drop("priority")
    rows = rows.join(wavs.withColumn("wav", F.lit(True)), "rel", "left").join(onsets, "rel", "left")
    count = F.coalesce(F.size("turns"), F.lit(0))
    problem = quality.export_problem(F.col("wav"), F.col("parsed"), F.greatest(count, F.lit(0)), F.col("category"), F.col("onsets"))
    named = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["speaker"]), lambda s: s != "")))
    rows = rows.withColumns({"problem": problem, "speakers": named, "num_turns": count})
    return rows.withColumns({
        "exported": F.col("problem").isNull() | (F.col("problem") == "onset count differs"),
        "times_recovered": F.coalesce(F.size("onsets") == F.col("num_turns"), F.lit(False)),
        "turns": quality.with_onsets(F.col("turns"), F.col("onsets")),
        "has_va": ~tx.is_silent_export(F.col("speakers"), assistants),
        "id": F.concat_ws("/", "category", "variant_type", "variant_name"),
        "group_key": tx.group_key(F.col("category"), F.col("variant_type"), F.col("variant_name")),
    }).drop("wav", "parsed", "onsets")


def problems(collected: DataFrame) -> DataFrame:
    return collected.where("problem is not null").groupBy("problem").agg(F.count("*").alias("files"))


def report(rows: DataFrame, split: Column) -> DataFrame:
    """Rows, groups, hours and assistants by split and in total, from one roll-up."""
    out = rows.withColumn("split", split).rollup("split").agg(
        F.count("*").alias("n"), F.countDistinct("group_key").alias("groups"), (F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600).alias("hours"),
        F.count_if("has_va").alias("va"), F.count_if(~F.col("has_va")).alias("no_va"), F.count_if(~F.col("times_recovered")).alias("estimated"))
    return out.withColumn("split", F.coalesce("split", F.lit("total")))


def formats(rows: DataFrame) -> DataFrame:
    """Rows and bytes of 16-bit samples by sampling rate and channels."""
    size = F.coalesce("duration", F.lit(0.0)) * F.coalesce("rate", F.lit(0)) * 2
    return rows.groupBy("rate", "channels").agg(F.count("*").alias("n"), F.sum(size).alias("pcm_bytes"))


def achieved_sizes(manifests: DataFrame, system: str, speaker: str) -> DataFrame:
    """What each system's manifests hold in the end: entries and speakers."""
    return manifests.groupBy(system).agg(F.count("*").alias("entries"), F.countDistinct(speaker).alias("speakers"))
