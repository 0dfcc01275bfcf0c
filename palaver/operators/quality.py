"""Corpus quality: detectors that emit error records, their roll-ups, and corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions import text as tx

ERROR = ("severity", "type", "scenario", "conv_id", "turn", "message")
MIN_TURNS = 4


def _error(rows: DataFrame, severity: str, kind: str, message: Column, scenario: str | None = "scenario") -> DataFrame:
    have = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), have(scenario, "string").alias("scenario"), have("conv_id", "string").alias("conv_id"), have("turn", "long").alias("turn"), message.alias("message"))


def short_dialogues(sizes: DataFrame, least: int = MIN_TURNS) -> DataFrame:
    """sizes: conv_id, turns. empty_conversation for none, short_dialogue below the least."""
    kind = F.when(F.col("turns") == 0, "empty_conversation").when(F.col("turns") < least, "short_dialogue")
    return sizes.withColumn("type", kind).where("type is not null")


def conversation_sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"))


def missing_fields(raw: DataFrame, fields=("speaker", "content")) -> DataFrame:
    """Turns (conv_id, turn, json) whose object lacks a field; a null value is no lack."""
    keys = F.map_keys(F.from_json("json", "map<string,string>"))
    rows = raw.withColumn("missing", F.array_except(F.array(*map(F.lit, fields)), keys)).where(F.size("missing") > 0)
    return _error(rows, "warning", "missing_fields", F.concat_ws(", ", "missing"))


def empty_utterances(turns: DataFrame) -> DataFrame:
    return turns.where(F.trim(tx.empty(F.col("text"))) == "")


def missing_speakers(turns: DataFrame) -> DataFrame:
    return turns.where(F.trim(tx.empty(F.col("role"))) == "")


def single_speaker(turns: DataFrame, applies: Column) -> DataFrame:
    """Conversations of several users in which one speaker has every turn; applies says which should have several."""
    return turns.where(applies).groupBy("conv_id").agg(F.countDistinct("role").alias("speakers")).where("speakers = 1")


def duplicate_texts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """hash, copies and the first key of each text that occurs more than once.

    Only keys and hashes are shuffled; a text with many copies is summed before the shuffle.
    """
    hashed = rows.select(key, F.md5(tx.empty(text).cast("binary")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def duplicate_dialogues(turns: DataFrame) -> DataFrame:
    """Conversations with the same contents in the same order."""
    contents = F.transform(F.sort_array(F.collect_list(F.struct("turn", tx.empty(F.col("text")).alias("text")))), lambda t: t["text"])
    whole = turns.groupBy("conv_id").agg(F.array_join(contents, " ").alias("whole"))
    return duplicate_texts(whole, "conv_id", F.col("whole"))


def missing_invocations(turns: DataFrame, wake_word: str, assistant: str = "assistant") -> DataFrame:
    """First turns of the assistant, not opening the conversation, whose turn before lacks the name."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"i": F.row_number().over(order) - 1, "before": F.lag("text").over(order), "k": F.sum((F.col("role") == assistant).cast("int")).over(order)})
    first = (F.col("role") == assistant) & (F.col("k") == 1) & (F.col("i") > 0)
    return rows.where(first & ~tx.mentions(F.col("before"), wake_word)).drop("k", "before")


def filler_words(turns: DataFrame, words=tx.FILLERS, assistant: str = "assistant") -> DataFrame:
    """Turns of the assistant that hold filler words, with the words and a preview."""
    rows = turns.where(F.col("role") == assistant).withColumn("fillers", tx.fillers(F.col("text"), words)).where(F.size("fillers") > 0)
    return rows.withColumn("preview", F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")))


def all_errors(turns: DataFrame, wake_word: str, fillers=tx.FILLERS, assistant: str = "assistant") -> DataFrame:
    """Error records of every detector over turns (conv_id, turn, role, text).

    A conversation is gathered once, as one row, and gives all its records and a record of its
    hash; equal conversations are counted from the latter. Both branches need the same columns
    of the same shuffle, so the table is scanned and shuffled once.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = turns.groupBy("conv_id").agg(ordered.alias("ts"))
    ts = F.col("ts")
    first = F.array_position(F.transform(ts, lambda t: F.coalesce(t["role"] == assistant, F.lit(False))), True).cast("int") - 1

    def record(when, severity, kind, turn, message):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), turn.cast("long").alias("turn"), message.alias("message")))

    def of_turn(t, i):
        spoken, held = F.coalesce(t["role"] == assistant, F.lit(False)), tx.fillers(t["text"], fillers)
        before = F.get(ts, i - 1)["text"]
        return F.array(
            record(F.trim(tx.empty(t["text"])) == "", "warning", "empty_utterance", t["turn"], F.lit("no content")),
            record(F.trim(tx.empty(t["role"])) == "", "warning", "missing_speaker", t["turn"], F.lit("no speaker")),
            record((i == first) & (i > 0) & ~tx.mentions(before, wake_word), "critical", "invocation_missing", t["turn"], F.lit("not addressed before")),
            record(spoken & (F.size(held) > 0), "critical", "filler_words", t["turn"], F.concat_ws(", ", held)),
        )

    contents = F.array_join(F.transform(ts, lambda t: tx.empty(t["text"])), " ")
    of_whole = F.array(
        record(F.size(ts) < MIN_TURNS, "critical", "short_dialogue", F.lit(None), F.concat(F.size(ts).cast("string"), F.lit(" turns"))),
        record(F.lit(True), "hash", "hash", F.lit(None), F.md5(contents.cast("binary"))),
    )
    found = F.filter(F.concat(F.flatten(F.transform(ts, of_turn)), of_whole), lambda e: e.isNotNull())
    rows = whole.select("conv_id", F.explode(found).alias("e")).select(F.lit(None).cast("string").alias("scenario"), F.col("conv_id").cast("string").alias("conv_id"), "conv_id", "e.*").toDF("scenario", "id", "conv", "severity", "type", "turn", "message")
    twice = rows.where("type = 'hash'").groupBy("message").agg(F.count("*").alias("copies"), F.min("conv").alias("conv_id")).where("copies > 1")
    single = rows.where("type <> 'hash'").select("severity", "type", "scenario", F.col("id").alias("conv_id"), "turn", "message")
    return single.unionByName(_error(twice, "warning", "duplicate_dialogue", F.concat(F.col("copies").cast("string"), F.lit(" copies"))))


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts in total, by severity, and by severity and type."""
    rows = errors.rollup("severity", "type").agg(F.count("*").alias("errors"))
    return rows.withColumns({"severity": F.coalesce("severity", F.lit("total")), "type": F.coalesce("type", F.lit("all"))})


def errors_by_type(errors: DataFrame) -> DataFrame:
    """Types by falling number of errors, with their place; there are as many rows as detectors."""
    rows = errors.groupBy("type").agg(F.count("*").alias("errors"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("errors").desc(), "type"))).orderBy("place")


def errors_by_scenario(errors: DataFrame) -> DataFrame:
    return errors.where(F.trim(tx.empty(F.col("scenario"))) != "").groupBy("scenario").agg(F.count("*").alias("errors"))


def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def onset_faults(timed: DataFrame) -> DataFrame:
    """Starts that are missing, beyond the duration, or before an earlier one."""
    earlier = F.max("start").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    fault = F.when(F.col("start").isNull(), "missing").when(F.col("start") > F.col("duration"), "beyond").when(F.col("start") < F.col("earlier"), "not_monotone")
    return timed.withColumn("earlier", earlier).withColumn("fault", fault).where("fault is not null").drop("earlier")


def cache_coverage(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Share of the wanted keys that are cached; 1 if none is wanted."""
    have = cached.select(key).distinct().withColumn("_have", F.lit(1.0))
    rows = wanted.select(key).join(have, key, "left")
    return rows.agg(F.count("*").alias("wanted"), F.coalesce(F.avg(F.coalesce("_have", F.lit(0.0))), F.lit(1.0)).alias("coverage"))


def text_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumns({"words": tx.count_words(F.col(text)), "chars": F.length(tx.empty(F.col(text)))})


def dialogue_quality(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, words, characters, and means per turn."""
    return text_counts(turns).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.avg("words").alias("words_per_turn"), F.avg("chars").alias("chars_per_turn"))


def five_numbers(value: str) -> list[Column]:
    """min, max, mean, median, sample deviation and count; 0 where there is nothing."""
    v = F.col(value).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": F.median(v), "stdev": F.stddev_samp(v)}
    return [zero(c).alias(f"{value}_{k}") for k, c in parts.items()] + [F.count(v).alias(f"{value}_count")]


def quality_by(rows: DataFrame, key: str, values) -> DataFrame:
    """Statistics of the values overall and by key, in one pass."""
    out = rows.rollup(key).agg(F.count("*").alias("files"), *(c for v in values for c in five_numbers(v)))
    return out.withColumn(key, F.coalesce(key, F.lit("overall")))


def coverage(rows: DataFrame, scenario: str, variant: str) -> DataFrame:
    """Files by scenario and variant, and the sorted variants of each scenario."""
    counts = rows.groupBy(scenario, variant).agg(F.count("*").alias("files"))
    return counts.groupBy(scenario).agg(F.sum("files").alias("files"), F.count("*").alias("variants"), F.array_join(F.sort_array(F.collect_set(variant)), ",").alias("names"))


def scenario_status(generated: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """All scenarios, generated or expected, with is_generated."""
    have = generated.select(key).distinct().withColumn("_have", F.lit(True))
    return generated.select(key).union(expected.select(key)).distinct().join(have, key, "left").select(key, F.coalesce("_have", F.lit(False)).alias("is_generated"))


def scenario_metrics(generated: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Files and statistics of every scenario, generated or expected, with is_generated; zeros for the latter."""
    stats = generated.groupBy(key).agg(F.count("*").alias("files"), *five_numbers(value))
    out = scenario_status(generated, expected, key).join(stats, key, "left")
    return out.select(key, "is_generated", *(F.coalesce(c, F.lit(0)).alias(c) for c in stats.columns if c != key))


def speaker_frequency(turns: DataFrame, assistant: str | None = None) -> DataFrame:
    rows = turns if assistant is None else turns.where(F.col("role") != assistant)
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


def most_common(rows: DataFrame, value: str, order: Column, k: int) -> DataFrame:
    """The k most frequent values; of equals the one seen first."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.col("n").desc(), "first_seen").limit(k)


def export_problem(wav: Column, parsed: Column, turns: Column, config: Column, onsets: Column) -> Column:
    """The first reason not to export; a mismatch of onsets keeps the row, with the reason."""
    return F.when(wav.isNull(), "no matching wav").when(~parsed, "unreadable json").when(turns == 0, "no turns").when(config.isNull(), "no config").when(onsets.isNotNull() & (F.size(onsets) != turns), "onset count differs")


def with_onsets(turns: Column, onsets: Column) -> Column:
    """Turns with their times replaced, where there is one onset for each."""
    replaced = F.zip_with(turns, onsets, lambda t, o: t.withField("time", o))
    return F.when(F.size(onsets) == F.size(turns), replaced).otherwise(turns)
