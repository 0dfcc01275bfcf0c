"""Operators over the turns of conversations.

A turn has conv_id, turn (its order), role (the speaker) and text. Every operator takes the
name of the assistant's role; windows are partitioned by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions.numbers import rounded
from palaver.functions.text import mentions

ASSISTANT = "assistant"
CHARS_PER_SECOND = 11.0
MEAN_GAP = 0.75
MAX_CONTEXT = 20


def _order():
    return Window.partitionBy("conv_id").orderBy("turn")


def _before(rows: int | None = None):
    return _order().rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def label_turns(turns: DataFrame, wake_word: str, assistant: str = ASSISTANT) -> DataFrame:
    """expected: the assistant speaks next; trigger_type: direct if the turn names it, else contextual."""
    expected = F.coalesce(F.lead("role").over(_order()) == assistant, F.lit(False))
    kind = F.when(~F.col("expected"), "non-assistance").when(mentions(F.col("text"), wake_word), "direct").otherwise("contextual")
    return turns.withColumn("expected", expected).where(F.col("role") != assistant).withColumn("trigger_type", kind)


def label_balance(labelled: DataFrame) -> DataFrame:
    total = Window.partitionBy()
    out = labelled.groupBy("trigger_type").agg(F.count("*").alias("n"))
    return out.withColumn("pct", rounded(100.0 * F.col("n") / F.sum("n").over(total), 1))


def planned_times(turns: DataFrame) -> DataFrame:
    """start of each turn and duration of its conversation, at a fixed speaking rate."""
    seconds = F.length(F.coalesce("text", F.lit(""))) / CHARS_PER_SECOND
    start = F.coalesce(F.sum(seconds).over(_before()), F.lit(0.0))
    return turns.withColumns({"start": start, "duration": F.sum(seconds).over(Window.partitionBy("conv_id"))})


def turn_spans(timed: DataFrame) -> DataFrame:
    """A turn ends where the next begins; the last ends with the conversation."""
    return timed.withColumn("end", F.coalesce(F.lead("start").over(_order()), F.col("duration")))


def speaker_ids(turns: DataFrame, assistant: str = ASSISTANT) -> DataFrame:
    """One row per conversation and speaker: the assistant is 1, others count from 2 as they appear."""
    first = turns.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    human = F.col("role") != assistant
    rank = F.dense_rank().over(Window.partitionBy("conv_id", human).orderBy("first_turn"))
    return first.withColumn("speaker_id", F.when(human, rank + 1).otherwise(1))


def context_window(turns: DataFrame, most: int = MAX_CONTEXT, assistant: str = ASSISTANT) -> DataFrame:
    """The turns before each turn of a human, at most `most`, the assistant's included."""
    context = F.collect_list("turn").over(_before(most))
    return turns.withColumn("context", context).where(F.col("role") != assistant)


def context_matrix(contexts: DataFrame, most: int = MAX_CONTEXT, pad: int = -1) -> DataFrame:
    """slots: the context on the right of a fixed length; mask: true where it is padding."""
    missing = F.lit(most) - F.size("context")
    return contexts.withColumns({
        "slots": F.concat(F.array_repeat(F.lit(pad).cast("long"), missing), F.col("context")),
        "mask": F.concat(F.array_repeat(F.lit(True), missing), F.array_repeat(F.lit(False), F.size("context"))),
    })


def context_vectors(contexts: DataFrame, vectors: DataFrame, dim: int, most: int = MAX_CONTEXT) -> DataFrame:
    """One row per slot: the vector of the turn in it, zeros for padding and for missing vectors.

    vectors: conv_id, turn, vector.
    """
    slots = context_matrix(contexts, most).select("conv_id", F.col("turn").alias("at"), F.posexplode("slots").alias("slot", "turn"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return slots.join(vectors, ["conv_id", "turn"], "left").select("conv_id", "at", "slot", "turn", F.coalesce("vector", zeros).alias("vector"))


def since_last_turn(turns: DataFrame) -> DataFrame:
    """since: the turns after the speaker's last one before this, or the last two if there is none.

    A conversation is one array of its turns, from which every turn takes its slice.
    """
    own = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = turns.withColumn("_i", F.row_number().over(_order())).withColumn("_last", F.lag("_i").over(own))
    row = F.struct("_i", "_last", F.struct(*turns.columns).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    numbers = F.transform("_rows", lambda r: r["row"]["turn"])
    first = lambda r: F.coalesce(r["_last"] + 1, F.greatest(r["_i"] - 2, F.lit(1)))
    out = whole.withColumn("_turns", numbers).select(F.explode(F.transform("_rows", lambda r: F.struct(r["row"].alias("row"), F.slice("_turns", first(r), r["_i"] - first(r)).alias("since")))).alias("_x"))
    return out.select("_x.row.*", F.col("_x.since").alias("since"))


def first_interaction(turns: DataFrame, assistant: str = ASSISTANT) -> DataFrame:
    """first_interaction: the assistant has not spoken before this turn."""
    spoke = F.max((F.col("role") == assistant).cast("int")).over(_before())
    return turns.withColumn("first_interaction", F.coalesce(spoke, F.lit(0)) == 0)


def wake_index(turns: DataFrame, wake_word: str, back: int = 3, assistant: str = ASSISTANT) -> DataFrame:
    """Per conversation with an assistant: the last of up to `back` turns before its first that names it."""
    number = F.row_number().over(_order()) - 1
    numbered = turns.withColumn("i", number)
    first = F.min(F.when(F.col("role") == assistant, F.col("i"))).over(Window.partitionBy("conv_id"))
    near = (F.col("i") < F.col("first")) & (F.col("i") >= F.col("first") - back) & mentions(F.col("text"), wake_word)
    out = numbered.withColumn("first", first).where("first is not null")
    return out.groupBy("conv_id").agg(F.max(F.when(near, F.col("i"))).alias("wake_index"))


def estimate_turn_starts(turns: DataFrame, duration: Column, gap: float = MEAN_GAP) -> DataFrame:
    """Starts in proportion to text length, with a gap between turns; gaps take at most half the time."""
    whole = Window.partitionBy("conv_id")
    chars = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    rows = turns.withColumns({"chars": chars, "duration": duration, "turns": F.count("*").over(whole)})
    rows = rows.withColumn("rate", F.greatest(F.col("duration") - gap * (F.col("turns") - 1), F.col("duration") * 0.5) / F.sum("chars").over(whole))
    before = F.coalesce(F.sum("chars").over(_before()), F.lit(0))
    start = rounded(before * F.col("rate") + gap * (F.row_number().over(_order()) - 1), 2)
    return rows.withColumn("start", start).drop("chars", "turns", "rate")


def fill_starts(starts: Column, duration: Column) -> Column:
    """Array of starts with gaps filled, made monotone and cut at the duration.

    A missing start takes the mean of the one before, filled already, and the next known one.
    """
    n = F.size(starts)

    def step(acc, i):
        known = F.filter(F.slice(starts, i + 1, n), lambda x: x.isNotNull())
        after = F.coalesce(F.get(known, F.lit(0)), duration)
        before = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0))
        here = F.get(starts, i)
        return F.concat(acc, F.array(F.coalesce(here, rounded((before + after) / 2, 2))))

    filled = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<double>"), step)).otherwise(F.array().cast("array<double>"))
    rising = F.transform(filled, lambda x, i: F.array_max(F.slice(filled, 1, i + 1)))
    return F.transform(rising, lambda x: F.least(x, duration))


def scene_trim(timed: DataFrame, keep: int, tail: float = 6.0) -> DataFrame:
    """The first `keep` turns; a cut conversation ends where the next turn starts, or `tail` seconds after the last start."""
    rows = timed.withColumn("i", F.row_number().over(_order()) - 1)
    whole = Window.partitionBy("conv_id")
    start = lambda k: F.max(F.when(F.col("i") == k, F.col("start"))).over(whole)
    end = F.when(start(keep).isNotNull(), rounded(F.least(start(keep), start(keep - 1) + tail), 2)).otherwise(F.col("duration"))
    return rows.withColumn("scene_seconds", end).where(F.col("i") < keep).drop("i")


def mix_offsets(timed: DataFrame, gap: Column) -> DataFrame:
    """offset at which each turn is mixed: after the one before plus gap (negative overlaps), never below 0.

    A sum that is held at 0 is the plain running sum less its lowest value so far, if that is below 0.
    """
    rows = timed.withColumns({"length": F.col("end") - F.col("start"), "gap": gap})
    rows = rows.withColumn("_sum", F.coalesce(F.sum(F.col("length") + F.col("gap")).over(_before()), F.lit(0.0)))
    lowest = F.min("_sum").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("offset", F.col("_sum") - F.least(lowest, F.lit(0.0))).drop("_sum")


def pause_statistics(rows: DataFrame, gap: str = "gap") -> DataFrame:
    return rows.agg(F.count(gap).alias("n"), F.sum(gap).alias("total"), F.min(gap).alias("least"), F.max(gap).alias("most"))


def ambient_hold_out(turns: DataFrame, sentinel: str) -> tuple[DataFrame, DataFrame]:
    """(spoken turns, ambient turns)."""
    ambient = F.coalesce(F.col("role") == sentinel, F.lit(False))
    return turns.where(~ambient), turns.where(ambient)


def ambient_remerge(spoken: DataFrame, ambient: DataFrame, time: Column) -> DataFrame:
    """Both, in the order of time; turns without a time come last, spoken before ambient at the same time.

    position counts within the conversation.
    """
    rows = spoken.withColumn("source", F.lit(0)).union(ambient.withColumn("source", F.lit(1)))
    order = Window.partitionBy("conv_id").orderBy(F.col("time").asc_nulls_last(), "source", "turn")
    return rows.withColumn("time", time).withColumn("position", F.row_number().over(order) - 1).drop("source")


def turn_schedule(phases: DataFrame) -> DataFrame:
    """Speakers in order of speaking: phases (scene, phase_index, phase, speakers, silence, max_turns) to turns.

    A silence is one turn of no speaker; past the last phase it repeats until max_turns.
    """
    spoken = F.when(F.col("silence"), F.array(F.lit(None).cast("string"))).otherwise(F.col("speakers"))
    rows = phases.select("scene", "max_turns", "phase_index", "phase", F.posexplode(spoken).alias("slot", "speaker"))
    order = Window.partitionBy("scene").orderBy("phase_index", "slot")
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    whole = Window.partitionBy("scene")
    rows = rows.withColumns({"n": F.count("*").over(whole), "last": F.max("phase_index").over(whole)})
    size = F.count("*").over(Window.partitionBy("scene", "phase_index"))
    rows = rows.withColumn("size", size)
    left = F.col("max_turns") - 1 - F.col("i")
    again = F.when((F.col("phase_index") == F.col("last")) & (left >= F.col("size")), F.floor(left / F.col("size")).cast("int")).otherwise(0)
    rows = rows.where("i < max_turns").withColumn("round", F.explode(F.sequence(F.lit(0), again)))
    return rows.select("scene", (F.col("i") + F.col("round") * F.col("size")).alias("turn"), "phase", "speaker")


def disambiguate_ids(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """uid: the key, and from its second occurrence on #1, #2 and so forth."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("uid", F.when(n == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), n.cast("string"))))
