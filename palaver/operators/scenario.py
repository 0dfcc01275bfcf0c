"""Scenario configs: speakers, phases, voices, planned times and gaps, and calls to outside models."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.functions import text as tx
from palaver.functions.hashing import bucket
from palaver.functions.numbers import rounded

#: Phases that script a request, and what they are called without an assistant.
PHASE_NAMES = {
    "seeking_help": "weighing_options", "assistance_request": "comparing_ideas", "assistance": "talking_it_over", "seeking_guidance": "thinking_it_through",
    "seeking_advice": "thinking_it_through", "sigma_moment": "a_passing_question", "assistant_query": "a_passing_question", "help_request": "weighing_options",
    "recommendation_request": "comparing_ideas", "problem": "the_snag", "discussion": "talking_it_over", "planning": "mapping_it_out",
    "assistance_request ": "comparing_ideas",
}
#: Words of other phases that script a request, and phases to which the assistant is always added.
ASSIST_WORDS = "assist|help|sigma|recommend|advice|guidance|query"
FORCING_PHASES = ("assistance_request", "discussion", "planning")
#: Seconds by which an interjection overlaps the turn before, and the gaps of the others.
GAP, OVERLAP, OVERLAP_SHARE, SHORT_FACTOR, SHORT_WORDS = (0.3, 1.2), (0.15, 0.8), 0.2, 2.0, 4


def normal_speakers(raw: Column, conversation_type: Column) -> Column:
    """struct(names, interjections) of a JSON array whose items are names or {speaker, interjection}.

    user2 is dropped in a single user's conversation; interjections are keyed by position after that.
    """
    items = F.coalesce(F.try_parse_json(raw).try_cast("array<variant>"), F.array().cast("array<variant>"))
    pair = F.transform(items, lambda v: F.struct(
        F.coalesce(F.try_variant_get(v, "$.speaker", "string"), F.try_variant_get(v, "$", "string")).alias("name"), F.try_variant_get(v, "$.interjection", "string").alias("interjection")))
    kept = F.filter(pair, lambda p: ~((conversation_type == "single_user") & (p["name"] == "user2")))
    tagged = F.filter(F.transform(kept, lambda p, i: F.struct(i.alias("key"), p["interjection"].alias("value"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.struct(F.transform(kept, lambda p: p["name"]).alias("names"), F.map_from_entries(tagged).alias("interjections"))


def without_assistant(phases: Column, guard: str, mention: str = "assistant") -> Column:
    """Phases (phase, speakers, note) with the assistant gone: not a speaker, no requesting name, a guard in the note once."""
    renamed = F.create_map(*(F.lit(x) for kv in PHASE_NAMES.items() for x in kv))

    def one(p):
        name = F.coalesce(F.element_at(renamed, tx.empty(p["phase"])), F.when(p["phase"].rlike(f"(?i){ASSIST_WORDS}"), "talking_it_over"), p["phase"])
        note = F.trim(tx.empty(p["note"]))
        ended = F.when((note == "") | note.rlike(r"[.!?]$"), note).otherwise(F.concat(note, F.lit(".")))
        guarded = F.when(F.contains(ended, F.lit(guard)), ended).otherwise(F.trim(F.concat_ws(" ", ended, F.lit(guard))))
        speakers = F.filter(p["speakers"], lambda s: ~F.contains(F.lower(s), F.lit(mention)))
        return p.withField("speakers", speakers).withField("phase", name).withField("note", guarded)

    return F.transform(phases, one)


def count_changes(before: Column, after: Column) -> Column:
    """How many items of two arrays of one length differ."""
    return F.size(F.filter(F.zip_with(before, after, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))


def without_directives(rules: Column, affirm: str, negation: str) -> Column:
    """Rules that say the assistant acts, without negating it, are left out."""
    return F.filter(rules, lambda r: ~(r.rlike(tx.any_case(affirm)) & ~r.rlike(tx.any_case(negation))))


def voice_of(speaker: Column, model: str, mode: Column, characters: Column, generic: Column, positional: Column | None = None) -> Column:
    """The speaker's own voice, else the generic one of the mode, else one by position, else null.

    characters: map name to map model to voice; generic: map name to map mode to map model to voice.
    """
    own = F.try_element_at(F.try_element_at(characters, speaker), F.lit(model))
    common = F.try_element_at(F.try_element_at(F.try_element_at(generic, speaker), mode), F.lit(model))
    return F.coalesce(own, common, *([positional] if positional is not None else []))


def speaker_name(role: Column, agent: Column, cast: Column, assistant: str) -> Column:
    """assistant under its name; others as the cast has their agent, or user2's for the unknown."""
    return F.when(role == "assistant", assistant).otherwise(F.coalesce(F.try_element_at(cast, agent), F.try_element_at(cast, F.lit("user2")), agent))


def pool(voices: DataFrame, backstories: DataFrame, name: str = "name") -> DataFrame:
    """Voices whose name has a backstory, in any case."""
    have = backstories.select(F.lower(name).alias("_name")).distinct()
    return voices.join(have, F.lower(name) == F.col("_name"), "left_semi")


def referenced(configs: DataFrame, existing: DataFrame) -> DataFrame:
    """config, character: those that backstory files and agents name, as far as they exist.

    configs: config, backstory_files (array), characters (array); existing: character.
    """
    files = F.transform(F.coalesce("backstory_files", F.array().cast("array<string>")), lambda f: F.regexp_replace(F.regexp_replace(f, "^.*/", ""), r"\.txt$", ""))
    names = F.array_distinct(F.concat(files, F.coalesce("characters", F.array().cast("array<string>"))))
    return configs.select("config", F.explode(names).alias("character")).join(existing.select("character"), "character", "left_semi")


def partition_silent(variants: DataFrame) -> DataFrame:
    """silent: whether a variant (max_turns, name, file) goes without the assistant; one scan for both parts."""
    silent = tx.is_silent_twin(F.col("max_turns"), F.col("name"), F.col("file"))
    return variants.withColumn("silent", F.coalesce(silent, F.lit(False)))


def without_twin(variants: DataFrame, path: str) -> DataFrame:
    """Variants whose twin's path is not among the paths."""
    have = variants.select(F.col(path).alias("_twin"))
    return variants.join(have, tx.twin_path(F.col(path)) == F.col("_twin"), "left_anti")


def distinct_speakers(turns: DataFrame) -> DataFrame:
    """The named speakers of each conversation, sorted."""
    named = F.when(F.col("role") != "", F.col("role"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_set(named)).alias("speakers"))


def eligible(variants: DataFrame, category: str, excluded) -> DataFrame:
    """The categories but those that are about the assistant."""
    return variants.where(~F.col(category).isin(*excluded)).select(category).distinct()


def risky(names: Column, words: Column) -> Column:
    """Names that are everyday words too, in their own order."""
    return F.array_intersect(names, words)


def appended(variations: Column, new: Column) -> Column:
    return F.concat(variations, F.coalesce(new, F.array().cast("array<string>")))


def _uniform(seed: str, key: Column, low, high) -> Column:
    return low + bucket(seed, key) * (high - low)


def planned_times(turns: DataFrame, seed: str, delay=(0.5, 2.0), variance: float = 0.3, rate: float = 11.0) -> DataFrame:
    """time of each turn: delay and variance after the one before has ended, never below 0; one decimal.

    Every turn depends on the one before, so a conversation's turns are folded as one array.
    """
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    wait = _uniform(seed + "-delay", key, *delay) + _uniform(seed + "-variance", key, -variance, variance)
    row = F.struct("turn", wait.alias("wait"), (F.length(tx.empty(F.col("text"))) / rate).alias("spoken"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<struct<turn:bigint,time:double>>").alias("out"))

    def step(acc, r):
        at = F.greatest(F.lit(0.0), acc["end"] + r["wait"])
        return F.struct((at + r["spoken"]).alias("end"), F.concat(acc["out"], F.array(F.struct(r["turn"].cast("bigint").alias("turn"), rounded(at, 1).alias("time")))).alias("out"))

    return rows.select("conv_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select("conv_id", "x.turn", "x.time")


def gaps(turns: DataFrame, seed: str, interjections: dict[str, tuple[float, float]], overlapping: Column | None = None) -> DataFrame:
    """gap after each turn but the last: negative where the next one overlaps.

    A tagged interjection always overlaps; others do with the ambient share, more often if short,
    where overlapping holds. turns has an interjection column.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = turns.withColumns({"next_tag": F.lead("interjection").over(order), "next_words": F.lead(tx.count_words(F.col("text"))).over(order)})
    ambient = F.lit(False) if overlapping is None else overlapping
    chance = F.when(F.col("next_words") <= SHORT_WORDS, OVERLAP_SHARE * SHORT_FACTOR).otherwise(OVERLAP_SHARE)
    gap = F.when(ambient & (bucket(seed + "-draw", key) < chance), -_uniform(seed, key, *OVERLAP)).otherwise(_uniform(seed, key, *GAP))
    for tag, span in interjections.items():
        gap = F.when(F.col("next_tag") == tag, -_uniform(seed, key, *span)).otherwise(gap)
    return rows.withColumn("gap", F.when(F.col("next_words").isNotNull(), gap)).drop("next_tag", "next_words")


def call_model(rows: DataFrame, make: Callable[[], Callable[[pd.Series], list]], column: str, result: str = "response", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds result: what an outside model gives for a column, batch by batch, null after the last failed try.

    make() builds the client once per task; the wait doubles from try to try, unless the error says
    how long to wait (retry_after, in seconds). Limit concurrency by the number of partitions, and
    filter finished rows out before.
    """
    names = [c for c in rows.columns if c != result]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema.fields) + f", `{result}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for f in frames:
            out = [None] * len(f)
            for k in range(tries):
                try:
                    out = client(f[column])
                    break
                except Exception as e:  # the client's errors are its own; a row without an answer keeps null
                    if k + 1 < tries:
                        asked = getattr(e, "retry_after", None)
                        time.sleep(wait * 2**k if asked is None else float(asked))
            yield f.assign(**{result: out})

    return rows.select(names).mapInPandas(run, schema)


def rewrite_briefs(rows: DataFrame, make: Callable[[], Callable[[pd.Series], list]], column: str, wait: float = 1.0) -> DataFrame:
    """rewritten: briefs that mention the assistant as a model rewrites them, asked once more where it still does; null if both fail.

    Other briefs stay as they are. One pass over the rows: both calls are made in the same task.
    """
    pattern = re.compile(tx.BRIEF_MENTION, re.I)

    def twice():
        client = make()

        def ask(texts: pd.Series) -> list:
            out = texts.tolist()
            for _ in range(2):
                again = [i for i, t in enumerate(out) if t and pattern.search(t)]
                if again:
                    for i, t in zip(again, client(pd.Series([out[i] for i in again])), strict=True):
                        out[i] = t
            return [None if t and pattern.search(t) else t for t in out]

        return ask

    return call_model(rows, twice, column, "rewritten", wait=wait)
