"""Placing turns in recognised words: a cursor moves on with every match, so each conversation is one sequence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

PROBE, WINDOW, LEAST_RATIO, LEAST_SHARE = 6, 90, 0.45, 0.8


def align(tokens: list[list[str]], words: list[tuple[str, float]]) -> list[float | None]:
    """Start of each turn, or None, given its tokens and the recognised (word, time).

    The first words of a turn are compared with every stretch in the next WINDOW words; the
    most similar wins, of equals one whose first word agrees, then the earliest.
    """
    out: list[float | None] = []
    cursor = 0
    for own in tokens:
        probe, best, place = own[:PROBE], (LEAST_RATIO, 1), None
        for at in range(cursor, min(cursor + WINDOW, len(words))) if probe else ():
            heard = [w for w, _ in words[at : at + len(probe)]]
            key = (SequenceMatcher(None, probe, heard).ratio(), int(heard[0] == probe[0]))
            if key > best:
                best, place = key, at
        out.append(None if place is None else round(words[place][1], 2))
        if place is not None:
            cursor = min(place + max(len(own) - 2, 1), len(words) - 1)
    if out and out[0] is None:
        out[0] = 0.0
    return out


def align_turns(turns: DataFrame, words: DataFrame) -> DataFrame:
    """conv_id, turn, start, matched of turns (conv_id, turn, tokens) and words (conv_id, position, word, time).

    matched says whether enough turns of the conversation were found to trust the starts.
    """

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("turn"), right.sort_values("position")
        starts = align([list(t) for t in left["tokens"]], list(zip(right["word"], right["time"], strict=True)))
        found = sum(s is not None for s in starts)
        return pd.DataFrame({"conv_id": left["conv_id"], "turn": left["turn"], "start": pd.Series(starts, index=left.index, dtype="float64"), "matched": found >= LEAST_SHARE * len(left)})

    return turns.groupBy("conv_id").cogroup(words.groupBy("conv_id")).applyInPandas(place, "conv_id long, turn long, start double, matched boolean")
