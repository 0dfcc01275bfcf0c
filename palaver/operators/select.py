"""Balanced selection: usage caps, stable round-robin, shares, first owners, greedy reassignment."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palaver.functions.hashing import shuffled


def usage(rows: DataFrame, character: str, file: str) -> DataFrame:
    return rows.groupBy(character).agg(F.countDistinct(file).alias("files"))


def concentration(used: DataFrame, top=(5, 20)) -> DataFrame:
    """Share of all uses that the most used characters have; only the longest top list is ordered."""
    total = used.agg(F.sum("files").alias("total"), F.count("*").alias("characters"))
    best = used.select("files").orderBy(F.col("files").desc()).limit(max(top)).withColumn("rank", F.row_number().over(Window.orderBy(F.col("files").desc())))
    sums = best.agg(*(F.sum(F.when(F.col("rank") <= k, F.col("files"))).alias(f"top{k}") for k in top))
    out = total.join(F.broadcast(sums), F.lit(True))
    return out.select("characters", "total", *((F.col(f"top{k}") / F.col("total")).alias(f"top{k}_share") for k in top))


def cap(share: float, files: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(files * share)).cast("int")


def keep_within_cap(rows: DataFrame, character: str, file: str, limit: int, seed: str) -> DataFrame:
    """The first `limit` files of each character in a stable pseudo-random order."""
    once = rows.select(character, file).distinct()
    order = Window.partitionBy(character).orderBy(shuffled(seed, F.col(file).cast("string")), file)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def needed_for_share(total: Column, having: Column, share: float) -> Column:
    """How many to add so that the share is reached, rounded half to even."""
    if share >= 1:
        raise ValueError("a share of 1 or more cannot be reached by adding")
    return F.greatest(F.lit(0), F.bround((share * total - having) / (1 - share)).cast("long"))


def round_robin(rows: DataFrame, category: str, key: str, target: int, seed: str) -> DataFrame:
    """Takes one of each category in turn, categories in order, until the target is reached."""
    order = Window.partitionBy(category).orderBy(shuffled(seed, F.col(key).cast("string")), key)
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= target)
    return ranked.orderBy("rank", category).limit(target)


def first_per_group(rows: DataFrame, group: str, key: str, groups: int, each: int) -> DataFrame:
    """The first `each` rows of the first `groups` groups."""
    names = rows.select(group).distinct().orderBy(group).limit(groups)
    order = Window.partitionBy(group).orderBy(key)
    return rows.join(F.broadcast(names), group, "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)


def first_owner(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """owner_of_value: the first that has it; the others refer to it."""
    first = rows.groupBy(value).agg(F.min(owner).alias("first_owner"))
    return rows.join(first, value).withColumn("is_owner", F.col(owner) == F.col("first_owner"))


def best_per_group(rows: DataFrame, group: str, score: str, seq: str, k: int = 3) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), seq)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_report(rows: DataFrame, flag: Column, added: Column) -> DataFrame:
    """n, share now and after adding."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(flag).alias("having"))
    return out.withColumns({"share": F.col("having") / F.col("n"), "after": (F.col("having") + added) / (F.col("n") + added)})


def greedy_reassign(overflow: DataFrame, pool: DataFrame, counts: DataFrame) -> DataFrame:
    """Gives each overflow slot, in order, to the least used eligible character of the pool.

    overflow: file, slot, character, gender, present (array), seq; pool: name, gender, protected,
    position; counts: name, files. Every pick changes the counts of its gender's pool, so a gender
    is one sequence: only what exceeds the caps comes here, and the pool, one row per voice, is
    sent to it once. Ties take the first in pool order. A slot without an eligible character, or
    without a gender, gets null.
    """
    table = pool.where(~F.col("protected")).join(counts, "name", "left").select("gender", "position", "name", F.coalesce("files", F.lit(0)).alias("files"))

    def pick(frame: pd.DataFrame, voices: pd.DataFrame) -> pd.DataFrame:
        voices = voices.sort_values("position")
        files = dict(zip(voices["name"], voices["files"], strict=True))
        taken: dict[str, set] = {}
        out = []
        for r in frame.sort_values("seq").itertuples():
            here = taken.setdefault(r.file, set(r.present))
            best = min((n for n in files if n not in here), key=files.get, default=None)
            if best is not None:
                files[best] += 1
                here.add(best)
            out.append((r.file, r.slot, r.character, best))
        return pd.DataFrame(out, columns=["file", "slot", "character", "given"])

    return overflow.groupBy("gender").cogroup(table.groupBy("gender")).applyInPandas(pick, "file string, slot string, character string, given string")


def rename(text: str, names: dict[str, str]) -> str:
    """Whole words only, longest name first, all in one pass, so that no new name is renamed again."""
    if not names:
        return text
    order = sorted(names, key=len, reverse=True)
    return re.sub(r"\b(" + "|".join(map(re.escape, order)) + r")\b", lambda m: names[m[1]], text)


def _object(text: str, name: str, start: int, end: int) -> tuple[int, int] | None:
    """Where the object that a JSON text has under a name between two places begins and ends."""
    found = re.compile(rf'"{re.escape(name)}"\s*:\s*\{{').search(text, start, end)
    if not found:
        return None
    depth, quoted, k = 1, False, found.end()
    while k < end and depth:
        c = text[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
        k += 1
    return found.end(), k


def retarget(text: str, block: str, keys: dict[str, str]) -> str:
    """The text of a config in which the roles of one block have the backstory files of new characters; the rest stays as it is."""
    for role, key in keys.items():
        outer = _object(text, block, 0, len(text))
        inner = outer and _object(text, role, *outer)
        if inner:
            part = re.sub(r'("backstory_file"\s*:\s*)"[^"]*"', lambda m: f'{m[1]}"{key}.txt"', text[slice(*inner)], count=1)
            text = text[: inner[0]] + part + text[inner[1] :]
    return text


@F.pandas_udf(T.StringType())
def retarget_all(text: pd.Series, block: pd.Series, keys: pd.Series) -> pd.Series:
    """retarget() of each text with its own block and map of roles."""
    return pd.Series([None if t is None else retarget(t, b or "", dict(k or {})) for t, b, k in zip(text, block, keys, strict=True)])


@F.pandas_udf(T.StringType())
def rename_all(text: pd.Series, names: pd.Series) -> pd.Series:
    """rename() of each text with its own map of names."""
    return pd.Series([None if t is None else rename(t, dict(n or {})) for t, n in zip(text, names, strict=True)])
