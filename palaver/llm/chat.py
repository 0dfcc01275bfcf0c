"""Chat formatting: roles of a transcript's lines by a hidden Markov model (operator 4).

A line's hidden state is a role and whether the line begins a turn. Lines emit a speaker
marker (of a known role, the first or second name of the transcript, or none), whether a
blank line lies before them, whether they ask, and their length. Viterbi gives the most likely
states; lines of a turn are joined, markers are dropped, and turns are rendered in one
canonical form. All transcripts of a batch advance one line at a time.

The tables are counted, by fit(), on at most MAX_FIT conversations with known roles (those with
the smallest hash of conv_id): each is written out with role markers, with names, without
markers, and with markers for some of its turns, and PRIOR is added STRENGTH times to what its
lines emit. Without such conversations PRIOR stands.

Nulls: a null or blank transcript has no turns and renders as "". In the query, a null role
is a turn without a marker, behind a blank line, null text is empty, a row without conv_id or turn is a transcript
of its own, and repeated rows count once. A conversation is read in segments of
SEGMENT turn numbers, so that no task gathers an unbounded one. Segments are units of work only:
each sends a summary (its first name and blank lines, then for every state before it the best
scores of the states at its end), a fold over the summaries gives each segment the first
name of the conversation and its first and last state on the best path of the whole, and
"rendered" of the segments in order, put together, is the rendering of the whole conversation.
A turn belongs to the segment where it begins; what a segment continues comes first in it.
Of equally likely states any one counts. Very long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palaver.llm import text as tx
from palaver.llm.shared import Scratch, arrow_rows, lean

SEGMENT = 256
MAX_FIT, STRENGTH = 2000, 10.0
#: Ids of conversations of several segments that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000
ROLES = ("system", "user", "assistant")
#: Words that name a role before a colon or in a tag.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a", "gpt", "agent", "response"),
}
_ROLE_OF = {w: r for r, ws in NAMES.items() for w in ws}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|>\s*|\*\*|<\|?(?:im_start\|>)?|\[)?\s*([^\W\d_][\w .'-]{0,30}?)\s*(?:\*\*\s*:|:\s*\*\*|\|?>|\]\s*:?|:)(?:\s+|$)")
END_TAG = re.compile(r"\s*(?:<\|(?:end|im_end|eot_id)\|>|</s>)\s*$")

#: Markers: none, one of each role, first and second name.
NONE, SYSTEM, USER, ASSISTANT, FIRST, SECOND = range(6)


def _log(rows):
    p = np.array(rows, float)
    return np.log(p / p.sum(axis=-1, keepdims=True))


#: States: system, user, assistant beginning a turn, then the same continuing it.
START = _log([15, 80, 5, 1e-6, 1e-6, 1e-6])
STEP = _log([
    [2, 30, 4, 64, 1e-6, 1e-6], [1, 4, 35, 1e-6, 60, 1e-6], [1, 31, 4, 1e-6, 1e-6, 64],
    [2, 30, 4, 64, 1e-6, 1e-6], [1, 4, 35, 1e-6, 60, 1e-6], [1, 31, 4, 1e-6, 1e-6, 64],
])
BY_MARKER = _log([
    [6, 90, 0.3, 0.3, 1, 1], [8, 0.3, 80, 0.3, 10, 1.4], [8, 0.3, 0.3, 80, 1.4, 10],
    [97.5, 0.02, 0.02, 0.02, 0.5, 0.5], [97.5, 0.02, 0.02, 0.02, 0.5, 0.5], [97.5, 0.02, 0.02, 0.02, 0.5, 0.5],
])
BY_BLANK = _log([[5, 5], [6, 4], [6, 4], [8, 2], [8, 2], [8, 2]])
BY_ASKS = _log([[19, 1], [10, 10], [17, 3], [19, 1], [15, 5], [18, 2]])
#: What a state loses at a line with another role's marker, with a role's marker if it begins no turn, or with neither marker nor blank line if it does.
CERTAIN = 1e6
#: Lengths: below each of these numbers of characters, and the rest.
LENGTHS = (60, 200, 600)
BY_LENGTH = _log([[8, 6, 4, 2], [11, 5, 3, 1], [8, 6, 4, 2], [8, 6, 4, 2], [9, 6, 4, 1], [8, 6, 4, 2]])


class Model(NamedTuple):
    """Log probabilities: of the first state, of the next state, and of what a state emits."""

    start: np.ndarray
    step: np.ndarray
    sign: np.ndarray
    asks: np.ndarray
    length: np.ndarray


#: A sign is a marker and whether a blank line lies before: 2 * marker + blank.
BY_SIGN = (BY_MARKER[:, :, None] + BY_BLANK[:, None, :]).reshape(6, 12)
PRIOR = Model(START, STEP, BY_SIGN, BY_ASKS, BY_LENGTH)


def lines_of(text: str, name: str | None = None, before: bool | None = None) -> tuple:
    """((line, line without its marker), marker, blank line before, features) of the lines that are not blank; first name; blank line at the end.

    name: the first name so far. before: whether a blank line ends what came before, null where
    nothing did, which counts as a blank line.
    """
    contents, markers, blanks, features, names, blank = [], [], [], [], {name: 0} if name else {}, before in (None, True)
    for line in text.split("\n"):
        line = END_TAG.sub("", line.rstrip())
        if not line.strip():
            blank = True
            continue
        kind, m, bare = NONE, MARKER.match(line), line
        if m:
            word = m[1].lower()
            role = _ROLE_OF.get(word)
            if role:
                kind = 1 + ROLES.index(role)
            elif m[1][0].isupper() and len(m[1].split()) <= 3:
                kind = FIRST + min(1, names.setdefault(word, len(names)))
            if kind != NONE:
                bare = line[m.end() :]
        contents.append((line, bare))
        markers.append(kind)
        blanks.append(blank)
        features.append((bare.endswith("?"), sum(len(bare) >= n for n in LENGTHS)))
        blank = False
    return contents, markers, blanks, features, next(iter(names), None), blank


def emissions(every: list[tuple], model: Model = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores of the lines of each lines_of(), and their row offsets."""
    rows = np.concatenate(([0], np.cumsum([len(e[0]) for e in every]))).astype(np.int64)
    marker = np.concatenate([np.array(e[1], int) for e in every])
    blank = np.concatenate([np.array(e[2], int) for e in every])
    asks, length = np.concatenate([np.array(e[3], int).reshape(-1, 2) for e in every]).T
    score = model.sign.T[2 * marker + blank] + model.asks.T[asks] + model.length.T[length]
    # A role's marker is taken at its word, however many lines speak for another role.
    told = (marker >= SYSTEM) & (marker <= ASSISTANT)
    score[told[:, None] & (np.arange(6) != marker[:, None] - 1)] -= CERTAIN
    # Without a marker and a blank line nothing begins.
    score[(marker == NONE) & (blank == 0), :3] -= CERTAIN
    return score, rows


def viterbi(emission: np.ndarray, rows: np.ndarray, model: Model = PRIOR) -> np.ndarray:
    """Most likely state of each line; rows: offsets of the transcripts."""
    length = np.diff(rows)
    order = np.argsort(-length, kind="stable")
    starts, length = rows[:-1][order], length[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, most + 1), "right")
    back, best = np.zeros((len(emission), 6), np.int8), np.zeros((len(starts), 6))
    state = np.zeros(len(emission), np.int64)
    for t in range(most):
        n = active[t]
        i = starts[:n] + t
        if t:
            both = best[:n, :, None] + model.step[None]
            back[i] = both.argmax(axis=1)
            best[:n] = both.max(axis=1) + emission[i]
        else:
            best[:n] = model.start + emission[i]
    now = best.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        n = active[t]
        i = starts[:n] + t
        state[i] = now[:n]
        now[:n] = back[i, now[:n]]
    return state


def parse(texts: list[str | None], model: Model = PRIOR) -> list[list[tuple[str, str]]]:
    """Turns (role, content) of each transcript."""
    every = [lines_of(t or "") for t in texts]
    if not any(e[0] for e in every):
        return [[] for _ in texts]
    emission, rows = emissions(every, model)
    state = viterbi(emission, rows, model)
    out = []
    for e, a, b in zip(every, rows[:-1], rows[1:], strict=True):
        turns: list[tuple[str, list[str]]] = []
        for content, s, gap in zip(e[0], state[a:b].tolist(), e[2], strict=True):
            role = ROLES[s % 3]
            if s < 3 or not turns:
                turns.append((role, [content[1]]))
            else:
                turns[-1][1].append("\n" * gap + content[0])
        out.append([(r, "\n".join(c).strip()) for r, c in turns])
    return out


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{c}\n<|end|>\n" for r, c in turns)


def _written(turns: list[tuple[int, str]], style: int, salt: int) -> tuple[list[str], list[str]]:
    """(markers, gaps after) of turns (role number, text) in one of four styles."""
    if style == 0:  # role markers
        return [f"{ROLES[r].capitalize()}: " for r, _ in turns], ["\n"] * len(turns)
    if style == 1:  # names
        return [f"{('Narrator', 'Ann', 'Bob')[r]}: " for r, _ in turns], ["\n"] * len(turns)
    if style == 2:  # nothing but blank lines
        return [""] * len(turns), ["\n\n"] * len(turns)
    some = [zlib.crc32(b"%d/%d" % (salt, i)) % 10 < 7 for i in range(len(turns))]  # seven of ten turns marked
    return [f"{ROLES[r].capitalize()}: " if k else "" for k, (r, _) in zip(some, turns, strict=True)], ["\n\n"] * len(turns)


def written(turns: list[tuple[int, str]], style: int, salt: int) -> tuple[str, list[int]]:
    """A transcript of turns (role number, text), and the true state of each of its lines."""
    text, states = "", []
    for (role, own), marker, gap in zip(turns, *_written(turns, style, salt), strict=True):
        lines = [x for x in (marker + own).split("\n") if END_TAG.sub("", x.rstrip()).strip()]
        states += [role] + [role + 3] * (len(lines) - 1) if lines else []
        text += marker + own + gap
    return text, states


def counts(turns: list[tuple[int, str]], salt: int) -> np.ndarray:
    """What the lines of a conversation do in all styles: the tables of a Model, flat, as counts."""
    tables = [np.zeros(t.shape) for t in PRIOR]
    for style in range(4):
        text, states = written(turns, style, salt)
        _, markers, blanks, features, _, _ = lines_of(text)
        if not states:
            continue
        at = np.array(states)
        tables[0][at[0]] += 1
        np.add.at(tables[1], (at[:-1], at[1:]), 1)
        asks, length = np.array(features, int).T
        signs = 2 * np.array(markers) + np.array(blanks, int)
        for table, value in zip(tables[2:], (signs, asks, length), strict=True):
            np.add.at(table, (at, value), 1)
    return np.concatenate([t.ravel() for t in tables])


def fit(conversations: DataFrame, most: int = MAX_FIT) -> Model:
    """The tables counted on at most `most` conversations; turns without text or with another role are left out."""

    def run(batches):
        total = np.zeros(sum(t.size for t in PRIOR))
        for b in batches:
            for salt, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += counts([(ROLES.index(t["role"]), t["text"]) for t in turns], salt)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "n"])

    known = conversations.select("conv_id", "turn", F.lower(F.trim("role")).alias("role"), F.col("text").cast("string")).where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & (F.trim("text") != ""))
    wanted = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(most)
    # A long conversation is counted segment by segment: the states between two segments do not count.
    own = known.join(F.broadcast(wanted), "conv_id").groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    arrow_rows(conversations.sparkSession, 500)
    found = own.select(F.abs(F.xxhash64("conv_id") % 1_000_003).alias("salt"), "turns").mapInArrow(lean(run), "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(sum(t.size for t in PRIOR))
    for r in found:
        total[r["i"]] = r["n"]
    if not total.any():
        return PRIOR
    tables, at = [], 0
    for prior in PRIOR:
        tables.append(total[at : at + prior.size].reshape(prior.shape) + STRENGTH * np.exp(prior))
        at += prior.size
    return Model(*map(_log, tables))


def format_chats(transcripts: DataFrame, text: str = "transcript", model: Model = PRIOR) -> DataFrame:
    """Adds n_turns, roles, contents and rendered to rows that hold a transcript each."""
    added = ("n_turns", "roles", "contents", "rendered")
    names = [c for c in transcripts.columns if c.lower() not in added]
    at = names.index(text)

    def run(batches):
        for b in batches:
            for start, part in tx.chunks(b.column(at)):
                turns = parse(part.to_pylist(), model)
                cols = [pa.array([len(t) for t in turns], pa.int32()), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([[c for _, c in t] for t in turns], pa.list_(pa.string())), pa.array([render(t) for t in turns], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(part)) for c in b.columns), *cols], [*names, *added])

    arrow_rows(transcripts.sparkSession, 2000)
    rows = transcripts.select(*names).withColumn(text, F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), schema + ", n_turns int, roles array<string>, contents array<string>, rendered string")


def transcripts(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, transcript: one marked line group per turn, in turn order; turns without a role follow a blank line."""
    role = F.trim(F.col("role"))
    line = F.concat(F.when(F.length(role) > 0, F.concat(F.initcap(role), F.lit(": "))).otherwise(F.lit("\n")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.xxhash64("turn", "role", "text"))
    rows = conversations.select("conv_id", F.floor(F.col("turn") / segment).alias("segment"), alone.alias("alone"), F.struct("turn", "role", line.alias("line")).alias("row"))
    rows = rows.groupBy("conv_id", "segment", "alone").agg(F.array_join(F.transform(F.sort_array(F.collect_set("row")), lambda r: r["line"]), "\n").alias("transcript"))
    return rows.drop("alone")


def path_scores(emission: np.ndarray, model: Model = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """(7 x 6) best scores from START or a state before the lines to each state of the last line, and the first line's state on that path."""
    best = np.concatenate((model.start[None], model.step)) + emission[0]
    first = np.tile(np.arange(6), (7, 1))
    for e in emission[1:]:
        both = best[:, :, None] + model.step[None]
        arg = both.argmax(axis=1)
        best = both.max(axis=1) + e
        first = np.take_along_axis(first, arg, axis=1)
    return best, first


def _names_fold(table: pa.Table) -> pa.Table:
    """For each segment of a conversation: the first name so far, and whether a blank line ends what came before."""
    name, before, out = None, None, []
    for r in table.sort_by("segment").to_pylist():
        out.append({"id": r["id"], "part": r["segment"], "name": name, "before": before})
        name = name or r["own"]
        if r["lines"]:
            before = r["blank"]
        elif before is not None:
            before = True
    return pa.Table.from_pylist(out, pa.schema([("id", pa.string()), ("part", pa.int64()), ("name", pa.string()), ("before", pa.bool_())]))


def _path_fold(table: pa.Table) -> pa.Table:
    """For each segment with lines: its first and last state on the conversation's best path, whether it goes on in the next, and whether it continues an empty turn."""
    rows = table.sort_by("segment").to_pylist()
    best = [np.array(r["best"]).reshape(7, 6) for r in rows]
    first = [np.array(r["first"]).reshape(7, 6) for r in rows]
    score = [best[0][0]]
    for b in best[1:]:
        score.append((score[-1][:, None] + b[1:]).max(axis=0))
    last, out, on = int(score[-1].argmax()), [], False
    for k in range(len(rows) - 1, -1, -1):
        came = int((score[k - 1] + best[k][1:, last]).argmax()) if k else -1
        start = int(first[k][came + 1, last])
        follows = k > 0 and start >= 3
        out.append({"id": rows[k]["id"], "part": rows[k]["segment"], "start": start, "stop": last, "follows": follows, "on": on, "bare": follows and came < 3 and rows[k - 1]["empty"]})
        last, on = came, follows
    return pa.Table.from_pylist(out, pa.schema([("id", pa.string()), ("part", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("follows", pa.bool_()), ("on", pa.bool_()), ("bare", pa.bool_())]))


def _piece(e: tuple, state: list[int], follows: bool, on: bool, bare: bool) -> tuple[int, str, str]:
    """(turns that begin, their roles, rendering) of a segment."""
    turns, head = [], []
    for content, s, gap in zip(e[0], state, e[2], strict=True):
        if s < 3 or not (turns or follows):
            turns.append((ROLES[s % 3], [content[1]]))
        else:
            (turns[-1][1] if turns else head).append("\n" * gap + content[0])
    text = "\n".join(head)
    close = "\n<|end|>\n"
    pieces = ([text.lstrip() if bare else "\n" + text] if follows else []) + [f"<|{r}|>\n" + "\n".join(c).strip() for r, c in turns]
    return len(turns), ",".join(r for r, _ in turns), close.join(pieces) + ("" if on else close)


def _lines(b) -> list[tuple]:
    return [lines_of(t or "", n, x) for t, n, x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]


def format_long(rows: DataFrame, scratch: Scratch, segment: int = SEGMENT, model: Model = PRIOR) -> DataFrame:
    """conv_id, segment, n_turns, roles and rendered of conversations of several segments; turn is not null."""
    parts = scratch.put(transcripts(rows, segment).select(F.col("conv_id").cast("string").alias("id"), F.col("segment").cast("long").alias("part"), "transcript"), "parts")

    def names(batches):
        for b in batches:
            every = [lines_of(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e[4] for e in every], pa.string()), pa.array([bool(e[0]) for e in every]), pa.array([e[5] for e in every])], ["id", "segment", "own", "lines", "blank"])

    def paths(batches):
        for b in batches:
            ids, at, best, first, empty = [], [], [], [], []
            for i, k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _lines(b), strict=True):
                if e[0]:
                    x, y = path_scores(emissions([e], model)[0], model)
                    ids.append(i), at.append(k), best.append(x.ravel().tolist()), first.append(y.ravel().tolist()), empty.append(not e[0][-1][1].strip())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array(first, pa.list_(pa.int32())), pa.array(empty, pa.bool_())], ["id", "segment", "best", "first", "empty"])

    def pieces(batches):
        for b in batches:
            out = []
            for e, start, stop, *flags in zip(_lines(b), *(b.column(k).to_pylist() for k in range(5, 10)), strict=True):
                if not e[0]:
                    out.append((0, "", ""))
                    continue
                emission, at = emissions([e], model)
                emission[0, np.arange(6) != start] = -np.inf
                emission[-1, np.arange(6) != stop] = -np.inf
                out.append(_piece(e, viterbi(emission, at, model).tolist(), *flags))
            n, roles, rendered = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(roles, pa.string()), pa.array(rendered, pa.string())], ["conv_id", "segment", "n_turns", "roles", "rendered"])

    arrow_rows(rows.sparkSession, 2000)
    known = parts.mapInArrow(lean(names), "id string, segment long, own string, lines boolean, blank boolean").groupBy("id").applyInArrow(_names_fold, "id string, part long, name string, before boolean")
    named = scratch.put(parts.join(known, ["id", "part"]).select("id", "part", "transcript", "name", "before"), "named")
    found = named.mapInArrow(lean(paths), "id string, segment long, best array<double>, first array<int>, empty boolean").groupBy("id").applyInArrow(_path_fold, "id string, part long, start int, stop int, follows boolean, on boolean, bare boolean")
    whole = scratch.put(named.join(found, ["id", "part"], "left").select("id", "part", "transcript", "name", "before", "start", "stop", "follows", "on", "bare"), "whole")
    return whole.mapInArrow(lean(pieces), "conv_id string, segment long, n_turns int, roles string, rendered string")


def format_conversations(conversations: DataFrame, segment: int = SEGMENT, model: Model = PRIOR) -> DataFrame:
    """conv_id, segment, n_turns, roles and rendered; segments of a conversation are parts of one rendering."""
    scratch = Scratch(conversations.sparkSession)
    at = F.floor(F.col("turn") / segment)
    ids = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x < y")
    ids = scratch.put(ids.select("conv_id", F.lit(True).alias("several")), "several")
    n = ids.count()
    marked = conversations.join(F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids, "conv_id", "left")
    out = format_chats(transcripts(marked.where("several is null or turn is null"), segment), model=model).select("conv_id", "segment", "n_turns", F.array_join("roles", ",").alias("roles"), "rendered")
    if not n:
        return out
    return out.unionByName(format_long(marked.where("several and turn is not null"), scratch, segment, model).withColumn("conv_id", F.col("conv_id").cast(out.schema["conv_id"].dataType)))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_conversations(conversations, model=fit(conversations))
