"""Near-duplicate embeddings by E8 lattice hashing (operator 10).

Every table projects unit vectors to eight dimensions at random and decodes them to the
nearest point of the E8 lattice, the home cell. A vector also probes the neighbouring cells
nearest to its projection. Vectors of one label meet in a cell that is the home of at least
one of them; the cosine of every such pair is computed in double precision. A pair that meets
more than once counts where it meets first, which each side can tell from the two vectors.

Equal vectors of one label are one point with a count. Cells with many points are split into
pairs of blocks, so a task never holds more than two blocks of a cell; it sends on how many
links each point has and a spanning forest of them, never the pairs.

Scale, tables and probes follow the size of the largest label: plan() simulates how often a
pair at the threshold meets in one table and how often two unlike vectors share a cell, takes as
many tables as the wanted recall needs, and chooses the cheapest setting. So cells get finer as
labels grow, and the work grows less than the square of a label. Recall at the threshold itself
is about RECALL, and rises with the cosine; tests measure it against brute force.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing and are their own component. A row without vec_id links
with nothing and has a null component. Rows of one vec_id are one vector, which does not link
with itself. Only vectors of one length are compared.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from palaver.llm import text as tx
from palaver.llm.shared import Scratch, arrow_rows, components, lean, spanning

COSINE, RECALL = 0.93, 0.999
#: Settings that plan() chooses from, and what a meeting of two vectors costs beside a key.
SCALES, PROBES, MEETING_COST = (0.8, 1.0, 1.2, 1.4, 1.7, 2.0), (4, 12, 24), 0.5
#: Points of a cell that one task compares with as many others.
BLOCK = 512
U64 = np.uint64

#: The 240 shortest vectors of the lattice.
SHORTEST = np.array(
    [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    + [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0],
    float,
)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    i = np.flatnonzero(r.sum(axis=1) % 2)
    off = x[i] - r[i]
    k = np.abs(off).argmax(axis=1)
    r[i, k] += np.where(off[np.arange(len(i)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: integers with even sum, or the same moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Setting(NamedTuple):
    tables: int
    probes: int
    scale: float


@lru_cache(maxsize=None)
def simulated(cosine: float, scale: float, pairs: int = 1500) -> tuple[float, tuple[float, ...]]:
    """Share of a random vector's fellows in its cell, and for each of PROBES how likely a pair at the cosine meets in a table.

    Projections of unit vectors are Gaussian with the cosine as correlation, in any dimension.
    """
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(pairs, 8)) * scale
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * rng.normal(size=(pairs, 8)) * scale
    hx, hy = decode(x), decode(y)
    rank = lambda v, h, other: _rank(v - h, np.rint((other - h) * 2))
    first = np.minimum(rank(x, hx, hy), rank(y, hy, hx))
    _, n = np.unique(np.rint(decode(rng.normal(size=(4 * pairs, 8)) * scale) * 2), axis=0, return_counts=True)
    share = max(float((n * (n - 1)).sum()), 1.0) / (4 * pairs * (4 * pairs - 1))
    return share, tuple(float((first < p).mean()) for p in PROBES)


def _rank(off: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """At which place a cell, given by twice its distance from home, is probed; -1 at home, far beyond if never."""
    order = np.argsort(-(off @ SHORTEST.T), axis=1, kind="stable")
    steps = {tuple(v): k for k, v in enumerate(np.rint(SHORTEST * 2).astype(int).tolist())}
    which = [steps.get(tuple(t), -1) for t in twice.astype(int).tolist()]
    out = np.full(len(off), 10**6)
    for i, w in enumerate(which):
        if not twice[i].any():
            out[i] = -1
        elif w >= 0:
            out[i] = int(np.flatnonzero(order[i] == w)[0])
    return out


def plan(largest: int, cosine: float = COSINE, recall: float = RECALL) -> Setting:
    """The cheapest setting that reaches the recall for labels of up to `largest` different vectors."""
    best = None
    for scale in SCALES:
        share, chances = simulated(cosine, scale)
        for probes, p in zip(PROBES, chances, strict=True):
            if p > 0:
                tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(p, 1 - 1e-9))))
                cost = tables * (1 + probes) * (1 + MEETING_COST * largest * share)
                if best is None or cost < best[0]:
                    best = cost, Setting(tables, probes, scale)
    return best[1]


def projection(table: int, dim: int, scale: float = 1.0) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([11, table, dim])).normal(size=(dim, 8)) * scale


def _hash(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    h = np.full(points.shape[:-1], U64(table * 1_000_003 + dim))
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    for k in range(8):
        h = tx.mix(h * U64(0x9E3779B97F4A7C15) + twice[..., k])
    return h


def cells(unit: np.ndarray, table: int, probes: int, scale: float) -> np.ndarray:
    """Per row: the home cell's hash, then those of the probed cells."""
    x = unit @ projection(table, unit.shape[1], scale)
    home = decode(x)
    near = np.argsort(-((x - home) @ SHORTEST.T), axis=1, kind="stable")[:, :probes]
    return _hash(np.concatenate((home[:, None], home[:, None] + SHORTEST[near]), axis=1), table, unit.shape[1])


def normed(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _points(vectors: DataFrame) -> DataFrame:
    """Sound vectors, in their own precision: single precision halves what is shuffled, and cosines are taken in double."""
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    sound &= ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v if kind in ("array<float>", "array<double>") else v.cast("array<double>"), "label").where(sound).distinct()
    return rows


def _keys(points: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """One row per point, table and cell, at home or probed; the vectors stay behind."""

    def run(batches):
        for b in batches:
            lengths = pc.list_value_length(b.column(1)).to_numpy()
            labels = b.column(2).to_numpy().view(np.uint64)
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                unit = normed(_matrix(b.column(1).take(pa.array(own)), int(dim)))
                point = b.column(0).take(pa.array(np.repeat(own, probes + 1)))
                for t in range(tables):
                    key = tx.mix(cells(unit, t, probes, scale) + tx.mix(labels[own])[:, None]).view(np.int64)
                    home = np.zeros(key.shape, bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(home.ravel()), pa.array(np.full(key.size, t, np.int32)), point], ["cell", "home", "t", "point"])

    return points.select("point", "embedding", "label_key").mapInArrow(lean(run), "cell long, home boolean, t int, point long")


def _compare(cosine: float, probes: int, scale: float):
    """Kernel over rows sorted by cell and block pair."""

    def group(key, home, table, node, n, side, label, unit):
        """Counts and spanning links of a slice of whole groups of one vector length."""
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        start, length = np.repeat(first, size), np.repeat(size, size)
        at, out = np.flatnonzero(home), []
        ends, lo = np.cumsum(length[at]), 0
        while lo < len(at):  # every home row meets the rows of its group, a slice of pairs at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 60_000, "right")))
            own = at[lo:hi]
            a = np.repeat(own, length[own])
            b = start[a] + np.arange(len(a)) - np.repeat(np.cumsum(length[own]) - length[own], length[own])
            ok = (node[a] != node[b]) & (~home[b] | (a < b)) & ((side[a] == 0) | (side[a] != side[b])) & (label[a] == label[b])
            a, b = a[ok], b[ok]
            ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            out.append((a[ok], b[ok]))
            lo = hi
        a, b = (np.concatenate([p[k] for p in out] or [at[:0]]) for k in (0, 1))
        if not len(a):
            return None
        here, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = inverse[: len(a)], inverse[len(a) :]
        keep, most = np.ones(len(a), bool), int(table[a].max())
        for t in range(most + 1):
            c = cells(unit[here], t, probes, scale)
            for cut in range(0, len(a), 100_000):
                p = slice(cut, cut + 100_000)
                hx, hy = c[x[p], 0], c[y[p], 0]
                x_at_y = (c[x[p], 1:] == hy[:, None]).any(axis=1)
                y_at_x = (c[y[p], 1:] == hx[:, None]).any(axis=1)
                met = (hx == hy) | x_at_y | y_at_x
                now = table[a[p]] == t
                # a is at home here; with b only probing, both may also have met at b's home.
                keep[p] &= np.where(now, home[b[p]] | (node[a[p]] < node[b[p]]) | ~x_at_y, (table[a[p]] < t) | ~met)
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        found, inverse = np.unique(np.concatenate((node[a], node[b])), return_inverse=True)
        links = np.bincount(inverse, np.concatenate((n[b], n[a]))).astype(np.int64)
        return found, links, spanning(node[a], node[b])

    def run(batches):
        held = None
        for batch in itertools.chain(batches, (None,)):
            if batch is not None and held is not None:
                batch = pa.concat_batches([held, batch])
            final = batch is None
            batch = held if final else batch
            held = None
            if batch is None or not batch.num_rows:
                continue
            cell, i, j = (batch.column(k).to_numpy() for k in (0, 1, 2))
            change = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            number = np.concatenate((np.zeros(1, np.int64), np.cumsum(change)))
            last = batch.num_rows
            if not final:  # the last group may go on in the next batch
                last = int(np.searchsorted(number, number[-1]))
                held = batch.slice(last)
            if not last:
                continue
            part = batch.slice(0, last)
            dims = pc.list_value_length(part.column(9)).to_numpy()
            columns = [part.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6, 7, 8)]
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                got = group(number[own], *(c[own] for c in columns), normed(_matrix(part.column(9).take(pa.array(own)), int(d))))
                if got:
                    ids, links, pairs = got
                    a, b = [p[0] for p in pairs] + ids.tolist(), [p[1] for p in pairs] + [None] * len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(pairs) + links.tolist(), pa.int64())], ["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, setting: Setting | None = None, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    setting: tables, probes and scale; by default plan() chooses them for the recall.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    arrow_rows(spark, 4000)
    rows = scratch.put(_points(vectors), "rows")
    points = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    points = scratch.put(points.withColumns({"label_key": F.xxhash64("label"), "point": F.monotonically_increasing_id()}), "points")
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, probes, scale = setting or plan(largest, cosine, recall)
    keys = scratch.put(_keys(points, tables, probes, scale), "keys")
    many = keys.select("cell", "home").groupBy("cell").agg(F.count("*").alias("c"), F.max("home").alias("h")).where("h and c > 1")
    many = scratch.put(many.select("cell", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "cells")
    # Only what shares a cell with another point gets its vector.
    met = keys.join(many, "cell").join(points.select("point", "node", "n", "label_key", "embedding"), "point")
    met = met.withColumn("own", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # In a pair of two blocks, links inside either block are left to that block's own pair.
    met = met.withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
    met = met.select("cell", "i", "j", "home", "t", "node", "n", "side", "label_key", "embedding")
    dealt = met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = scratch.put(dealt.mapInArrow(lean(_compare(cosine, probes, scale)), "a long, b long, links long"), "found")
    scratch.drop("keys", "cells")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(scratch, found.where("b is not null")).withColumnRenamed("label", "component")
    # Nodes are the smallest vec_id of equal vectors, so one id may stand for several labels' points.
    linked = points.join(counts, "node", "left").join(labels, "node", "left")
    linked = scratch.put(linked.select("label", "embedding", F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("component", "node").alias("first")), "linked")
    each = rows.join(linked, ["label", "embedding"]).groupBy("vec_id").agg(F.sum(F.col("links") + F.col("n") - 1).alias("n_links"), F.min("first").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(each, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: All pairs of a label, and components by following links; for small tables.
SQL = f"""
with recursive u as (
  select vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null),
links as (
  select a.vec_id as s, b.vec_id as d from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(s, d) as (select s, d from links union select r.s, l.d from reach r join links l on r.d = l.s),
low as (select s, min(least(s, d)) as m from reach group by s),
n as (select s, count(*) as n from links group by s)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(low.m, e.vec_id) as component_id, e.vec_id = coalesce(low.m, e.vec_id) as kept
from embeddings e left join low on low.s = e.vec_id left join n on n.s = e.vec_id
"""
