"""Near-duplicate documents by ProbMinHash, banding and verification (operator 6).

A document is the multiset of its five-word shingles; a shingle's weight is how often it
occurs. Its signature is banded once with these weights and, where a shingle repeats, once more
with all weights 1. Each shingle sends a Poisson process of arrivals with its weight as rate, each
arrival to one of the signature's registers; a register keeps the shingle that came first.
Two registers agree with the probability Jaccard similarity of the two documents, which with
weights of 1 is the plain Jaccard similarity, whatever repeats how often. A document
stops as soon as all its registers are filled and no later arrival can be earlier.

Documents with equal words are one text from then on. Texts that share a band are candidates;
a pair is a link if the Jaccard similarity of its shingle sets, counted from the whole texts,
is at least the threshold. Within a bucket, pairs are not all written out: every round each
text of a bucket is compared with a pivot, classes are joined, and buckets of one class are
done. What pivots leave open is compared pair by pair inside tasks, a large bucket in pairs of
blocks, so no link between texts of a bucket is lost; tasks send on spanning links only. The
classes are the connected components of the links.

Nulls and empties: a text without a word (null and empty ones too) links with nothing; its
class is its own doc_id. A row without doc_id is compared with nothing and has a null class.
Rows that share a doc_id are one document with several texts. A text of fewer than five
words is one shingle.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from palaver.llm import text as tx
from palaver.llm.shared import Scratch, arrow_rows, components, lean, spanning

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Rounds of pivots before the rest is compared pair by pair.
PIVOTS = 2
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Ids of candidate texts that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_LOW = U64(0xFFFFFFFF)


def weighted(shingles: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight) of the distinct shingles of each row, elements of 44 bits."""
    keys = (np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows)) << U64(44)) | (shingles >> U64(20))
    keys.sort()
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    weight = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> U64(44)).astype(np.int64), keys & U64((1 << 44) - 1), weight


def probminhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int, seed: int = 1) -> np.ndarray:
    """Signatures (n x registers, uint32) of n rows; rows without elements stay all ones.

    Arrivals are made in blocks up to a time limit for each row, which is doubled for rows
    with an empty register; with all filled, arrivals beyond the limit cannot matter.
    """
    first = np.full(n * registers, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(row, weight, n)
    limit = registers * (math.log(registers) + 1.5) / np.maximum(total, 1)
    key = tx.mix(element ^ tx.mix(np.array([seed], np.uint64)))
    rate = weight.astype(float)
    t, j = np.zeros(len(row)), np.zeros(len(row), np.uint64)
    todo = np.arange(len(row))
    while len(todo):
        active = todo
        while len(active):
            block = int(min(256, max(1, 120_000 // len(active), 0)))
            step = np.arange(1, block + 1, dtype=np.uint64)
            x = tx.mix(key[active, None] + (j[active, None] + step) * _GOLDEN)
            gap = -np.log(((x >> U64(32)).astype(float) + 0.5) * 2.0**-32) / rate[active, None]
            at = np.cumsum(gap, axis=1) + t[active, None]
            own = row[active]
            ok = at <= limit[own, None]
            hit = np.nonzero(ok)
            a = active[hit[0]]
            register = ((x[hit] & _LOW) * U64(registers)) >> U64(32)
            packed = (at[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << U64(32)) | (key[a] & _LOW)
            np.minimum.at(first, row[a] * registers + register.astype(np.int64), packed)
            done = ok.sum(axis=1)
            some = done > 0
            t[active[some]] = at[some, done[some] - 1]
            j[active] += done.astype(np.uint64)
            active = active[done == block]
        empty = (first.reshape(n, registers) == np.iinfo(np.uint64).max).any(axis=1)
        limit[empty] *= 2
        todo = np.flatnonzero(empty[row])
    return (first & _LOW).astype(np.uint32).reshape(n, registers)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signatures[:, : bands * rows].astype(np.uint64).reshape(len(signatures), bands, rows)
    out = np.tile(np.arange(bands, dtype=np.uint64) + U64(1), (len(s), 1))
    for k in range(rows):
        out = tx.mix(out * _GOLDEN + s[:, :, k])
    return out


def _fingerprints(hashes: np.ndarray, rows: np.ndarray) -> list:
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(rows[:-1], rows[1:], strict=True)]


def sign(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, print (of the words; null without words), shingles (distinct), bands (array of hashes)."""

    def run(batches):
        for b in batches:
            for at, part in tx.chunks(b.column(1)):
                hashes, at_rows, _, _ = tx.words(tx.plain(part))
                shingles, at_shingles = tx.shingles(hashes, at_rows, words)
                row, element, weight = weighted(shingles, at_shingles)
                n = len(part)
                keys = band_hashes(probminhash(row, element, weight, n, bands * rows), bands, rows).view(np.int64)
                # Where no shingle repeats, the signature of weights 1 is the same one.
                again = np.flatnonzero(np.bincount(row, weight > 1, n))
                own = np.isin(row, again)
                plain = band_hashes(probminhash(np.searchsorted(again, row[own]), element[own], np.ones(own.sum(), np.int64), len(again), bands * rows), bands, rows).view(np.int64)
                both = np.concatenate((keys, keys), axis=1)
                both[again, bands:] = plain
                new = np.concatenate((np.ones((n, bands), bool), both[:, bands:] != keys), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(new.sum(axis=1)))), pa.int32()), pa.array(both[new]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array(_fingerprints(hashes, at_rows), pa.binary()), pa.array(np.bincount(row, minlength=n)), lists],
                    ["doc_id", "print", "shingles", "bands"],
                )

    arrow_rows(docs.sparkSession, 2000)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(lean(run), "doc_id long, print binary, shingles long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of documents, with prints pa and pb, whose shingle sets are similar enough.

    texts: doc_id, text. Rows of a document whose words have another print are passed over.
    """

    def run(batches):
        for b in batches:
            cols = {k: b.column(i) for i, k in enumerate(("a", "b", "pa", "pb", "ta", "tb"))}
            size = pc.add(pc.binary_length(cols["ta"]), pc.binary_length(cols["tb"])).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                part = {k: v.slice(at, to - at) for k, v in cols.items()}
                sets, same = [], np.ones(to - at, bool)
                for side in "ab":
                    hashes, rows, _, _ = tx.words(tx.plain(part[f"t{side}"]))
                    same &= np.array([x == y for x, y in zip(_fingerprints(hashes, rows), part[f"p{side}"].to_pylist(), strict=True)])
                    row, element, _ = weighted(*tx.shingles(hashes, rows, words))
                    sets.append((row.astype(np.uint64) << U64(44)) | element)
                both = np.sort(np.concatenate(sets))
                shared = np.bincount((both[1:][both[1:] == both[:-1]] >> U64(44)).astype(np.int64), minlength=to - at)
                union = sum(np.bincount((s >> U64(44)).astype(np.int64), minlength=to - at) for s in sets) - shared
                ok = np.flatnonzero(same & (shared >= similarity * union - 1e-9) & (union > 0))
                at = to
                if len(ok):
                    yield pa.RecordBatch.from_arrays([part["a"].take(pa.array(ok)), part["b"].take(pa.array(ok))], ["a", "b"])

    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb", "ta", "tb")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def set_rows(texts: DataFrame, words: int) -> DataFrame:
    """node, print and the sorted distinct shingles (elements, 8 bytes each) of doc_id, text."""

    def run(batches):
        for b in batches:
            for at, part in tx.chunks(b.column(1)):
                hashes, rows, _, _ = tx.words(tx.plain(part))
                row, element, _ = weighted(*tx.shingles(hashes, rows, words))
                cut = np.searchsorted(row, np.arange(len(part) + 1))
                sets = [element[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(_fingerprints(hashes, rows), pa.binary()), pa.array(sets, pa.binary())], ["node", "print", "elements"])

    return texts.mapInArrow(lean(run), "node long, print binary, elements binary")


def block_links(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members with different labels, not both of one block, whose sets are similar enough.

    Shared shingles of all pairs are counted at once, as products of slices of the incidence matrix.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    who = np.repeat(np.arange(m), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate((np.ones(1, bool), flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, who = (np.cumsum(common) - 1)[column[keep]], who[keep]
    shared = np.zeros((m, m), np.float32)
    step = 4096
    for c in range(0, int(common.sum()), step):
        lo, hi = np.searchsorted(column, (c, c + step))
        part = np.zeros((m, step), np.float32)
        part[who[lo:hi], column[lo:hi] - c] = 1
        shared += part @ part.T
    union = size[:, None] + size[None, :] - shared
    ok = (shared >= similarity * union - 1e-6) & (label[:, None] != label[None, :]) & ((side[:, None] == 0) | (side[:, None] != side[None, :]))
    return np.nonzero(np.triu(ok, 1))


def open_links(similarity: float):
    """Kernel over rows sorted by bucket and block pair: links that span what each group links."""

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
            bucket, i, j = (batch.column(k).to_numpy() for k in (0, 1, 2))
            change = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), change)))
            ends = np.append(first[1:], batch.num_rows)
            if not final:  # the last group may go on in the next batch
                held = batch.slice(int(first[-1]))
                first, ends = first[:-1], ends[:-1]
            side, node, label = (batch.column(k).to_numpy() for k in (3, 4, 5))
            elements, found = batch.column(6), []
            for lo, hi in zip(first.tolist(), ends.tolist(), strict=True):
                if (label[lo:hi] == label[lo]).all():
                    continue
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in elements.slice(lo, hi - lo)]
                x, y = block_links(label[lo:hi], side[lo:hi], sets, similarity)
                found += spanning(node[lo:hi][x], node[lo:hi][y])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found]), pa.array([max(p) for p in found])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id)."""
    signed, classes = text_classes(docs, words, similarity, bands, rows, pivots, block)
    out = signed.select("doc_id", "print").join(classes.select("print", "class_id"), "print", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def text_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id and print of each row; print, node and class_id of each different text).

    node: the smallest doc_id with the text; class_id: the smallest node of the text's class.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    signed = scratch.put(sign(docs, words, bands, rows), "signed")
    named = signed.where("print is not null and doc_id is not null")
    texts = scratch.put(named.groupBy("print").agg(F.min("doc_id").alias("node"), F.min("shingles").alias("shingles"), F.first("bands").alias("bands")), "texts")
    key = F.explode("bands").alias("bucket")
    shared = texts.select(key).groupBy("bucket").count().where("count > 1").select("bucket")
    members = scratch.put(texts.select("node", "print", "shingles", key).join(shared, "bucket"), "members")
    wanted = scratch.put(members.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sources = scratch.put(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi"), "sources")

    links, open_ = None, members.withColumn("label", F.col("node"))
    for k in range(pivots):
        order = F.struct((F.xxhash64("label", F.lit(k)) if k else F.col("node")).alias("turn"), "node", "print", "shingles", "label")
        pivot = open_.groupBy("bucket").agg(F.min(order).alias("p")).select("bucket", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "print", "shingles", "label")))
        met = open_.join(pivot, "bucket").where(f"label <> p_label and least(shingles, p_shingles) >= {similarity} * greatest(shingles, p_shingles) - 1e-9")
        swap = F.col("node") > F.col("p_node")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        pairs = met.select(pick("node", "p_node").alias("a"), pick("p_node", "node").alias("b"), pick("print", "p_print").alias("pa"), pick("p_print", "print").alias("pb")).distinct()
        new = scratch.put(verify(scratch.put(pairs, f"pairs{k}"), sources, words, similarity), f"new{k}")
        links = new if links is None else links.union(new)
        open_ = _unfinished(scratch, members, links, f"open{k}")
    # What pivots left open: every pair of a bucket whose labels differ, in pairs of blocks.
    counts = scratch.put(open_.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "counts")
    ids = scratch.put(open_.select(F.col("node").alias("doc_id"), "print").distinct(), "ids")
    sets = scratch.put(set_rows(sources.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), words).join(ids.withColumnRenamed("doc_id", "node"), ["node", "print"]).distinct(), "sets")
    dealt = open_.join(counts, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
    dealt = dealt.join(sets, ["node", "print"]).select("bucket", "i", "j", "side", "node", "label", "elements")
    arrow_rows(spark, 1000)
    rest = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lean(open_links(similarity)), "a long, b long")
    links = links.union(scratch.put(rest.distinct(), "rest"))
    scratch.drop("sources", "sets")
    labels = components(scratch, links)
    classes = texts.select("print", "node").join(labels, "node", "left").select("print", "node", F.coalesce("label", "node").alias("class_id"))
    return signed.select("doc_id", "print"), scratch.put(classes, "classes")


def _unfinished(scratch: Scratch, members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The members, with their labels so far, of buckets that hold more than one label."""
    found = Scratch(members.sparkSession)
    labelled = members.join(components(found, links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    out = scratch.put(labelled.join(mixed, "bucket"), name)
    found.drop("components")
    return out


def printed(docs: DataFrame) -> DataFrame:
    """docs with _print, the hash of a text's words that classes go by; null without words."""
    names = docs.columns
    at_text = names.index("text")

    def run(batches):
        for b in batches:
            prints = []
            for _, part in tx.chunks(b.column(at_text)):
                hashes, rows, _, _ = tx.words(tx.plain(part))
                prints += _fingerprints(hashes, rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.binary())], [*names, "_print"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("_print", T.BinaryType())]))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class; rows without doc_id all stay.

    What stays is a text of the class's first doc_id. Where rows share a doc_id, each is judged by
    its own text, so every class keeps one of its texts; of repeated rows one stays.
    """
    scratch = Scratch(docs.sparkSession)
    signed, classes = text_classes(docs.select("doc_id", "text"), **options)

    def small(ids: DataFrame, name: str) -> DataFrame:
        ids = scratch.put(ids, name)
        return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids

    named = signed.where("doc_id is not null")
    repeated = small(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    gone = small(named.join(classes, "print").where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    alone = docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    # Several texts may have the class's first doc_id: the one with the least hash stands for the class.
    chosen = classes.where("node = class_id").groupBy("class_id").agg(F.min("print").alias("_print"))
    shared = printed(docs.join(repeated, "doc_id", "left_semi").select(docs.columns))
    first = shared.groupBy(F.col("doc_id").alias("_id"), "_print").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    first = scratch.put(first, "first")
    first = first.where("_print is null").unionByName(first.join(chosen.select(F.col("class_id").alias("_id"), "_print"), ["_id", "_print"], "left_semi"))
    return alone.select(docs.columns).union(first.select("row.*").select(docs.columns))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
