"""Language identification by a mixture over each document's words (operator 8).

Each language is a distribution of byte 4-grams within words. A document's words are drawn
from its languages in unknown proportions; expectation-maximisation estimates these, and
languages whose removal costs less likelihood than the penalty for a further language are
dropped, smallest share first. The prediction is the remaining language of largest share, of
equals the first by name. With more than CANDIDATES languages, those of largest share after the
first rounds are the candidates from then on: a text has few languages, and the rest would be
dropped one by one.

At most MAX_TRAIN_DOCS documents of each language are learned from, those with the smallest
hash of doc_id, so rare languages are learned as well; equal texts among them count once. The
model is sent once to every executor: 256 kB for each language. Texts are judged whole, and each
by itself; a very long one takes the memory of one task.

Nulls: a null text, or one without a letter, is `und` with score 0; so is every text if there
is nothing to learn from. Rows with a null or empty language, or text, are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palaver.llm import text as tx
from palaver.llm.quality import fold
from palaver.llm.shared import Scratch, arrow_rows, lean

MAX_TRAIN_DOCS, CANDIDATES = 1500, 6
#: Ids of documents to learn from that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000
BUCKETS = 1 << 16
SMOOTHING = 0.3
ROUNDS, PENALTY = 10, 2.0
UNKNOWN = "und"

_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_ANY_LETTER = tx.regex.compile(r"\p{L}")
_SPACE = np.uint8(32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each 4-gram, its word's number, offsets of each text's words).

    A word's grams are those that end in it or at the space after it; what lies before the
    word counts as spaces, so neither neighbouring words nor neighbouring texts matter.
    """
    lowered = tx.plain(texts)
    data, offsets = tx.raw(lowered)
    n = len(texts)
    room = 4
    spaced = np.full(len(data) + room * (n + 1), _SPACE)
    shift = np.repeat(np.arange(1, n + 1) * room, np.diff(offsets))
    spaced[np.arange(len(data)) + shift] = np.where(_LETTER[data], data, _SPACE)
    b1 = spaced[3:]
    p1, p2, p3 = spaced[2:-1], spaced[1:-2], spaced[:-3]
    s2 = np.where(p1 == _SPACE, _SPACE, p2)
    s3 = np.where(s2 == _SPACE, _SPACE, p3)
    own = (b1 != _SPACE) | (p1 != _SPACE)
    code = b1.astype(np.uint32) | p1.astype(np.uint32) << np.uint32(8) | s2.astype(np.uint32) << np.uint32(16) | s3.astype(np.uint32) << np.uint32(24)
    first = (b1 != _SPACE) & (p1 == _SPACE)
    word = np.cumsum(first) - 1
    at = np.searchsorted(np.flatnonzero(first) + 3, offsets + room * np.arange(1, n + 2))
    bucket = (code[own] * np.uint32(2654435761)) >> np.uint32(32 - 16)
    return bucket.astype(np.int64), word[own], at


def letters(texts: pa.Array, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; texts of unusual characters are asked again, exactly."""
    found = np.diff(at) > 0
    data, offsets = tx.raw(tx.pc.fill_null(texts.cast(pa.string()), ""))
    odd = np.concatenate(([0], np.cumsum(data >= 128)))
    for i in np.flatnonzero(found & (odd[offsets[1:]] > odd[offsets[:-1]])):
        found[i] = bool(_ANY_LETTER.search(texts[int(i)].as_py()))
    return found


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x BUCKETS."""
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
        self.table = np.log((counts + SMOOTHING) / total).astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        bucket, word, at = grams(texts)
        n, langs = len(texts), len(self.languages)
        if not langs:
            return [UNKNOWN] * n, np.zeros(n)
        rows = np.flatnonzero(np.diff(at) > 0)
        name, score = [UNKNOWN] * n, np.zeros(n)
        if not len(rows):
            return name, score
        first = np.flatnonzero(np.diff(word, prepend=-1))
        each = np.stack([np.add.reduceat(t[bucket], first, dtype=np.float64) for t in self.table])
        starts = at[:-1][rows]
        share, single = self.mixture(each, starts, np.diff(np.append(starts, each.shape[1])))
        best = share.argmax(axis=0)
        alone = (share > 0).sum(axis=0) == 1
        sure = np.exp(single[best, np.arange(len(rows))] - np.logaddexp.reduce(single, axis=0))
        value = share[best, np.arange(len(rows))] * np.where(alone, sure, 1)
        ok = letters(texts, at)
        for r, b, v in zip(rows.tolist(), best.tolist(), value.tolist(), strict=True):
            if ok[r]:
                name[r], score[r] = self.languages[b], min(1.0, v)
        return name, score

    def mixture(self, each: np.ndarray, starts: np.ndarray, count: np.ndarray):
        """(share of each language per text, log likelihood of each language alone)."""
        single = np.add.reduceat(each, starts, axis=1)
        p = np.exp(each - each.max(axis=0))
        share = np.full((len(each), len(starts)), 1 / len(each))

        def em(share):
            joint = p * np.repeat(share, count, axis=1)
            joint /= joint.sum(axis=0)
            return np.add.reduceat(joint, starts, axis=1) / count

        def likelihood(share):
            return np.add.reduceat(np.log((p * np.repeat(share, count, axis=1)).sum(axis=0) + 1e-300), starts)

        for _ in range(ROUNDS):
            share = em(share)
        languages = len(share)
        if languages > CANDIDATES:
            some = np.sort(np.argsort(-share, axis=0, kind="stable")[:CANDIDATES], axis=0)
            p = np.take_along_axis(p, np.repeat(some, count, axis=1), axis=0)
            share = np.take_along_axis(share, some, axis=0)
            share /= share.sum(axis=0)
        column = np.arange(len(starts))
        for _ in range(len(share) - 1):
            least = len(share) - 1 - np.where(share > 0, share, np.inf)[::-1].argmin(axis=0)  # of equals the last
            without = share.copy()
            without[least, column] = 0
            total = without.sum(axis=0)
            possible = total > 1e-12
            without = np.where(possible, without / np.where(possible, total, 1), share)
            drop = possible & (likelihood(share) - likelihood(without) < PENALTY * np.log(count + 1))
            share = np.where(drop, without, share)
        for _ in range(3):
            share = em(share)
        if languages > CANDIDATES:
            whole = np.zeros((languages, len(starts)))
            np.put_along_axis(whole, some, share, axis=0)
            share = whole
        return share, single


def train(docs: DataFrame, learn: Column, most: int = MAX_TRAIN_DOCS) -> Model:
    """Learns from at most `most` documents of each language for which learn (of doc_id) holds."""

    def run(batches):
        for b in batches:
            names = np.array(b.column(0).to_pylist(), dtype=object)
            for at, part in tx.chunks(b.column(1)):
                bucket, word, ends = grams(part)
                of = np.searchsorted(ends, word, "right") - 1
                own = names[at : at + len(part)]
                for lang in sorted(set(own)):
                    count = np.bincount(bucket[(own == lang)[of]], minlength=BUCKETS)
                    some = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(count[some])], ["lang", "bucket", "n"])

    docs = docs.select("doc_id", "text", "lang").where(learn & F.col("doc_id").isNotNull() & (F.trim("lang") != ""))
    # The rank is cut before the shuffle too, so a large language is no large group.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    wanted = docs.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
    scratch = Scratch(docs.sparkSession)
    wanted = scratch.put(wanted, "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted
    own = docs.join(ids, ["doc_id", "lang"]).where("text is not null").select("lang", "text").distinct()
    arrow_rows(docs.sparkSession, 2000)
    rows = own.mapInArrow(lean(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    scratch.drop("wanted")
    languages = sorted(set(rows["lang"]))
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at_text, sent = names.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            found = [model.predict(part) for _, part in tx.chunks(b.column(at_text))]
            lang, score = [x for f in found for x in f[0]], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], [*names, "lang_pred", "score"])

    arrow_rows(docs.sparkSession, 2000)
    docs = docs.select(*names).withColumn(text, F.col(text).cast("string"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *added]))


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
