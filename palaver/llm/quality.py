"""Document quality by a linear-chain conditional random field over lines (operator 5).

Every line is good or bad. Its potentials come from features of the line and of the lines
before and after it, and from the pair of neighbouring labels. Forward-backward gives each
line's probability of being good; their mean, weighted by line length, is mapped to the
document's score by a logistic curve. Weights and curve are fitted on labelled documents,
where every line takes its document's label.

At most MAX_TRAIN_DOCS labelled documents, of MAX_TRAIN_LINES lines in all, are fitted on, those
with the smallest hash of doc_id, as long as their lines fit. Texts are
scored whole on the executors; a long one takes a number of steps that grows with the logarithm
of its lines.

Nulls: a null or empty text has one empty line. Null labels are not learned from; of repeated
labels of one doc_id the lower counts. Without both labels to learn from, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palaver.llm import text as tx
from palaver.llm.shared import Scratch, arrow_rows, lean

MAX_TRAIN_DOCS, MAX_TRAIN_LINES = 4000, 300_000
#: Texts of more lines are scanned by doubling.
LONG = 1024
STEPS, RATE, PENALTY = 250, 0.08, 1e-3

_SYMBOL, _STOP = set(b"#$%&*|<>{}[]=\\^~@+_/`"), set(b".,;:?")
_KINDS = (
    lambda b: b >= 128 or chr(b).isalpha(),
    lambda b: chr(b).isupper() and b < 128,
    lambda b: chr(b).isdigit() and b < 128,
    lambda b: b in b" \t\r",
    lambda b: b in _SYMBOL,
    lambda b: b in _STOP,
    lambda b: b == ord("!"),
    lambda b: b in b"\"'()-",
    lambda b: b & 0xC0 != 0x80,
)
#: Three counters of 21 bits in each table: one running sum counts three kinds of bytes.
_COUNTERS = [np.array([sum(int(bool(k(b))) << (21 * i) for i, k in enumerate(_KINDS[j : j + 3])) for b in range(256)], dtype=np.uint64) for j in (0, 3, 6)]
NAMES = ("bias", "letters", "upper", "digits", "spaces", "symbols", "symbols>2%", "stops", "bangs", "quotes", "log length", "log words", "word length", "repeats", "repeats>10%", "repeated line", "short", "ends open", "lines", "edge")


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[ends] - total[starts]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line, offsets of each text's lines)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    data, offsets = tx.raw(texts)
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    rows = np.concatenate(([0], np.cumsum(per_text)))
    starts, ends = np.empty(rows[-1], np.int64), np.empty(rows[-1], np.int64)
    first = np.zeros(rows[-1], bool)
    first[rows[:-1]] = True
    last = np.zeros(rows[-1], bool)
    last[rows[1:] - 1] = True
    starts[first], ends[last] = offsets[:-1], offsets[1:]
    starts[~first], ends[~last] = breaks + 1, breaks
    counts = []
    for table in _COUNTERS:
        packed = _sums(table[data], starts, ends)
        counts += [((packed >> np.uint64(21 * i)) & np.uint64((1 << 21) - 1)).astype(float) for i in range(3)]
    for i in np.flatnonzero(ends - starts >= 1 << 21):  # too long for the packed counters
        each = np.bincount(data[starts[i] : ends[i]], minlength=256)
        for k, kind in enumerate(_KINDS):
            counts[k][i] = sum(int(each[b]) for b in range(256) if kind(b))
    size = np.maximum(counts[8], 1)
    share = [c / size for c in counts[:8]]
    lowered = tx.plain(texts)
    words, repeats, same = _words_by_line(lowered, rows, per_text)
    doc = np.repeat(np.arange(len(per_text)), per_text)
    closed = np.zeros(len(ends), bool)
    filled = np.flatnonzero(ends > starts)
    closed[filled] = np.isin(data[ends[filled] - 1], np.frombuffer(b".!?", np.uint8))
    f = np.stack([
        np.ones(len(starts)), share[0], share[1], share[2], share[3], share[4] * 4, share[4] > 0.02, share[5] * 4, np.minimum(share[6] * 8, 1), share[7] * 4,
        np.log1p(counts[8]) / 6, np.log1p(words) / 4, np.minimum(counts[0] / np.maximum(words, 1), 20) / 8,
        repeats / np.maximum(words, 1) * 3, repeats > 0.1 * np.maximum(words, 1), same, counts[8] < 60,
        ~closed,
        np.log1p(per_text[doc]) / 4, first | last,
    ], axis=1).astype(np.float64)
    return f, (ends - starts).astype(float), rows


def _words_by_line(lowered, rows, per_text):
    """Words, words equal to one of the two before, and whether the line occurs again in its text.

    Lowering may change lengths, so lines are found anew in the lowered text; separators of
    unusual texts become spaces there, which joins their lines: those count as one line.
    """
    data, offsets = tx.raw(lowered)
    breaks = np.flatnonzero(data == 10)
    line_of = np.cumsum(data == 10)
    hashes, word_rows, starts, _ = tx.words(lowered)
    text_of = np.repeat(np.arange(len(per_text)), np.diff(word_rows))
    before = np.searchsorted(breaks, offsets)
    own = line_of[starts] - before[:-1][text_of] if len(starts) else np.zeros(0, np.int64)
    line = rows[:-1][text_of] + np.minimum(own, per_text[text_of] - 1)
    n = rows[-1]
    words = np.bincount(line, minlength=n).astype(float)
    again = np.zeros(len(hashes), bool)
    for k in (1, 2):
        again[k:] |= (hashes[k:] == hashes[:-k]) & (line[k:] == line[:-k])
    repeats = np.bincount(line[again], minlength=n).astype(float)
    edges = np.searchsorted(line, np.arange(n + 1))
    key = tx.sequence_hash(hashes, edges[:-1], edges[1:]) ^ tx.mix(np.repeat(np.arange(len(per_text)), per_text).astype(np.uint64))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return words, repeats, (count[inverse] > 1) & (words > 0)


def with_neighbours(f: np.ndarray, rows: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[rows[:-1]] = 0
    after[rows[1:] - 1] = 0
    return np.concatenate((f, before, after), axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[:, :, 0, None] + b[:, 0, None, :], a[:, :, 1, None] + b[:, 1, None, :])


def _doubling(unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward scores of one text: prefix and suffix products of its steps, in log2(lines) rounds."""
    n = len(unary)
    step = np.zeros((n, 2, 2)) + pair
    step[0] = 0
    step[:, :, 1] += unary[:, None]
    prefix, suffix, d = step.copy(), np.concatenate((step[1:], [[[0, -np.inf], [-np.inf, 0]]])), 1
    while d < n:
        prefix[d:] = _product(prefix[:-d], prefix[d:])
        suffix[:-d] = _product(suffix[:-d], suffix[d:])
        d *= 2
    return prefix[:, 0], np.logaddexp(suffix[:, :, 0], suffix[:, :, 1])


def _in_step(unary: np.ndarray, pair: np.ndarray, starts: np.ndarray, length: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
    """Fills up and down; all texts advance one line at a time, the longest first."""
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, most + 1), "right")
    for t in range(most):
        i = starts[: active[t]] + t
        if t:
            p = up[i - 1]
            up[i, 0] = np.logaddexp(p[:, 0] + pair[0, 0], p[:, 1] + pair[1, 0])
            up[i, 1] = np.logaddexp(p[:, 0] + pair[0, 1], p[:, 1] + pair[1, 1])
        up[i, 1] += unary[i]
    for t in range(most - 2, -1, -1):
        i = starts[: active[t + 1]] + t
        q = down[i + 1]
        q = q + np.stack((np.zeros(len(i)), unary[i + 1]), axis=1)
        down[i, 0] = np.logaddexp(pair[0, 0] + q[:, 0], pair[0, 1] + q[:, 1])
        down[i, 1] = np.logaddexp(pair[1, 0] + q[:, 0], pair[1, 1] + q[:, 1])


def forward_backward(unary: np.ndarray, pair: np.ndarray, rows: np.ndarray):
    """(P(good) per line, expected pair counts per text summed, log partition per text).

    unary: score of good against bad per line; pair: 2 x 2 scores of neighbouring labels.
    """
    length, n = np.diff(rows), len(unary)
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    short = length <= LONG
    _in_step(unary, pair, rows[:-1][short], length[short], up, down)
    for k in np.flatnonzero(~short):
        a, b = rows[k], rows[k + 1]
        up[a:b], down[a:b] = _doubling(unary[a:b], pair)
    both = up + down
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.ones(n, bool)
    inner[rows[:-1]] = False
    i = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(up[i - 1, a] + pair[a, b] + b * unary[i] + down[i, b] - z[i]).sum()
    return good, expected, z[rows[:-1]]


def aggregate(good: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log odds of the mean of P(good), weighted by line length."""
    weight = size + 1
    mean = np.add.reduceat(good * weight, rows[:-1]) / np.add.reduceat(weight, rows[:-1])
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


class Crf:
    """Weights by feature, label pair scores, and slope and offset of the final curve."""

    def __init__(self):
        self.weights, self.pair, self.curve = np.zeros(3 * len(NAMES)), np.zeros((2, 2)), (0.0, 0.0)

    def fit(self, f: np.ndarray, size: np.ndarray, rows: np.ndarray, label: np.ndarray) -> Crf:
        if len(set(label.tolist())) < 2:
            return self
        x = with_neighbours(f, rows)
        length = np.diff(rows)
        y = np.repeat(label, length).astype(float)
        theta = np.zeros(len(self.weights) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        same = np.array([[(length[label == 0] - 1).sum(), 0], [0, (length[label == 1] - 1).sum()]], float)
        for step in range(1, STEPS + 1):
            w, pair = theta[:-4], theta[-4:].reshape(2, 2)
            good, expected, _ = forward_backward(x @ w, pair, rows)
            gradient = np.concatenate((x.T @ (y - good), (same - expected).ravel())) / len(y) - PENALTY * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.pair = theta[:-4], theta[-4:].reshape(2, 2)
        raw = aggregate(forward_backward(x @ self.weights, self.pair, rows)[0], size, rows)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            r = p * (1 - p) + 1e-6
            g = np.array([((label - p) * raw).sum() - 0.01 * a, (label - p).sum()])
            h = np.array([[(r * raw * raw).sum() + 0.01, (r * raw).sum()], [(r * raw).sum(), r.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        self.curve = (max(a, 1e-3), b)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        f, size, rows = line_features(texts)
        good, _, _ = forward_backward(with_neighbours(f, rows) @ self.weights, self.pair, rows)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * aggregate(good, size, rows) + b, -30, 30)))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MAX_TRAIN_DOCS, most_lines: int = MAX_TRAIN_LINES) -> Crf:
    """Fits on at most `most` of the labelled documents for which learn (of doc_id) holds, of at most `most_lines` lines."""

    def run(batches):
        for b in batches:
            for at, part in tx.chunks(b.column(2)):
                f, size, rows = line_features(part)
                ids, label = (b.column(k).slice(at, len(part)) for k in (0, 1))
                cut = [np.concatenate((f[a:z], size[a:z, None]), axis=1).astype(np.float32).tobytes() if z - a <= most_lines else None for a, z in zip(rows[:-1], rows[1:], strict=True)]
                made = pa.RecordBatch.from_arrays([ids, label, pa.array(np.diff(rows)), pa.array(cut, pa.binary())], ["id", "quality", "n", "lines"])
                yield made.filter(made.column(3).is_valid())

    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(wanted), "doc_id").select(F.xxhash64("doc_id").alias("id"), "quality", "text")
    arrow_rows(docs.sparkSession, 2000)
    scratch = Scratch(docs.sparkSession)
    made = scratch.put(texts.mapInArrow(lean(run), "id long, quality int, n long, lines binary"), "lines")
    # Only whole documents, in the order of their hash, as long as their lines fit.
    sizes = made.select("id", "n").orderBy("id", "n").limit(most).collect()
    room, last = most_lines, None
    for r in sizes:
        room -= r["n"]
        if room < 0:
            break
        last = r["id"]
    rows = made.where(F.col("id") <= last).collect() if last is not None else []
    scratch.drop("lines")
    rows.sort(key=lambda r: (r.quality, bytes(r.lines)))  # the same sum in any order of tasks
    lines = [np.frombuffer(r.lines, np.float32).reshape(-1, len(NAMES) + 1).astype(float) for r in rows]
    if not lines:
        return Crf()
    x = np.concatenate(lines)
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in lines])))
    return Crf().fit(x[:, :-1], x[:, -1], offsets, np.array([r.quality for r in rows]))


def score(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """docs with a column score, in place of one of that name."""
    names = [c for c in docs.columns if c.lower() != "score"]
    at_text = names.index(text)

    def run(batches):
        for b in batches:
            done = [model.score(part) for _, part in tx.chunks(b.column(at_text), 1 << 20)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(done) if done else np.zeros(0))], [*names, "score"])

    arrow_rows(docs.sparkSession, 2000)
    docs = docs.select(*names).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs, labels, ~held_out)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
