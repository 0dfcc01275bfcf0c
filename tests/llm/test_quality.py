import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from palaver.llm import quality

DATA = "/root/testdata/sf0.01"


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(1)
    rows = np.array([0, 1, 4, 6])
    unary, pair = rng.normal(size=6), rng.normal(size=(2, 2))
    good, expected, z = quality.forward_backward(unary, pair, rows)
    total = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
        every = list(itertools.product((0, 1), repeat=b - a))
        score = np.array([sum(unary[a + i] * y for i, y in enumerate(ys)) + sum(pair[p, q] for p, q in zip(ys, ys[1:])) for ys in every])
        p = np.exp(score) / np.exp(score).sum()
        assert np.isclose(z[k], np.log(np.exp(score).sum()))
        assert np.allclose(good[a:b], [sum(q for q, ys in zip(p, every) if ys[i]) for i in range(b - a)])
        for q, ys in zip(p, every):
            for s, t in zip(ys, ys[1:]):
                total[s, t] += q
    assert np.allclose(total, expected)


def test_lines_count():
    f, size, rows = quality.line_features(pa.array(["", None, "a b\nc", "\n\n", "é" * 30 + "\nx × y\n— z"]))
    assert np.diff(rows).tolist() == [1, 1, 2, 3, 3] and len(f) == len(size) == 10 and np.isfinite(f).all()
    assert size.tolist() == [0, 0, 3, 1, 0, 0, 0, 60, 6, 5]
    long, short = (quality.line_features(pa.array([t]))[0][0] for t in ("aB3 é.!" * 400_000, "aB3 é.!" * 40_000))
    shares = slice(1, 10)
    assert np.allclose(long[shares], short[shares], atol=1e-6)


def test_held_out_accuracy(spark):
    rows = quality.op5_quality(spark, DATA).collect()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id"]).num_rows
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a\nb", "q"), (1, None, "q"), (1, "", None), (2, "x " * 200_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and [r.score for r in got.collect()] == [0.5] * 4
    assert quality.score(docs.limit(0), model).count() == 0


def test_long_texts_by_doubling(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = [1, 3, 700, 1, 2500, 64, 65]
    rows = np.concatenate(([0], np.cumsum(lengths)))
    unary, pair = rng.normal(size=rows[-1]) * 3, rng.normal(size=(2, 2))
    want = quality.forward_backward(unary, pair, rows)
    monkeypatch.setattr(quality, "LONG", 2)
    for a, b in zip(quality.forward_backward(unary, pair, rows), want, strict=True):
        assert np.allclose(a, b)


def test_scores_against_plain_ones(spark):
    """A document's score from its line features alone: marginals by summing over all labelings, then the weighted mean and the curve."""
    model = quality.Crf()
    rng = np.random.default_rng(5)
    model.weights, model.pair, model.curve = rng.normal(size=3 * len(quality.NAMES)), rng.normal(size=(2, 2)), (1.3, -0.2)
    texts = ["one line only.", "a\n\nb c d!\nEnd", "", "x y x y\nx y\n%%%\nLast line here?", None]
    got = [r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        f, size, rows = quality.line_features(pa.array([text], pa.string()))
        n = len(f)
        around = [np.concatenate((f[i], f[i - 1] if i else 0 * f[0], f[i + 1] if i + 1 < n else 0 * f[0])) @ model.weights for i in range(n)]
        every = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([sum(u * y for u, y in zip(around, ys)) + sum(model.pair[p, q] for p, q in zip(ys, ys[1:])) for ys in every])
        good = np.array([sum(w for w, ys in zip(weight, every) if ys[i]) for i in range(n)]) / weight.sum()
        mean = (good * (size + 1)).sum() / (size + 1).sum()
        assert np.isclose(score, 1 / (1 + np.exp(-(1.3 * np.log(mean / (1 - mean)) - 0.2))))


def test_training_is_bounded_by_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join(["good line here."] * (i + 1)) if i % 2 else "#$%\n" * (i + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    fit = quality.Crf.fit
    quality.Crf.fit = lambda self, f, size, rows, label: seen.append((len(f), len(label))) or fit(self, f, size, rows, label)
    try:
        quality.train(docs, labels, F.lit(True), most_lines=120)
        quality.train(docs, labels, F.lit(True), most=7)
    finally:
        quality.Crf.fit = fit
    assert 0 < seen[0][0] <= 120 and seen[1][1] == 7


def test_a_text_of_very_many_lines(spark):
    docs = spark.createDataFrame([(1, "Some line of words.\n" * 300_000)], "doc_id long, text string")
    model = quality.Crf()
    model.pair = np.array([[0.5, 0.0], [0.0, 0.5]])
    assert [0 <= r.score <= 1 for r in quality.score(docs, model).collect()] == [True]
