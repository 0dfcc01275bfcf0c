import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from palaver.llm import langid

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = langid.op8_language(spark, DATA).collect()
    docs = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id]["lang"] for r in held]) > 0.97


def model(texts):
    counts = np.stack([np.bincount(langid.grams(pa.array([t]))[0], minlength=langid.BUCKETS) for t in texts.values()])
    return langid.Model(list(texts), counts)


def test_mixture_and_independence():
    words = {"aa": "bala bolo bulu lab lob " * 50, "ee": "tik tek kit ket tiket " * 50}
    m = model(words)
    texts = [words["aa"], words["ee"], words["aa"][:600] + words["ee"][:200], "bala", "", None, "12 !? ×", "٣٤", "tek é", "ª", "BALA" * 500]
    got = m.predict(pa.array(texts))
    assert got[0][:5] == ["aa", "ee", "aa", "aa", "und"] and got[0][5:8] == ["und"] * 3 and got[0][8] == "ee" and got[0][9] != "und" and got[0][10] == "aa"
    share = got[1][2]
    assert 0.6 < share < 0.9 and got[1][4] == got[1][5] == 0
    one = [m.predict(pa.array([t], pa.string())) for t in texts]
    assert [x[0][0] for x in one] == got[0] and np.allclose([x[1][0] for x in one], got[1])


def test_grams_stay_in_words():
    bucket, word, at = langid.grams(pa.array(["ab c", "", "x", "ab"]))
    assert at.tolist() == [0, 2, 2, 3, 4] and word.tolist() == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]
    assert bucket[:3].tolist() == bucket[7:].tolist()


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", None, 1), (None, "c d", "xx", 2), (2, None, "yy", 3), (3, "e", " ", 4)], "doc_id long, text string, lang string, score int")
    m = langid.train(df, F.lit(True))
    assert m.languages == []
    got = langid.identify(df, m)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r.lang_pred for r in got.collect()} == {"und"}
    assert langid.identify(df.limit(0), m).count() == 0


def _objective(m, p, share):
    return np.log((p * share[:, None]).sum(axis=0)).sum() - langid.PENALTY * np.log(p.shape[1] + 1) * (share > 0).sum()


def test_sets_against_all_sets():
    """The penalised likelihood of the chosen languages, against the best of every set of languages, with shares by long EM."""
    import itertools
    import random

    r = random.Random(3)
    roots = {"aa": "bala bolo bulu lab lob", "ee": "tik tek kit ket tiket", "ii": "mira rima mari armi rami", "oo": "fogo gofo fog offog", "uu": "bala tik mira fogo dun"}
    m = model({k: v + " " + " ".join(r.choice(v.split()) + r.choice("xyz") for _ in range(200)) for k, v in roots.items()})
    same = 0
    for k in range(60):
        langs = r.sample(sorted(roots), r.choice((1, 1, 2, 3)))
        text = " ".join(r.choice(roots[r.choice(langs)].split()) for _ in range(r.choice((3, 20, 90))))
        bucket, word, at = langid.grams(pa.array([text]))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        each = np.stack([np.add.reduceat(t[bucket], first, dtype=np.float64) for t in m.table])
        p = np.exp(each - each.max(axis=0))
        share, _ = m.mixture(each, np.array([0]), np.array([each.shape[1]]))
        best = -np.inf
        for n in range(1, len(roots) + 1):
            for some in itertools.combinations(range(len(roots)), n):
                s = np.zeros(len(roots))
                s[list(some)] = 1 / n
                for _ in range(200):
                    joint = p * s[:, None] + 1e-300
                    s = (joint / joint.sum(axis=0)).mean(axis=1) * (s > 0)
                best = max(best, _objective(m, p + 1e-300, s))
        got = _objective(m, p + 1e-300, share[:, 0])
        assert got <= best + 1e-6
        same += got >= best - 0.05 * abs(best)
    assert same >= 57


def test_candidates_change_nothing_for_plain_texts(monkeypatch):
    import random

    r = random.Random(4)
    words = {f"l{k}": " ".join("".join(r.choice("abcdefghij"[k : k + 4]) for _ in range(r.randint(2, 6))) for _ in range(300)) for k in range(7)}
    texts = pa.array([" ".join(r.sample(w.split(), 40)) for w in words.values()] + [" ".join(r.sample(words["l0"].split(), 60) + r.sample(words["l6"].split(), 30))])
    got = model(words).predict(texts)
    monkeypatch.setattr(langid, "CANDIDATES", 100)
    want = model(words).predict(texts)
    assert got[0] == want[0] == [*words, "l0"] and np.allclose(got[1], want[1], atol=0.02)


def test_rare_languages_are_learned(spark):
    rows = [(i, f"some words of the first kind {i}", "aa") for i in range(300)] + [(1000, "zzyzx qwx vvk", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    m = langid.train(df, F.lit(True), most=20)
    assert m.languages == ["aa", "zz"]
    assert [r.lang_pred for r in langid.identify(df.where("doc_id >= 299"), m).orderBy("doc_id").collect()] == ["aa", "zz"]
