import pyarrow.parquet as pq
import pytest

from tests.llm.test_decontaminate import distance, split
from tests.llm.test_minhash import brute

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from palaver.llm.shared import Scratch

    docs = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    bench = [split(r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    out, kept, scratch = spark.read.parquet(f"{DATA}/documents.parquet"), set(docs), Scratch(spark)
    names = out.columns
    for name, stage in cp.STAGES:
        out = scratch.put(stage(spark, out, DATA), name)
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == kept
            break
        assert out.columns == names
        now = {r.doc_id for r in rows}
        assert now <= kept and len(now) == len(rows) and all(r.text == docs[r.doc_id]["text"] for r in rows)
        if name == "quality":
            known = [i for i in kept if i in labels]
            assert sum((i in now) == labels[i] for i in known) >= 0.97 * len(known)
        elif name == "language":
            assert len(now) >= 0.99 * len(kept)
        elif name == "near_dedup":
            classes = brute({i: docs[i]["text"] for i in kept})
            assert now == {i for i, c in classes.items() if i == c}
        else:
            leaked = {i for i in kept if any(distance(b, split(docs[i]["text"])) <= 0.2 * len(b) for b in bench if len(split(docs[i]["text"])) < 1500)}
            assert now <= kept - leaked and len(kept - leaked - now) <= 2
        kept = now


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_odd_rows(spark, stage):
    """Which rows stay: null and empty texts are no near copies and hold no benchmark item, but have no language."""
    import corpus_pipeline as cp

    plain = "A few plain words to stand in a row. " * 9
    rows = [(1, None, "en", None, None, "x"), (None, "", None, "s", 0, "y"), (5, plain, "en", "s", 5, "z"), (8, plain, "en", "s", 5, "z"), (5, plain, "en", "s", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    name, run = cp.STAGES[stage]
    out = run(spark, docs, DATA)
    got = sorted((str(r.doc_id) for r in out.collect()))
    if name == "packing":
        assert {"1", "None", "5", "8"} == set(got) and out.where("doc_id = 1").first().doc_tokens == 1
        assert run(spark, docs.limit(0), DATA).count() == 0
        return
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows)
    want = {"language": ["5", "5", "8"], "near_dedup": ["1", "5", "None"], "decontamination": ["1", "5", "5", "8", "None"]}
    assert got == want.get(name, got)
    none = run(spark, docs.limit(0), DATA)
    assert none.columns == docs.columns and none.count() == 0


def test_quality_stage_keeps_good_rows(spark):
    import corpus_pipeline as cp

    good, bad = "A clean sentence with several plain words.\n" * 6, "$$$ ### @@@ !!! <<< 000\n" * 6
    rows = [(i, (good if i % 2 else bad) + str(i), "en", "s", 5) for i in range(200)] + [(500, good, "en", "s", 5), (501, bad, "en", "s", 5), (502, None, "en", "s", 5), (None, good, "en", "s", 5), (500, good, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = [r.doc_id for r in cp.quality_stage(spark, docs, folder).collect()]
    assert {i for i in got if i is not None and i < 200} == set(range(1, 200, 2))
    assert got.count(500) == 2 and 501 not in got and got.count(None) == 1


def test_stages_with_code_generation(spark):
    """The other tests go without; production does not."""
    import corpus_pipeline as cp
    from palaver.llm.shared import Scratch

    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        scratch, docs = Scratch(spark), spark.read.parquet(f"{DATA}/documents.parquet")
        for name, stage in cp.STAGES:
            docs = scratch.put(stage(spark, docs, DATA), name)
        assert docs.select("doc_id").distinct().count() > 50
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
