"""Very long texts, ties and repeated rows of the operators that other tests leave out."""

import types

import numpy as np
import pyarrow as pa
import pytest

from palaver.llm import decontaminate, langid, lattice, licenses, minhash, shared, urls

LONG = " ".join(f"w{k % 997}x{k % 991}" for k in range(300_000))


def test_decontamination_of_long_texts_and_repeated_rows(spark):
    item = " ".join(f"item{k}" for k in range(20))
    docs = spark.createDataFrame([(1, LONG + " " + item), (2, item), (2, item), (3, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.edits) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 7, 300_000, 0)] * 2 + [(2, 7, 0, 0)] * 4
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [3]


def test_near_copies_of_long_texts(spark):
    docs = spark.createDataFrame([(5, LONG), (3, LONG + " and more"), (9, LONG.replace("w1x", "q1x")), (4, "short one")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4}


def test_licenses_of_long_texts_and_ties(spark):
    mit, both = licenses.TEMPLATES["MIT"][0], "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: CC0-1.0"
    df = spark.createDataFrame([(1, "a/x", LONG + "\n" + mit), (2, "b/LICENSE", both), (3, "b/c/y", "nothing"), (3, "b/c/y", "nothing")], "doc_id long, path string, text string")
    got = sorted((r.doc_id, r.license, r.origin) for r in licenses.scan(df).collect())
    # Both lines match their templates wholly: the last license by name counts.
    assert got == [(1, "MIT", "header"), (2, "MIT", "header"), (3, "MIT", "inherited"), (3, "MIT", "inherited")]


def test_equal_languages():
    counts = np.bincount(langid.grams(pa.array(["some words of a language " * 20]))[0], minlength=langid.BUCKETS)
    model = langid.Model(["aa", "bb", "cc"], np.stack([counts, counts, counts]))
    assert model.predict(pa.array(["some words", LONG[:0], "words " * 200_000]))[0] == ["aa", "und", "aa"]


def test_url_of_great_length_and_equal_rules(spark):
    rules = [urls.prefix_rule("block", "a.com", "/x"), urls.prefix_rule("allow", "a.com", "/x"), urls.prefix_rule("allow", "com", "/x/a")]
    df = spark.createDataFrame([(1, "http://a.com/x" + "/y" * 400_000), (2, "http://a.com/x/a")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, rules=rules).collect()}
    # Equally long rules: the last by name, then by verdict.
    assert got == {1: ("a.com/x", "block"), 2: ("com/x/a", "allow")}


def test_equal_vectors_and_repeated_rows(spark):
    rows = [(k, [1.0, 2.0, 3.0], 1) for k in range(40)] + [(0, [1.0, 2.0, 3.0], 1), (50, [2.0, 4.0, 6.0], 1), (60, [1.0, 2.0, 3.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([(k, 40, 0) for k in range(40)] + [(0, 40, 0), (50, 40, 0), (60, 0, 60)])


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    spark = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(spark)
    spark.conf = types.SimpleNamespace(get=lambda key, default=None: "hdfs://nn/tmp/")
    assert shared.shared_dir(spark) == "hdfs://nn/tmp"
