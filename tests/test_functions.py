import hashlib

import pytest
from pyspark.sql import functions as F

from palaver.functions import hashing, text as tx
from palaver.functions.numbers import rounded


def values(spark, inputs, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_groups_and_buckets(spark):
    names = ["no_va_a", "a_long", "a_variant2_long", "no_va_b_variant12", "long", "x_longish", "a_long_variant3_b"]
    assert values(spark, names, tx.group_base) == ["a", "a", "a", "b", "long", "x_longish", "a_long_variant3_b"]
    assert values(spark, ["k"], lambda c: hashing.bucket("s", c)) == [0.7780919706255458]
    keys = [f"k{i}" for i in range(400)]
    want = [int.from_bytes(hashlib.sha256(f"seed-v1:{k}".encode()).digest()[:8], "big") / 2**64 for k in keys]
    at = lambda c: hashing.bucket("seed-v1", c)
    assert values(spark, keys, at) == want
    split = lambda p: "train" if p < 0.8 else "validation" if p < 0.8 + 0.1 else "test"
    assert values(spark, keys, lambda c: hashing.assign(at(c))) == [split(p) for p in want]
    assert values(spark, ["a"], lambda c: hashing.shuffled("s", c)) == [hashlib.sha1(b"s:a").hexdigest()]


def test_names_addressed(spark):
    said = ["Hey Sigma, what time", "What time is it, Sigma?", "I asked Sigma about it", "", None, "Ok, so, um: SIGMA?", "Sigma", "'Sigma, hi'"]
    assert values(spark, said, lambda c: tx.is_addressed(c, "Sigma")) == [True, True, False, False, False, True, True, True]
    assert values(spark, said, lambda c: tx.mentions(c, "Sigma")) == [True, True, True, False, False, True, True, True]


def test_prepend(spark):
    said = ['"What time is it?"', "OK do it", "I think so", "", "  ", "McDonald came", "What?", "“ hello", '"', "Élan vital", "7 days", "Sigma said"]
    want = ['"Sigma, what time is it?"', "Sigma, OK do it", "Sigma, I think so", "Sigma?", "Sigma?", "Sigma, McDonald came", "Sigma, what?", "“Sigma, hello", '"Sigma?', "Sigma, élan vital", "Sigma, 7 days", "Sigma, Sigma said"]
    assert values(spark, said, lambda c: tx.prepend_name(c, "Sigma")) == want


def test_strips(spark):
    assert values(spark, ['Original text: "Sigma, what time is it?"', "Rewrite: 'a'", '""', "plain"], lambda c: tx.strip_wrapper(c, ["Original text", "Rewrite"], 3)) == ["Sigma, what time is it?", "a", '""', "plain"]
    strip = lambda c: tx.strip_speaker(c, ["Anna", "Sigma"], "Sigma", F.lit(True))
    assert values(spark, ["Anna: hi", "Sigma, hi", "Sigma: hi", "Anna, Sigma : yo"], strip) == ["hi", "Sigma, hi", "hi", "yo"]
    assert values(spark, ["a\nb\nAnna: c\nd", "x"], lambda c: tx.cut_nested(c, ["anna"])) == ["a\nb", "x"]
    assert values(spark, ["Call it now. Do not ask Sigma. Ask Sigma! Bye."], lambda c: tx.sentences_without(c, "sigma", r"\bnot\b")) == ["Call it now. Do not ask Sigma. Bye."]


def test_parsers(spark):
    assert values(spark, ["12.3s (about)", "7", "x", None], tx.seconds) == [12.3, 7.0, None, None]
    assert values(spark, ["so: [1, [2]] ok", "none"], tx.json_slice) == ["[1, [2]]", None]
    assert values(spark, ["```json\n[1]\n``` [9]", "a [2] b"], tx.fenced_json) == ["[1]", "[2]"]
    assert values(spark, ["Don't stop—now, OK?"], tx.asr_tokens) == [["dont", "stop", "now", "ok"]]
    assert values(spark, ["é b/c.d"], tx.file_name) == ["é_b_c_d"]
    assert values(spark, ["[laughs] ...", "[x] ok", "é"], tx.is_speakable) == [False, True, True]
    assert values(spark, ["a b c", None], tx.count_words) == [3, 0]
    assert values(spark, ["Um, the mm album", "umbrella", "éum x"], tx.fillers) == [["um", "mm"], [], []]


@pytest.mark.parametrize("old, new, want", [("0.1.0", "0.1.9", False), ("0.1.0", "0.2.0", True), ("x", "0.1.0", True), (None, "0.1.0", True)])
def test_version_gate(spark, old, new, want):
    assert spark.range(1).select(tx.must_regenerate(F.lit(old).cast("string"), F.lit(new))).head()[0] is want


def test_paths_and_flags(spark):
    got = values(spark, ["a/b/c.json", "m/v/a/b/c.json"], tx.path_parts)
    assert [tuple(r) for r in got] == [("a", "b", "c.json")] * 2
    assert values(spark, ["[SILENCE]", "", "ok", "x [silence]", "[TIMEOUT]"], tx.was_triggered) == [False, False, True, False, True]
    assert values(spark, [3725.0, 65.0, 2.5], tx.pretty_duration, "double") == ["1h 2m 5.0s", "1m 5.0s", "2.5s"]
    assert values(spark, [0.0, None], lambda c: tx.resolve_duration(c, F.lit(0.0), F.lit(5.0)), "double") == [0.0, 5.0]
    assert values(spark, ["silence", "x", None], lambda c: tx.is_silence(F.lit(None).cast("boolean"), c)) == [True, False, False]


def test_words_end_where_those_of_the_sql_do(spark):
    import duckdb

    texts = ["o la, noñcodot", "ñno", "no\u0301x", "no", "know", "no_x", "ſigma here", "a\u017f\u017fistant", "ſigmañ", "No1", "ask", "without", None]
    con = duckdb.connect()
    for pattern in (tx.NEGATION, tx.MENTION, tx.BRIEF_MENTION, tx.AFFIRM, "(ask|les)"):
        want = [bool(con.execute("select coalesce(regexp_matches(?::varchar, ?), false)", [x, "(?i)" + pattern]).fetchall()[0][0]) for x in texts]
        assert values(spark, texts, lambda c: tx.says(c, pattern)) == want
    assert values(spark, texts[:2], lambda c: tx.says(c, tx.NEGATION)) == [True, True]
    assert values(spark, ["Sigma noñ. Ask."], lambda c: tx.sentences_without(c, tx.MENTION, tx.NEGATION)) == ["Sigma noñ. Ask."]


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    con, every = duckdb.connect(), [4.645, 21.044999999999998, 1.005, -1.005, 2.675, 0.285, 0.005, 8.15, -0.25, 1e15 + 0.5, 0.0, None]
    for digits in (1, 2, 6):
        want = [con.execute(f"select round(?::double, {digits})", [x]).fetchall()[0][0] for x in every]
        assert values(spark, every, lambda c: rounded(c, digits), "double") == want
    assert values(spark, [4.645, float("inf")], lambda c: rounded(c, 2), "double") == [4.64, float("inf")]
