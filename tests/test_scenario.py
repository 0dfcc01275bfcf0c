from pyspark.sql import functions as F

from palaver.operators import scenario


def test_speakers(spark):
    raw = '["user1", {"speaker": "user2"}, {"speaker": "user5", "interjection": "agree"}]'
    df = spark.createDataFrame([(raw, "single_user"), (raw, "multi_user"), ("no", "x")], "raw string, kind string")
    got = [r.s for r in df.select(scenario.normal_speakers(F.col("raw"), F.col("kind")).alias("s")).collect()]
    assert [(s.names, s.interjections) for s in got] == [(["user1", "user5"], {1: "agree"}), (["user1", "user2", "user5"], {2: "agree"}), ([], {})]


def test_without_assistant(spark):
    phases = [("seeking_help", ["user1", "assistant"], "go on"), ("calm", ["user1"], "Guard."), (None, None, None), ("helpdesk", ["Assistant2"], "x!")]
    df = spark.createDataFrame([(phases,)], "p array<struct<phase:string,speakers:array<string>,note:string>>")
    after = scenario.without_assistant(F.col("p"), "Guard.")
    r = df.select(after.alias("a"), scenario.count_changes(F.col("p"), after).alias("n")).head()
    assert [(x.phase, x.speakers, x.note) for x in r.a] == [("weighing_options", ["user1"], "go on. Guard."), ("calm", ["user1"], "Guard."), (None, None, "Guard."), ("talking_it_over", [], "x! Guard.")]
    assert r.n == 3
    rules = spark.createDataFrame([(["Sigma answers.", "Sigma never answers.", "talk"],)], "r array<string>")
    assert rules.select(scenario.without_directives(F.col("r"), r"\bsigma answers|never answers", r"\bnever\b")).head()[0] == ["Sigma never answers.", "talk"]


def test_voices_and_pools(spark):
    df = spark.createDataFrame([("Ann", "m"), ("User1", "m"), ("User1", "x")], "who string, mode string")
    characters = F.expr("map('Ann', map('K', 'v1'))")
    generic = F.expr("map('User1', map('m', map('K', 'v2')))")
    assert [r[0] for r in df.select(scenario.voice_of(F.col("who"), "K", F.col("mode"), characters, generic)).collect()] == ["v1", "v2", None]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [r.name for r in scenario.pool(names("Ann", "Bo"), names("ANN", "Cy")).collect()] == ["Ann"]
    configs = spark.createDataFrame([("c", ["x/ann.txt"], ["bo", "zz"])], "config string, backstory_files array<string>, characters array<string>")
    assert {r.character for r in scenario.referenced(configs, spark.createDataFrame([("ann",), ("bo",)], "character string")).collect()} == {"ann", "bo"}


def test_times_and_gaps(spark):
    rows = [(c, t, "x" * 11 * (t + 1), "agree" if t == 2 else None) for c in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, interjection string")
    got = {(r.conv_id, r.turn): r.time for r in scenario.planned_times(df, "s").collect()}
    assert len(got) == 20 and all(0 <= got[c, 0] <= 2.4 and got[c, t] >= got[c, t - 1] + t + 0.1 for c in range(5) for t in range(1, 4))
    assert {(r.conv_id, r.turn): r.time for r in scenario.planned_times(df.repartition(3), "s").collect()} == got
    g = {(r.conv_id, r.turn): r.gap for r in scenario.gaps(df, "s", {"agree": (0.5, 0.6)}).collect()}
    assert all(g[c, 3] is None and -0.6 <= g[c, 1] <= -0.5 and 0.3 <= g[c, 0] <= 1.2 for c in range(5))


def test_model_calls(spark):
    def make():
        state = {"n": 0}

        def client(texts):
            state["n"] += 1
            if state["n"] == 1 or "bad" in set(texts):
                raise RuntimeError
            return [t.upper() for t in texts]

        return client

    one = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    assert sorted(r.response for r in scenario.call_model(one, make, "t", wait=0.0).collect()) == ["A", "B"]
    assert [r.response for r in scenario.call_model(spark.createDataFrame([("bad",)], "t string"), make, "t", wait=0.0).collect()] == [None]
