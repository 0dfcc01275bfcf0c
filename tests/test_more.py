import json

import pytest
from pyspark.sql import functions as F

from palaver.operators import detect, release, scenario, select
from palaver.sources import tables
from palaver.streaming import suppress


def test_retarget_only_in_the_block():
    text = json.dumps({"single": {"user1": {"backstory_file": "old.txt"}}, "couple": {"user2": {"a": {"b": "}"}, "backstory_file": "x.txt"}, "user1": {"backstory_file": "old.txt", "n": 1}}}, indent=1)
    out = json.loads(select.retarget(text, "couple", {"user1": "ann", "user9": "z"}))
    assert out["single"]["user1"]["backstory_file"] == "old.txt" and out["couple"]["user1"] == {"backstory_file": "ann.txt", "n": 1} and out["couple"]["user2"]["backstory_file"] == "x.txt"
    assert select.retarget(text, "none", {"user1": "ann"}) == text


def test_retarget_column(spark):
    rows = spark.createDataFrame([('{"c": {"r": {"backstory_file": "a.txt"}}}', "c", {"r": "k"}), (None, "c", None)], "t string, b string, k map<string,string>")
    assert [r.x for r in rows.select(select.retarget_all("t", "b", "k").alias("x")).collect()] == ['{"c": {"r": {"backstory_file": "k.txt"}}}', None]


def test_cross_entropy(spark):
    import math

    logits, s = [0.3, -1.0, 2.0], 0.1
    log_p = [x - math.log(sum(math.exp(v) for v in logits)) for x in logits]
    got = spark.range(1).select(detect.cross_entropy(F.array(*map(F.lit, logits)), F.lit(1), s).alias("x")).first().x
    assert abs(got - -((1 - s) * log_p[1] + s * sum(log_p) / 3)) < 1e-12


def test_briefs_are_asked_twice(spark):
    def make():
        return lambda texts: [t.replace("Sigma", "sigma x") if "Sigma" in t else t.replace("sigma x", "it") for t in texts]

    rows = spark.createDataFrame([(1, "Sigma answers"), (2, "nothing"), (3, "the assistant"), (4, None)], "i int, brief string")
    got = {r.i: r.rewritten for r in scenario.rewrite_briefs(rows, make, "brief").collect()}
    assert got == {1: "it answers", 2: "nothing", 3: None, 4: None}


def test_retry_after(spark):
    def make():
        calls = []

        class Busy(Exception):
            retry_after = 0.01

        def client(texts):
            calls.append(1)
            if len(calls) < 3:
                raise Busy
            return [t.upper() for t in texts]

        return client

    rows = spark.createDataFrame([(1, "a")], "i int, t string")
    assert scenario.call_model(rows, make, "t", wait=1000.0).first().response == "A"


def test_ledger_snapshots(spark, tmp_path):
    root = str(tmp_path)
    for version, n in (("0001", 1), ("0002", 2)):
        tables.write_ledger(spark.range(n), root, version)
    (tmp_path / "snapshots" / "0003").mkdir()
    assert tables.read_ledger(spark, root).count() == 2 and spark.read.parquet(f"{root}/history").count() == 3
    with pytest.raises(FileExistsError):
        tables.write_ledger(spark.range(1), root, "0002")


def test_layout_and_splits(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        release.layout(spark, str(tmp_path))
    for name in ("text_corpora", "text", "audio"):
        (tmp_path / name).mkdir()
    assert release.layout(spark, str(tmp_path)) == (f"{tmp_path}/text", f"{tmp_path}/audio")
    spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string").write.partitionBy("split").parquet(f"{tmp_path}/repo/v1")
    assert [r.id for r in tables.load_split(spark, f"{tmp_path}/repo", "v1", "test").collect()] == ["b"]


def test_manifests(spark, tmp_path):
    variations = spark.createDataFrame([("b", "couple", "y", "g2"), ("a", "single", "z", "g1"), ("a", "single", "x", "g9")], "category string, variant_type string, name string, group_key string")
    tables.write_variations(variations, spark.createDataFrame([("g1", "train"), ("g2", "test")], "group_key string, split string"), f"{tmp_path}/v")
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/v").collect()]
    assert {(g["category"], g["name"], g.get("split")) for g in got} == {("a", "x", None), ("a", "z", "train"), ("b", "y", "test")}
    out = tables.text_manifest(spark.createDataFrame([("s", 1), ("t", 2)], "scenario string, files int"), spark.createDataFrame([("s",), ("s",)], "scenario string"))
    assert {r.scenario: r.errors for r in out.collect()} == {"s": 2, "t": 0}


def test_turns_time_out(spark, tmp_path):
    schema = "who string, kind string, at timestamp, response string"
    batches = [[("a", "start", 0, None), ("b", "start", 0, None), ("b", "done", 5, "yes")], [("c", "start", 100, None), ("c", "done", 140, "late")], [("d", "start", 300, None)], [("d", "done", 301, "ok"), ("e", "start", 900, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(w, t, float(s), r) for w, t, s, r in rows], "who string, kind string, s double, response string").select("who", "kind", F.timestamp_seconds(F.col("s") + 1000).alias("at"), "response").coalesce(1).write.parquet(f"{tmp_path}/all/k{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all/*").withWatermark("at", "0 seconds")
    q = suppress.stream_timeouts(stream, "who", "kind", "start", "done", "at").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert q.awaitTermination(120)
    got = {r.who: r.response for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.get("a") == "[TIMEOUT]", got
    assert got["b"] == "yes" and got["c"] == "[TIMEOUT]" and got.get("d") == "ok"
