import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import align, audio, detect, incremental, quality, ratings, select, split, turns, vectors
from palaver.sources import tables
from palaver.streaming import suppress


def conv(spark, rows):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")


def test_labels(spark):
    df = conv(spark, [("A", "hi"), ("B", "Sigma, time?"), ("Sigma", "noon"), ("A", "and now?"), ("Sigma", "one"), ("A", None)])
    got = [r.trigger_type for r in turns.label_turns(df, "sigma", "Sigma").orderBy("turn").collect()]
    assert got == ["non-assistance", "direct", "contextual", "non-assistance"]
    ids = {r.role: r.speaker_id for r in turns.speaker_ids(conv(spark, [("A", ""), ("Sigma", ""), ("B", ""), ("A", "")]), "Sigma").collect()}
    assert ids == {"A": 2, "Sigma": 1, "B": 3}
    first = [r.first_interaction for r in turns.first_interaction(df, "Sigma").orderBy("turn").collect()]
    assert first == [True, True, True, False, False, False]


def test_times(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 2.5, 9.0), (1, 2, 7.0, 9.0)], "conv_id long, turn long, start double, duration double")
    assert [(r.start, r.end) for r in turns.turn_spans(df).orderBy("turn").collect()] == [(0.0, 2.5), (2.5, 7.0), (7.0, 9.0)]
    two = conv(spark, [("a", "x" * 10), ("b", "y" * 20)])
    assert [r.start for r in turns.estimate_turn_starts(two, F.lit(10.0)).orderBy("turn").collect()] == [0.0, 3.83]
    arr = spark.createDataFrame([([0.0, None, None, 8.0], 10.0), ([5.0, 3.0, 20.0], 10.0), ([], 1.0)], "s array<double>, d double")
    assert [r[0] for r in arr.select(turns.fill_starts(F.col("s"), F.col("d"))).collect()] == [[0.0, 4.0, 6.0, 8.0], [5.0, 5.0, 10.0], []]


def test_confusion_numbers(spark):
    rows = [(True, 1.0, "d")] * 255 + [(False, 1.0, "n")] * 19 + [(False, 0.0, "n")] * 3329 + [(True, 0.0, "c")] * 44
    df = spark.createDataFrame(rows, "expected boolean, score double, trigger_type string")
    r = detect.confusion(df).where("bucket = 'overall'").head()
    assert (r.precision, r.recall, r.f1, r.n) == (0.931, 0.853, 0.89, 3647)
    best = detect.best_threshold(detect.sweep(spark.createDataFrame([(False, 0.2, 1.0)], "expected boolean, score double, seconds double"))).head()
    assert best.threshold == 0.5
    swept = detect.sweep(df.withColumn("seconds", F.lit(1.0))).orderBy("threshold").collect()
    assert len(swept) == 19 and all(s.tp + s.fp + s.tn + s.fn == 3647 for s in swept) and all(a.tp + a.fp >= b.tp + b.fp for a, b in zip(swept, swept[1:]))


def test_early_stop(spark):
    df = spark.createDataFrame(list(enumerate([True, False, False, True, False, False, False, True])), "seq int, ok boolean")
    assert [r.seq for r in detect.early_stop(df).orderBy("seq").collect()] == list(range(7))


def test_ratings(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double")
    assert [round(r.p_adjusted, 9) for r in ratings.holm(df).orderBy("i").collect()] == [0.03, 0.06, 0.06, 0.02]
    r = spark.range(1).select(ratings.non_inferior(F.lit(-0.1), F.lit(0.115)).alias("x")).head().x
    assert r.non_inferior and abs(r.low + 0.289) < 0.001
    p = spark.createDataFrame([(0.5, 20), (0.0, 10), (1.0, 5), (0.3, 2)], "r double, n int").select(ratings.correlation_p("r", "n").alias("p")).collect()
    assert abs(p[0].p - 0.024764) < 1e-5 and abs(p[1].p - 1) < 1e-9 and p[2].p == 0 and p[3].p is None


def test_selection(spark):
    assert spark.range(1).select(select.needed_for_share(F.lit(100), F.lit(10), 0.3)).head()[0] == 29
    with pytest.raises(ValueError):
        select.needed_for_share(F.lit(1), F.lit(0), 1.0)
    over = spark.createDataFrame([("f1", "s", "Max", "m", ["Ben"], 2), ("f1", "t", "Max", "m", ["Ben"], 3), ("f0", "s", "Max", "m", [], 1), ("f2", "s", "Eva", "f", [], 4)], "file string, slot string, character string, gender string, present array<string>, seq int")
    pool = spark.createDataFrame([("Ben", "m", False, 0), ("Tom", "m", False, 1), ("Max", "m", True, 2), ("Kim", "m", False, 3)], "name string, gender string, protected boolean, position int")
    counts = spark.createDataFrame([("Tom", 1), ("Ben", 1), ("Kim", 1)], "name string, files long")
    got = {(r.file, r.slot): r.given for r in select.greedy_reassign(over, pool, counts).collect()}
    assert got == {("f0", "s"): "Ben", ("f1", "s"): "Tom", ("f1", "t"): "Kim", ("f2", "s"): None}
    assert select.rename("Max Maxine max, Max Power", {"Max": "Tom", "Max Power": "Al", "Tom": "X"}) == "Tom Maxine max, Al"


def test_incremental(spark):
    files = spark.createDataFrame([({"b": "2", "a": "1"},)], "f map<string,string>")
    assert files.select(incremental.composite_hash(F.col("f"))).head()[0] == __import__("hashlib").md5(json.dumps({"a": "1", "b": "2"}, sort_keys=True).encode()).hexdigest()
    old, new = (spark.createDataFrame(x, "group_key string, split string") for x in ([("a", "train"), ("b", "test"), ("c", "test")], [("a", "test"), ("b", "test"), ("d", "train")]))
    assert {r.group_key: r.change for r in split.drift(old, new).collect()} == {"a": "moved", "c": "removed", "d": "added"}
    pending = incremental.pending(spark.createDataFrame([("a", None), ("b", 1)], "id string, turn int"), spark.createDataFrame([("a", None)], "id string, turn int"), "id", "turn")
    assert [r.id for r in pending.collect()] == ["b"]
    m = spark.createDataFrame([(1, ["p", "q"], ["t"])], "id int, paths array<string>, texts array<string>")
    assert [tuple(r) for r in incremental.manifest_rows(m, "id").collect()] == [(1, 0, "p", "t")]


def test_detectors_on_odd_rows(spark):
    df = conv(spark, [(" ", None), ("a", "  "), ("a", "x")])
    assert quality.empty_utterances(df).count() == 2 and quality.missing_speakers(df).count() == 1
    raw = spark.createDataFrame([(1, 0, '{"speaker": "a"}'), (1, 1, '{"speaker": "a", "content": null}')], "conv_id long, turn long, json string")
    assert [r.message for r in quality.missing_fields(raw).collect()] == ["content"]
    assert quality.cache_coverage(df.limit(0), df, "turn").head().coverage == 1.0
    one = quality.quality_by(df.limit(1).select(F.lit("s").alias("k"), F.lit(3).alias("v")), "k", ["v"]).where("k = 's'").head()
    assert one.v_stdev == 0 and one.v_median == 3
    features = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", 5.0)], "g string, x double")
    got = {r.g: (r.x, r.x_std) for r in vectors.group_features(features, "g", ["x"]).collect()}
    assert got == {"a": (2.0, None), "b": (5.0, None)}
    assert vectors.separation_ratio(spark.createDataFrame([(1, [1.0, 0.0])], "g int, v array<float>"), "g", "v").head().ratio is None


def test_alignment(spark):
    words = [(w, i * 0.5) for i, w in enumerate("so hello there friend how are you today i am fine thanks and you then bye".split())]
    assert align.align([["hello", "there", "friend"], ["i", "am", "fine"], [], ["unheard", "words"], ["then", "bye"]], words) == [0.5, 4.0, None, None, 7.0]
    t = spark.createDataFrame([(1, 0, ["hello", "there"]), (1, 1, ["i", "am"])], "conv_id long, turn long, tokens array<string>")
    w = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(words)], "conv_id long, position long, word string, time double")
    assert [(r.start, r.matched) for r in align.align_turns(t, w).orderBy("turn").collect()] == [(0.5, True), (4.0, True)]


def test_audio(spark, tmp_path):
    rate = 16000
    tone = 0.5 * np.sin(2 * np.pi * 200 * np.arange(3 * rate) / rate)
    (tmp_path / "utterances").mkdir()
    for name, data in (("tone.wav", audio.encode(tone, rate)), ("quiet.wav", audio.encode(np.zeros(3 * rate), rate)), ("short.wav", audio.encode(tone[:rate], 11025)), ("loud.wav", audio.encode(np.clip(tone * 9, -1, 1), rate)), ("bad.wav", b"x"), ("utterances/u.wav", b"y")):
        (tmp_path / name).write_bytes(data)
    measured = audio.measure(audio.scan_wav(spark, str(tmp_path))).cache()
    found = {(r.path.rsplit("/")[-1], r.type) for r in audio.check(measured).collect()}
    assert found == {("quiet.wav", "non_silent"), ("short.wav", "min_duration"), ("short.wav", "sample_rate"), ("loud.wav", "clipping"), ("bad.wav", "readable")}
    assert audio.summarise(measured).head().files == 4
    assert abs(audio.pitch(tone, rate) - 200) < 3 and abs(audio.level(audio.loudness(tone)) + 20) < 0.01
    x = audio.resample(tone, rate, 8000)
    assert len(x) == 3 * 8000 and len(audio.cut(tone, rate, 1.0, 1.01)) == 800 and len(audio.fit_background(tone[:100], 250, 0.3)) == 250
    assert len(audio.mix([tone, tone], [-rate])) == 5 * rate and np.abs(audio.mix([tone, tone, tone], [-3 * rate, -3 * rate])).max() == 1
    out = audio.perturb(audio.scan_wav(spark, str(tmp_path)).where("path like '%tone%'"))
    rows = out.select("perturbation", audio.channel_features("content").alias("f")).collect()
    # The telephone band and the tilt take most of a tone of 200 Hz away.
    assert {r.perturbation for r in rows} == set(audio.PERTURBATIONS) and all(abs(r.f.median_f0_hz - 200) < 10 for r in rows if r.perturbation in ("noise_15db", "noise_5db", "reverb"))
    heard = {r.perturbation: audio.level(audio.decode(bytes(r.content))[0]) for r in out.collect()}
    assert heard["bandwidth_limit"] < -16 and heard["eq_tilt"] < -25 and heard["noise_5db"] > audio.level(tone)
    got, r2 = audio.decode(audio.encode(tone, rate))
    assert r2 == rate and np.abs(got - tone).max() < 1e-4


def test_sources(spark, tmp_path):
    root = tmp_path / "data"
    for p, t in (
        ("Home/single/a.json", {"name": "a", "variations": [{"variant_name": "v1", "max_turns": 0, "scenario_template": [{"phase": "p", "speakers": ["x", "y"]}]}, {"variant_name": "v2", "max_turns": 9}], "default_characters": {"block": {"u1": {"name": "Ann", "backstory_file": "ann.txt"}, "u2": {"name": "Bo"}}}}),
        ("Home/couple/no_va_b_long.json", {"name": "b", "variations": [{"variant_name": "v1"}]}), ("stray/top.json", {"name": "t", "variations": []}), ("Home/validation/r.json", {}),
    ):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(json.dumps(t, indent=1))
    (root / "Home/single/bad.json").write_text("{nope")
    (root / "Home/single/zero.json").write_text("")
    rows = tables.scan_variations(spark, str(root)).orderBy("path", "i").collect()
    assert [(r.category, r.stem, r.variant_name, r.turns, r.no_va, r.group_key) for r in rows] == [
        ("Home", "no_va_b_long", "v1", 12, True, "Home/couple/b"), ("Home", "a", "v1", 2, True, "Home/single/a"), ("Home", "a", "v2", 9, False, "Home/single/a")]
    assert sorted(r.path for r in tables.malformed_files(spark, str(root)).collect()) == ["Home/single/bad.json", "Home/single/zero.json"]
    assert [r.name for r in tables.scan_slots(spark, str(root), "block").collect()] == ["Ann"]
    index = {r.key: r.path for r in tables.config_index(spark, str(root)).collect()}
    assert index["v1"] == "Home/couple/no_va_b_long.json" and index["a"] == "Home/single/a.json"
    assert {r.key for r in tables.scenario_catalog(spark, str(root)).collect()} == {"a", "a_v1", "a_v2", "b", "b_v1", "t"}
    (tmp_path / "env").write_text("# c\nA=1\n\nB = \"x=y\"\n")
    assert {r.key: r.value for r in tables.key_values(spark, str(tmp_path / "env")).collect()} == {"A": "1", "B": "x=y"}
    out = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    tables.publish(out, str(tmp_path / "pub"))
    assert spark.read.parquet(str(tmp_path / "pub")).count() == 2
    with pytest.raises(ValueError):
        tables.publish(out.union(out), str(tmp_path / "pub2"))
    tables.write_manifest(spark.createDataFrame([("g2", "test"), ("g1", "train")], "group_key string, split string"), str(tmp_path / "man"), "s", (0.8, 0.1, 0.1))
    assert [(r.group_key, r.split, r.seed) for r in tables.split_manifest(spark, str(tmp_path / "man")).orderBy("group_key").collect()] == [("g1", "train", "s"), ("g2", "test", "s")]
    assert tables.resume_results(spark, str(tmp_path / "none"), "id string").count() == 0


def test_streaming_twin(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), i, str(rng.choice(["set", "reset", "audio"]))) for i in range(60)]
    df = spark.createDataFrame(rows, "user long, seq long, kind string")
    for k in range(3):
        df.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = suppress.stream_state(stream, "user", ["seq"], "kind", "set", "reset").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {(r.user, r.seq): r.suppressed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.user, r.seq): r.suppressed for r in suppress.batch_state(df, "user", ("seq",), F.col("kind") == "set", F.col("kind") == "reset").collect()}
    assert got == want
    c = spark.range(1).select(suppress.chunks(F.lit(10), 4).alias("c")).head().c
    assert [(x.start, x.length) for x in c] == [(0, 4), (4, 4), (8, 2)]


def test_audio_files(spark, tmp_path):
    rate = 44_100
    x = 0.2 * np.sin(np.arange(3 * rate) / 50)
    df = spark.createDataFrame([("a.wav", bytearray(audio.encode(x, rate))), ("low.wav", bytearray(audio.encode(x, 8000)))], "path string, content binary")
    parts = audio.fragments(df, seconds=1.0)
    assert sorted((r.path, r.i) for r in parts.collect()) == [("a.wav", 0), ("a.wav", 1), ("a.wav", 2)]
    named = parts.select(F.format_string("x/%s_%d.wav", "path", "i").alias("name"), "content")
    done = audio.write_files(named, f"file://{tmp_path}").collect()
    assert len(done) == 3 and all((tmp_path / r.name).stat().st_size == r.bytes for r in done) and len(list((tmp_path / "x").iterdir())) == 3
    scene = audio.assemble([(0.5, np.ones(100)), (0.5, np.ones(50))], np.ones(10), 100)
    assert len(scene) == 150 and np.abs(scene).max() == 1 and len(audio.assemble([], None, 100)) == 0


def test_lookups(spark):
    df = spark.createDataFrame([("rain", "soft"), ("street", None)], "title string, note string")
    assert [r.title for r in tables.files_for_scenario(df, ["SOFT"], "title", "note").collect()] == ["rain"]
    assert tables.files_for_scenario(df, ["sea"], "title", "note").count() == 2
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k string")
    assert [r.k for r in tables.only_missing(keys("a", "b_long", "c"), keys("c"), "k", skip_long=True).collect()] == ["a"]
    from palaver.functions import text as tx

    assert df.select(tx.padded(F.array(F.lit(1), F.lit(2)), 4, 0)).head()[0] == [1, 2, 0, 0] and df.select(tx.padded(F.array(F.lit(1), F.lit(2)), 1, 0)).head()[0] == [1]


def test_all_errors_agree_with_single_detectors(spark):
    df = tables.table(spark, "/root/testdata/sf0.001", "conversations").withColumn("text", F.when(F.col("turn") != 3, F.col("text")))
    every = {r.type: r.n for r in quality.all_errors(df, "that", ("ly", "er")).groupBy("type").agg(F.count("*").alias("n")).collect()}
    alone = {
        "short_dialogue": quality.short_dialogues(quality.conversation_sizes(df)).count(), "empty_utterance": quality.empty_utterances(df).count(),
        "invocation_missing": quality.missing_invocations(df, "that").count(), "filler_words": quality.filler_words(df, ("ly", "er")).count(), "duplicate_dialogue": quality.duplicate_dialogues(df).count(),
    }
    assert every == {k: n for k, n in alone.items() if n}


@pytest.mark.parametrize("span", [3, 1 << 20])
def test_early_stop_against_a_loop(spark, span):
    import random

    r = random.Random(1)
    for k in range(8):
        ok = [r.random() < 0.6 for _ in range(40)] if k else [True] * 5
        seqs = sorted(r.sample(range(200), len(ok)))
        want, run = [], 0
        for s, o in zip(seqs, ok):
            want.append(s)
            run = 0 if o else run + 1
            if run == 4:
                break
        rows = spark.createDataFrame(list(zip(seqs, ok)), "seq long, ok boolean").repartition(3)
        assert sorted(x.seq for x in detect.early_stop(rows, 4, span).collect()) == want


def test_identify_in_blocks(spark):
    import random

    r = random.Random(2)
    unit = lambda: [x / sum(v * v for v in vs) ** 0.5 for vs in [[r.gauss(0, 1) for _ in range(3)]] for x in vs]
    means = spark.createDataFrame([(g, unit()) for g in range(17)] + [(17, [1.0, 0.0, 0.0]), (18, [1.0, 0.0, 0.0])], "label int, centroid array<double>")
    rows = spark.createDataFrame([(i, i % 19, unit()) for i in range(40)] + [(99, 3, [1.0, 0.0, 0.0])], "id int, label int, v array<double>")
    one, many = (sorted(map(tuple, vectors.identify(rows, means, "label", "id", "v", block).collect())) for block in (100, 4))
    assert one == many and (99, 3, 17) in one


def test_reassign_by_gender(spark):
    pool = spark.createDataFrame([("Ann", "f", False, 0), ("Bea", "f", False, 1), ("Cid", "m", False, 2), ("Dan", "m", True, 3)], "name string, gender string, protected boolean, position int")
    counts = spark.createDataFrame([("Ann", 2), ("Cid", 5)], "name string, files int")
    over = spark.createDataFrame([("f1", "a", "X", "f", ["Bea"], 1), ("f2", "a", "X", "f", [], 2), ("f3", "a", "X", "f", [], 3), ("f4", "b", "Y", "m", ["Cid"], 4), ("f5", "b", "Y", "m", [], 5), ("f6", "b", "Z", "x", [], 6)], "file string, slot string, character string, gender string, present array<string>, seq int")
    got = {r.file: r.given for r in select.greedy_reassign(over, pool, counts).collect()}
    assert got == {"f1": "Ann", "f2": "Bea", "f3": "Bea", "f4": None, "f5": "Cid", "f6": None}


def test_starts_are_rounded_as_in_the_sql(spark):
    texts = [164, 152, 488, 124, 1472]
    rows = spark.createDataFrame([(1, i, "user", "x" * n) for i, n in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert [r.start for r in turns.estimate_turn_starts(rows, F.lit(60.0)).orderBy("turn").collect()] == [0.0, 4.64, 9.0, 21.35, 25.04]


def _vectors(spark):
    import random

    r = random.Random(5)
    made = [(i, i % 2, [r.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    odd = [(100, 0, None), (101, 0, [1.0, None, 2.0]), (102, 0, [1.0, 2.0]), (103, 0, [2.0, 2.0]), (104, 1, [float("nan"), 0.0, 1.0]), (7, 1, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (105, None, [1.0, 0.0, 0.0]), (106, 5, [1.0, 0.0, 0.0]), (107, 6, None), (108, 6, None)]
    return spark.createDataFrame(made + odd + [(200 + i, 1, made[1][2]) for i in range(5)], "k long, g int, v array<double>")


@pytest.mark.parametrize("block", [5, 1000])
def test_pairs_of_blocks_are_all_pairs(spark, block):
    df = _vectors(spark)
    a, b = (df.select("g", F.col("k").alias(f"k_{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    want = a.join(b, "g").where("k_a < k_b").select("g", "k_a", "k_b", vectors.distance(F.col("va"), F.col("vb")).alias("d"))
    shown = lambda rows: sorted(str((r[0], r[1], r[2], None if r[3] is None else f"{r[3]:.9f}")) for r in rows.collect())
    got = vectors.pairs_within(df, "g", "k", "v", block)
    assert shown(got) == shown(want) and got.where("distance is null").count() > 0
    joined = got._jdf.queryExecution().executedPlan().toString()
    assert "_i" in joined and "lambdafunction" not in joined.split("Join")[0]  # blocks, and compiled products


@pytest.mark.parametrize("bins", [4, 32768])
def test_percentiles_without_gathering_a_group(spark, bins):
    df = _vectors(spark)
    pairs = vectors.pairs_within(df, "g", "k", "v")
    got, want = vectors.pair_summary(df, "g", "k", "v", bins), vectors.summary(pairs, "distance", "g")
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
    shown = lambda rows: sorted(str([None if x is None else f"{x:.9f}" for x in r]) for r in rows.select("g", "n", "mean", "std", "median", "p5", "p95").collect())
    assert shown(got) == shown(want) and len(shown(got)) == 3
