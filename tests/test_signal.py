"""Signal operators against closed forms and plain loops; the mixed model against a dense likelihood."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import audio, ratings, signal

RATE = 16_000
T = np.arange(RATE) / RATE


def tone(hz, rate=RATE, seconds=1.0):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def rms(x):
    return float(np.sqrt(np.mean(x**2)))


def test_band_pass():
    for hz, gain in ((1000, 1.0), (300, 0.5), (3400, 0.5), (60, 0.0), (7000, 0.0)):
        out = signal.band_pass(tone(hz), RATE, 300, 3400)
        assert abs(rms(out[2000:-2000]) / rms(tone(hz)) - gain) < 0.02
    assert len(signal.band_pass(np.zeros(0), RATE, 300, 3400)) == 0 and len(signal.telephone(tone(500, seconds=0.01), RATE)) == 160


@pytest.mark.parametrize("resample", [signal.resample_sinc, signal.resample_polyphase])
@pytest.mark.parametrize("source, target", [(44_100, 16_000), (16_000, 24_000), (24_000, 22_050)])
def test_resampling(resample, source, target):
    out = resample(tone(440, source), source, target)
    want = tone(440, target)
    assert len(out) == len(want) and np.abs(out - want)[200:-200].max() < 0.01
    high = resample(tone(0.49 * source, source), source, target)
    assert target > source or rms(high[300:-300]) < 0.1
    assert resample(tone(9), 8000, 8000) is not None and len(resample(np.zeros(0), source, target)) == 0


def test_room():
    h = signal.room_response(RATE)
    direct = math.dist((1.5, 1.5, 1.5), (4.5, 3.5, 1.5))
    at = direct / signal.SOUND_SPEED * RATE
    assert abs(np.flatnonzero(h)[0] - int(at)) <= 1 and abs(h[int(at) : int(at) + 2].sum() - 1 / (4 * np.pi * direct)) < 1e-3
    energy = np.cumsum((h**2)[::-1])[::-1]
    fall = 10 * np.log10(energy / energy[0] + 1e-30)
    slope = np.polyfit(np.flatnonzero((fall < -5) & (fall > -25)) / RATE, fall[(fall < -5) & (fall > -25)], 1)[0]
    assert 0.3 < -60 / slope < 1.2
    assert np.allclose(signal.convolve(tone(300)[:50], h[:400]), np.convolve(tone(300)[:50], h[:400])[:50])
    mixed = signal.room_mix([(0.0, tone(200), (1.5, 1.5, 1.5)), (0.5, tone(300), (3.0, 2.0, 1.5))], RATE, np.ones(10) * 0.01)
    assert len(mixed) == RATE * 3 // 2 and abs(np.abs(mixed).max() - 0.9) < 1e-9 and len(signal.room_mix([], RATE)) == 0


def test_spectra():
    noise = np.random.default_rng(1).normal(size=RATE) * 0.1
    assert signal.flatness(noise) > 0.4 > 0.05 > signal.flatness(tone(440)) and signal.flatness(np.zeros(0)) is None
    banks = signal.filter_banks(tone(1000), RATE, 40)
    edges = np.linspace(signal.mel(20), signal.mel(8000), 42)
    assert banks.shape == (98, 40) and np.abs(edges[1:-1] - signal.mel(1000)).argmin() == banks.mean(axis=0).argmax()
    c = signal.cepstra(noise, RATE)
    energies = signal.filter_banks(noise, RATE, 23)
    for k in (0, 1, 12):
        scale = math.sqrt((1 if k == 0 else 2) / 23) * (1 + 11 * math.sin(math.pi * k / 22))
        assert np.allclose(c[:, k], scale * sum(energies[:, n] * math.cos(math.pi / 23 * (n + 0.5) * k) for n in range(23)))
    assert signal.filter_banks(np.zeros(10), RATE).shape == (0, 80)


def test_voice():
    pulses = np.zeros(RATE)
    pulses[:: RATE // 125] = 1.0
    x = pulses
    for hz, width in ((700, 80), (1200, 90), (2600, 120)):
        r, w = math.exp(-math.pi * width / RATE), 2 * math.pi * hz / RATE
        y = np.zeros_like(x)
        for i in range(len(x)):
            y[i] = x[i] + 2 * r * math.cos(w) * y[i - 1] - r * r * y[i - 2]
        x = y
    v = signal.voice(0.5 * x / np.abs(x).max(), RATE)
    assert abs(v["median_f0_hz"] - 125) < 1 and v["hnr_db"] > 15 and v["jitter_local_pct"] < 0.5 and v["voiced_fraction"] > 0.9
    assert all(abs(v[k] - hz) < 0.1 * hz for k, hz in (("f1_hz", 700), ("f2_hz", 1200), ("f3_hz", 2600)))
    assert signal.voice(np.zeros(RATE), RATE)["median_f0_hz"] is None and signal.voice(np.zeros(3), RATE)["voiced_fraction"] is None


def test_feature_rows(spark):
    content = audio.encode(tone(200), RATE)
    df = spark.createDataFrame([("a", "one two three", content), ("b", " ", content)], "utterance_id string, text string, content binary")
    rows = {r.utterance_id: r for r in audio.feature_rows(df).collect()}
    assert abs(rows["a"].speaking_rate_wps - 3.0) < 1e-6 and rows["b"].speaking_rate_wps is None and abs(rows["a"].median_f0_hz - 200) < 2 and rows["a"].spectral_flatness < 0.05
    assert len(df.select(audio.mel_features("content").alias("m")).first().m) == 98


def test_mixed_model_against_the_dense_likelihood(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(8):
        u = rng.normal() * 0.6
        for c in range(4):
            v, x = rng.normal() * 0.4, (p + c) % 2
            rows += [(p, c, float(3 + 0.25 * x + u + v + rng.normal() * 0.5), bool(x)) for _ in range(rng.integers(1, 4))]
    df = spark.createDataFrame(rows, "participant int, clip int, score double, proposed boolean")
    got = ratings.mixed_fit(df, F.col("proposed"))
    person, clip, y, x = (np.array(k) for k in zip(*rows))
    design = np.stack((np.ones(len(y)), x.astype(float)), axis=1)
    same_person = person[:, None] == person
    same_clip = same_person & (clip[:, None] == clip)

    def minus_twice(a, b, r):
        v = r * np.eye(len(y)) + a * same_person + b * same_clip
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(design.T @ inverse @ design, design.T @ inverse @ y)
        e = y - design @ beta
        return np.linalg.slogdet(v)[1] + e @ inverse @ e, beta, np.sqrt(np.linalg.inv(design.T @ inverse @ design)[1, 1])

    here = (got["participant"], got["clip"], got["residual"])
    value, beta, error = minus_twice(*here)
    assert np.allclose((got["intercept"], got["difference"], got["error"]), (*beta, error), atol=1e-8)
    for k in range(3):
        for f in (0.97, 1.03):
            there = list(here)
            there[k] *= f
            assert minus_twice(*there)[0] > value
    none = ratings.mixed_fit(df.withColumn("score", F.lit(1.0) + F.rand(1)), F.col("proposed"))
    assert none["error"] > 0 and none["participant"] >= 0
