"""Audio as rows: WAV headers and checks over binaryFile scans, and signal operators on arrays.

Bytes stay in one column and are decoded inside Arrow-batched functions; everything derived
is a plain column, so rules on it are native filters.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palaver.operators import signal

KNOWN_RATES = (8000, 16000, 22050, 24000, 44100, 48000)
MIN_SECONDS, SILENT_RMS, MOSTLY_SILENT, OFTEN_SILENT, CLIPPED_SHARE = 2.0, 0.001, 0.95, 0.5, 1e-4


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples in [-1, 1] and the rate of a WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(to_pcm(samples))
    return out.getvalue()


def to_pcm(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()


def silence(seconds: float, rate: int) -> np.ndarray:
    return np.zeros(int(round(seconds * rate)))


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate; the duration stays as it is."""
    if source == target or not len(samples):
        return samples
    n = max(1, round(len(samples) / source * target))
    return np.interp(np.arange(n) / target, np.arange(len(samples)) / source, samples)


def cut(samples: np.ndarray, rate: int, start: float, end: float, least: float = 0.05) -> np.ndarray:
    """Samples of a span; a span shorter than the least is silence of that length."""
    if end - start < least:
        return silence(least, rate)
    part = samples[max(0, round(start * rate)) : round(end * rate)]
    return part if len(part) >= least * rate else np.pad(part, (0, max(0, round(least * rate) - len(part))))


def fit_background(samples: np.ndarray, length: int, position: float) -> np.ndarray:
    """Crops or loops to a length; position in [0, 1) picks where the crop or the loop begins."""
    if length <= 0 or not len(samples):
        return np.zeros(0)
    if len(samples) >= length:
        at = int(position * (len(samples) - length + 1))
        return samples[at : at + length]
    turned = np.roll(samples, -int(position * len(samples)))
    return np.resize(turned, length)


def mix(signals: list[np.ndarray], gaps: list[int]) -> np.ndarray:
    """One after the other; a negative gap overlaps the next onto the one before. Sums are clipped."""
    at, starts = 0, []
    for i, s in enumerate(signals):
        starts.append(at)
        at = max(0, at + len(s) + (gaps[i] if i < len(gaps) else 0))
    out = np.zeros(max((a + len(s) for a, s in zip(starts, signals, strict=True)), default=0))
    for a, s in zip(starts, signals, strict=True):
        out[a : a + len(s)] += s
    return np.clip(out, -1, 1)


def overlay(speech: np.ndarray, background: np.ndarray, below_db: float) -> np.ndarray:
    """Speech over a background that many decibels below it."""
    if not len(speech):
        return speech
    gain = 10 ** ((level(speech) - below_db - level(background)) / 20) if len(background) else 0.0
    return np.clip(speech + gain * np.resize(background, len(speech)) if len(background) else speech, -1, 1)


def level(samples: np.ndarray) -> float:
    """RMS level in dB relative to full scale."""
    return float(20 * np.log10(np.sqrt(np.mean(samples**2) + 1e-12) + 1e-12)) if len(samples) else -240.0


def loudness(samples: np.ndarray, target: float = -20.0, peak: float = 0.98) -> np.ndarray:
    out = samples * 10 ** ((target - level(samples)) / 20)
    top = np.abs(out).max(initial=0)
    return out * (peak / top) if top > peak else out


def add_noise(samples: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    noise = np.random.Generator(np.random.PCG64(seed)).normal(size=len(samples))
    return np.clip(samples + noise * np.sqrt(np.mean(samples**2) / 10 ** (snr_db / 10)), -1, 1)


def tilt(samples: np.ndarray, db_per_octave: float, pivot: float, rate: int) -> np.ndarray:
    """Raises or lowers the spectrum by so much per octave from a pivot frequency."""
    spectrum, hz = np.fft.rfft(samples), np.fft.rfftfreq(len(samples), 1 / rate)
    gain = np.ones_like(hz)
    gain[1:] = 10 ** (db_per_octave * np.log2(hz[1:] / pivot) / 20)
    return np.clip(np.fft.irfft(spectrum * gain, len(samples)), -1, 1)


def assemble(parts: list[tuple[float, np.ndarray]], background: np.ndarray | None, rate: int, background_gain: float = 0.3) -> np.ndarray:
    """Signals at their start seconds over a looped background; the sum is scaled down if it would clip."""
    length = max((round(at * rate) + len(x) for at, x in parts), default=0)
    out = np.zeros(length) if background is None or not len(background) else background_gain * np.resize(background, length)
    for at, x in parts:
        start = round(at * rate)
        out[start : start + len(x)] += x
    return out / max(1.0, np.abs(out).max(initial=0))


#: Perturbations by name: (samples, rate) to samples.
PERTURBATIONS = {
    "bandwidth_limit": signal.telephone,
    "eq_tilt": lambda x, rate: signal.pre_emphasis(x),
    "reverb": signal.reverberate,
    "noise_15db": lambda x, rate: add_noise(x, 15.0, 15),
    "noise_5db": lambda x, rate: add_noise(x, 5.0, 5),
}


def normalize_channel(samples: np.ndarray, rate: int) -> np.ndarray:
    """Common band, then common loudness."""
    return loudness(signal.band_pass(samples, rate, *signal.COMMON_BAND, order=2))


def features(samples: np.ndarray, rate: int) -> dict[str, float | None]:
    """Channel features of a recording."""
    if not len(samples):
        return dict.fromkeys(("effective_bandwidth_hz", "spectral_slope_db", "estimated_snr_db", "clipping_rate", "spectral_flatness", "median_f0_hz"))
    power, hz = np.abs(np.fft.rfft(samples)) ** 2, np.fft.rfftfreq(len(samples), 1 / rate)
    total = power.sum()
    band = float(hz[min(int(np.searchsorted(np.cumsum(power) / total, 0.99)), len(hz) - 1)]) if total > 0 else None
    low, high = power[hz < 1000].sum(), power[hz > 4000].sum()
    slope = float(10 * np.log10((low + 1e-12) / (high + 1e-12))) if high > 0 else None
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(samples, 256), 512)[::256]
    rms = np.sqrt((frames**2).mean(axis=1))
    floor, speech = np.percentile(rms, (10, 50))
    snr = float(20 * np.log10((speech + 1e-12) / (floor + 1e-12))) if len(rms) >= 10 and floor > 0 else None
    return {"effective_bandwidth_hz": band, "spectral_slope_db": slope, "estimated_snr_db": snr, "clipping_rate": float(np.mean(np.abs(samples) >= 0.99)), "spectral_flatness": signal.flatness(samples), "median_f0_hz": pitch(samples, rate)}


def pitch(samples: np.ndarray, rate: int) -> float | None:
    """Median autocorrelation pitch of the frames that are loud and periodic, between 70 and 300 Hz."""
    n, low, high = int(0.03 * rate), rate // 300, rate // 70
    found = []
    for at in range(0, len(samples) - n, n):
        f = samples[at : at + n]
        if np.sqrt(np.mean(f**2)) >= 0.02 and high < n:
            f = f - f.mean()
            c = np.fft.irfft(np.abs(np.fft.rfft(f, 2 * n)) ** 2)[:n]
            k = low + int(c[low:high].argmax())
            if c[k] > 0.3 * c[0]:
                found.append(rate / k)
    return float(np.median(found)) if found else None


def scan_wav(spark: SparkSession, root: str, excluded=("utterances", "validation")) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    for part in excluded:
        rows = rows.where(~F.contains(F.col("path"), F.lit(f"/{part}/")))
    return rows.select("path", "content")


MEASURES = "path string, readable boolean, seconds double, rate int, channels int, rms double, silent_share double, clipped_share double"


def measure(files: DataFrame) -> DataFrame:
    """Header, loudness, silence in 10 ms frames and clipping of each file; unreadable ones keep nulls."""

    def one(data: bytes):
        try:
            x, rate = decode(bytes(data))
            with wave.open(io.BytesIO(bytes(data))) as w:
                channels = w.getnchannels()
        except Exception:  # any malformed file is unreadable
            return False, None, None, None, None, None, None
        n = max(1, rate // 100)
        frames = x[: len(x) // n * n].reshape(-1, n)
        silent = float((np.sqrt((frames**2).mean(axis=1)) < SILENT_RMS).mean()) if len(frames) else None
        # 16-bit samples reach -1 but only 32767 / 32768 on the other side.
        clipped = float((np.abs(x) >= 1 - 1 / 32768).mean()) if len(x) else 0.0
        return True, len(x) / rate, rate, channels, float(np.sqrt(np.mean(x**2))) if len(x) else 0.0, silent, clipped

    names = [f.split()[0] for f in MEASURES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *one(c)) for p, c in zip(f["path"], f["content"], strict=True)], columns=names).astype({"rate": "Int32", "channels": "Int32"})

    return files.select("path", "content").mapInPandas(run, MEASURES)


def check(measured: DataFrame) -> DataFrame:
    """Error records of the audio rules, one row per file and rule that it breaks."""
    rule = lambda when, severity, kind: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type")))
    c = F.col
    rules = F.array(
        rule(~c("readable"), "critical", "readable"),
        rule(c("seconds") < MIN_SECONDS, "critical", "min_duration"),
        rule(c("silent_share") >= MOSTLY_SILENT, "critical", "non_silent"),
        rule((c("silent_share") > OFTEN_SILENT) & (c("silent_share") < MOSTLY_SILENT), "warning", "high_silence_ratio"),
        rule(~c("rate").isin(*KNOWN_RATES), "warning", "sample_rate"),
        rule(c("clipped_share") >= CLIPPED_SHARE, "warning", "clipping"),
    )
    return measured.select("path", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("e")).select("path", "e.severity", "e.type")


def summarise(measured: DataFrame) -> DataFrame:
    return measured.where("readable").agg(F.count("*").alias("files"), F.min("seconds").alias("shortest"), F.max("seconds").alias("longest"), F.avg("seconds").alias("mean"), F.sum("seconds").alias("total"), F.avg("rms").alias("rms"), F.array_sort(F.collect_set("rate")).alias("rates"))


def gender_mismatch(pitch_hz: Column, gender: Column, spread: Column) -> Column:
    """Pitch and stated gender disagree, in voices that vary little."""
    return (spread < 40) & (((gender == "male") & (pitch_hz > 165)) | ((gender == "female") & (pitch_hz < 150)))


def perturb(files: DataFrame, names=tuple(PERTURBATIONS)) -> DataFrame:
    """Every file under every perturbation: path, perturbation, content, and the two ids joined by __."""
    rows = files.withColumn("perturbation", F.explode(F.array(*map(F.lit, names))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, c, k in zip(f["path"], f["content"], f["perturbation"], strict=True):
                x, rate = decode(bytes(c))
                out.append((p, k, f"{p}__{k}", encode(PERTURBATIONS[k](x, rate), rate)))
            yield pd.DataFrame(out, columns=["path", "perturbation", "variant_id", "content"])

    return rows.select("path", "content", "perturbation").mapInPandas(run, "path string, perturbation string, variant_id string, content binary")


def fragments(files: DataFrame, seconds: float = 60.0, least_rate: int = 44_100) -> DataFrame:
    """path, i, content of each whole stretch of so many seconds, of files of at least the rate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                x, rate = decode(bytes(content))
                n = int(seconds * rate)
                if rate >= least_rate and n:
                    yield pd.DataFrame([(path, i, encode(x[i * n : (i + 1) * n], rate)) for i in range(len(x) // n)], columns=["path", "i", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, i int, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes name, content to single files below a folder that all executors reach; returns what was written.

    A file is written beside its place and then renamed, so a task that runs again leaves whole files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for f in frames:
            sizes = []
            for name, content in zip(f["name"], f["content"], strict=True):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
                    out.write(bytes(content))
                store.move(part, path)
                sizes.append(len(content))
            yield pd.DataFrame({"name": f["name"], "bytes": sizes})

    return files.select("name", "content").mapInPandas(run, "name string, bytes long")


_FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("effective_bandwidth_hz", "spectral_slope_db", "estimated_snr_db", "clipping_rate", "spectral_flatness", "median_f0_hz")])


@F.pandas_udf(_FEATURES)
def channel_features(content: pd.Series) -> pd.DataFrame:
    """features() of WAV bytes, as a struct."""
    return pd.DataFrame([features(*decode(bytes(c))) for c in content], columns=_FEATURES.names, dtype="float64")


_VOICE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("median_f0_hz", "f0_range_hz", "f0_std_hz", "f0_cv", "voiced_fraction", "hnr_db", "jitter_local_pct", "shimmer_local_pct", "f1_hz", "f2_hz", "f3_hz")])


@F.pandas_udf(_VOICE)
def voice_features(content: pd.Series) -> pd.DataFrame:
    """signal.voice() of WAV bytes, as a struct."""
    return pd.DataFrame([signal.voice(*decode(bytes(c))) for c in content], columns=_VOICE.names, dtype="float64")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def mel_features(content: pd.Series) -> pd.Series:
    """signal.filter_banks() of WAV bytes: an array of frames."""
    return pd.Series([signal.filter_banks(*decode(bytes(c))).astype(np.float32).tolist() for c in content])


def feature_rows(files: DataFrame) -> DataFrame:
    """utterance_id, text and more of files (with content), with channel and voice features and the speaking rate, one column each."""
    rows = files.withColumns({"_c": channel_features("content"), "_v": voice_features("content"), "_s": wav_seconds("content")})
    keep = [F.col(c) for c in files.columns if c != "content"]
    channel = [F.col(f"_c.{f.name}") for f in _FEATURES.fields if f.name != "median_f0_hz"]
    rate = F.when(F.length(F.trim("text")) > 0, F.try_divide(F.regexp_count("text", F.lit(r"(?U)\S+")), F.nullif("_s", F.lit(0.0)))).alias("speaking_rate_wps")
    return rows.select(*keep, *channel, *(F.col(f"_v.{f.name}") for f in _VOICE.fields), rate)


@F.pandas_udf(T.DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    found = [decode(bytes(c)) for c in content]
    return pd.Series([len(x) / rate if rate else None for x, rate in found], dtype="float64")
