"""Signal processing with NumPy alone: filters, resampling, rooms, spectra and voice measures.

Functions take mono samples as floats in [-1, 1] and the sampling rate; `audio` applies them to files.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SOUND_SPEED = 343.0
#: Telephone band, common band of recordings, room of the reverberation and its time.
TELEPHONE, COMMON_BAND = (300.0, 3400.0), (80.0, 7600.0)
ROOM, RT60 = (6.0, 5.0, 3.0), 0.6


def limit_peak(x: np.ndarray, ceiling: float = 0.98) -> np.ndarray:
    """Scaled down if a sample exceeds the ceiling."""
    top = np.abs(x).max(initial=0.0)
    return x * (ceiling / top) if top > ceiling else x


def band_pass(x: np.ndarray, rate: int, low: float, high: float, order: int = 4) -> np.ndarray:
    """Butterworth band-pass forwards and backwards: its squared gain, without a phase.

    Frequencies are warped as the bilinear transform does. The ends are mirrored about their samples.
    """
    if not len(x):
        return x
    pad = min(len(x) - 1, int(rate * 0.1))
    long = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad else x
    n = 1 << (len(long) - 1).bit_length()
    warp = lambda f: np.tan(np.pi * np.minimum(f, 0.499999 * rate) / rate)
    w, a, b = warp(np.fft.rfftfreq(n, 1 / rate)), warp(low), warp(min(high, 0.49 * rate))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 1 / (1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))
    gain[0] = 0
    return np.fft.irfft(np.fft.rfft(long, n) * gain, n)[pad : pad + len(x)]


def telephone(x: np.ndarray, rate: int) -> np.ndarray:
    return limit_peak(band_pass(x, rate, *TELEPHONE, order=4))


def pre_emphasis(x: np.ndarray, coefficient: float = 0.95) -> np.ndarray:
    return limit_peak(np.concatenate((x[:1], x[1:] - coefficient * x[:-1])))


def windowed_sinc(x: np.ndarray, source: int, target: int, half: float, cutoff: float, window, count: int) -> np.ndarray:
    """Band-limited interpolation: each new sample is a sum of old ones within half zero crossings, weighted by sinc and window.

    cutoff: band edge in samples a second; window: function of [-1, 1]. Outputs are made in slices.
    """
    reach = int(math.ceil(half * source / cutoff))
    padded = np.pad(np.asarray(x, float), reach + 1)
    out = np.empty(count)
    taps = np.arange(-reach, reach + 1)
    for lo in range(0, count, 1 << 14):
        at = np.arange(lo, min(count, lo + (1 << 14))) * (source / target)
        middle = np.floor(at + 1e-9).astype(np.int64)
        t = ((middle[:, None] + taps) - at[:, None]) * (cutoff / source)
        weight = np.where(np.abs(t) <= half, np.sinc(t) * window(np.clip(t / half, -1, 1)), 0.0) * (cutoff / source)
        index = np.clip(middle[:, None] + taps + reach + 1, 0, len(padded) - 1)
        out[lo : lo + len(at)] = (padded[index] * weight).sum(axis=1)
    return out


def resample_sinc(x: np.ndarray, source: int, target: int, zeros: int = 16, rolloff: float = 0.99) -> np.ndarray:
    """Resampling with a Hann-windowed sinc of so many zero crossings."""
    if source == target or not len(x):
        return x
    return windowed_sinc(x, source, target, zeros, min(source, target) * rolloff, lambda u: np.cos(u * np.pi / 2) ** 2, -(-len(x) * target // source))


def resample_polyphase(x: np.ndarray, source: int, target: int, beta: float = 5.0) -> np.ndarray:
    """Resampling by a rational factor with a Kaiser-windowed low-pass of ten periods on each side."""
    if source == target or not len(x):
        return x
    g = math.gcd(source, target)
    up, down = target // g, source // g
    edge = min(source, target)
    return windowed_sinc(x, source, target, 10, edge, lambda u: np.i0(beta * np.sqrt(np.maximum(0.0, 1 - u * u))) / np.i0(beta), -(-len(x) * up // down))


@lru_cache(maxsize=8)
def room_response(rate: int, rt60: float = RT60, room: tuple = ROOM, source: tuple = (1.5, 1.5, 1.5), microphone: tuple | None = None) -> np.ndarray:
    """Impulse response of a box by mirror images, walls as absorbent as Sabine's formula asks for the time."""
    size = np.array(room)
    mic = np.array(microphone or (room[0] - 1.5, room[1] - 1.5, 1.5))
    surface = 2 * (room[0] * room[1] + room[0] * room[2] + room[1] * room[2])
    absorption = min(0.999, 24 * math.log(10) / SOUND_SPEED * np.prod(size) / (surface * rt60))
    reflection = math.sqrt(1 - absorption)
    length, axes = int(rt60 * rate), []
    for k in range(3):
        most = int(rt60 * SOUND_SPEED / (2 * size[k])) + 1
        n = np.arange(-most, most + 1)
        place = np.concatenate((2 * n * size[k] + source[k], 2 * n * size[k] - source[k]))
        axes.append((place - mic[k], np.concatenate((np.abs(2 * n), np.abs(2 * n - 1)))))
    (x, ox), (y, oy), (z, oz) = axes
    out = np.zeros(length + 2)
    for dx, order in zip(x, ox, strict=True):
        distance = np.sqrt(dx * dx + y[:, None] ** 2 + z[None, :] ** 2).ravel()
        gain = (reflection ** (order + oy[:, None] + oz[None, :])).ravel() / (4 * np.pi * np.maximum(distance, 0.1))
        at = distance * rate / SOUND_SPEED
        near = at < length
        low = at[near].astype(np.int64)
        part = at[near] - low
        np.add.at(out, low, gain[near] * (1 - part))
        np.add.at(out, low + 1, gain[near] * part)
    return out[:length]


def convolve(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    n = 1 << (len(x) + len(response) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(response, n), n)[: len(x)]


def reverberate(x: np.ndarray, rate: int, rt60: float = RT60) -> np.ndarray:
    return limit_peak(convolve(x, room_response(rate, rt60)))


def room_mix(parts: list[tuple[float, np.ndarray, tuple]], rate: int, background: np.ndarray | None = None, peak: float = 0.5, background_gain: float = 0.6, final: float = 0.9) -> np.ndarray:
    """Utterances (start second, samples, place in the room), each brought to a peak and heard from its place, over a background; scaled to the final peak."""
    length = max((round(at * rate) + len(x) for at, x, _ in parts), default=0)
    out = np.zeros(length)
    for at, x, place in parts:
        top = np.abs(x).max(initial=0.0)
        wet = convolve(x * (peak / top) if top > 0 else x, room_response(rate, source=tuple(place)))
        start = round(at * rate)
        out[start : start + len(x)] += wet
    if background is not None and len(background):
        out += background_gain * np.resize(background, length)
    top = np.abs(out).max(initial=0.0)
    return out * (final / top) if top > 0 else out


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def flatness(x: np.ndarray, size: int = 2048, hop: int = 512) -> float | None:
    """Mean over frames of geometric by arithmetic mean of the power spectrum."""
    if not len(x):
        return None
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.maximum(np.abs(np.fft.rfft(frames_of(np.pad(x, size // 2), size, hop) * window)) ** 2, 1e-10)
    return float(np.mean(np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)))


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz, float) / 700.0)


def filter_banks(x: np.ndarray, rate: int, bins: int = 80, frame: float = 0.025, hop: float = 0.010, low: float = 20.0, high: float = 0.0) -> np.ndarray:
    """Log mel energies (frames x bins): frames without their mean, pre-emphasised, under a window raised to 0.85."""
    size, step = int(frame * rate), int(hop * rate)
    own = frames_of(np.asarray(x, float), size, step)
    if not len(own):
        return np.zeros((0, bins))
    own = own - own.mean(axis=1, keepdims=True)
    own = own - 0.97 * np.concatenate((own[:, :1], own[:, :-1]), axis=1)
    own = own * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    n = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(own, n)) ** 2
    edges = np.linspace(mel(low), mel(high if high > 0 else rate / 2 + high), bins + 2)
    at = mel(np.arange(n // 2) * rate / n)
    left, middle, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    weight = np.maximum(0.0, np.minimum((at - left) / (middle - left), (right - at) / (right - middle)))
    return np.log(np.maximum(power[:, : n // 2] @ weight.T, np.finfo(np.float32).eps))


def cepstra(x: np.ndarray, rate: int, count: int = 13, bins: int = 23, lifter: float = 22.0) -> np.ndarray:
    """Cosine transform of the log mel energies, lifted."""
    energies = filter_banks(x, rate, bins)
    k, n = np.arange(count)[:, None], np.arange(bins)[None, :]
    basis = np.sqrt(2.0 / bins) * np.cos(np.pi / bins * (n + 0.5) * k)
    basis[0] = np.sqrt(1.0 / bins)
    return energies @ basis.T * (1 + 0.5 * lifter * np.sin(np.pi * np.arange(count) / lifter))


def _voiced(x: np.ndarray, rate: int, low: float = 75.0, high: float = 600.0, least: float = 0.45):
    """(start, period in samples, autocorrelation at it) of the voiced frames of 40 ms."""
    size = int(0.04 * rate)
    window = np.hanning(size)
    own = window * window
    base = np.correlate(own, own, "full")[size - 1 :] if size < 64 else np.fft.irfft(np.abs(np.fft.rfft(window, 4 * size)) ** 2)[:size]
    out = []
    for i, f in enumerate(frames_of(x, size, size // 4)):
        f = (f - f.mean()) * window
        energy = float(f @ f)
        if energy < 1e-6:
            continue
        r = np.fft.irfft(np.abs(np.fft.rfft(f, 4 * size)) ** 2)[:size] / energy / np.maximum(base / base[0], 1e-3)
        a, b = int(rate / high), min(int(rate / low), size - 2)
        k = a + int(np.argmax(r[a:b]))
        if r[k] >= least:
            bend = r[k - 1] - 2 * r[k] + r[k + 1]
            shift = 0.5 * (r[k - 1] - r[k + 1]) / bend if bend else 0.0
            out.append((i * (size // 4), k + shift, min(0.999999, float(r[k]))))
    return out


def voice(x: np.ndarray, rate: int) -> dict[str, float | None]:
    """Pitch, harmonicity, jitter, shimmer and formants, from autocorrelation and linear prediction; null where nothing is voiced.

    Estimators of our own: their values are near a phonetics package's, not equal to them.
    """
    names = ("median_f0_hz", "f0_range_hz", "f0_std_hz", "f0_cv", "hnr_db", "jitter_local_pct", "shimmer_local_pct", "f1_hz", "f2_hz", "f3_hz")
    total = len(frames_of(x, int(0.04 * rate), int(0.04 * rate) // 4))
    found = _voiced(x, rate)
    out: dict[str, float | None] = dict.fromkeys(names)
    out["voiced_fraction"] = len(found) / total if total else None
    if not found:
        return out
    start, period, strength = (np.array(c) for c in zip(*found, strict=True))
    f0 = rate / period
    median, spread = float(np.median(f0)), float(np.std(f0))
    near = np.diff(start) == np.diff(start).min(initial=1 << 30)
    steps = np.abs(np.diff(period))[near]
    peaks = np.array([np.abs(x[s : s + int(0.04 * rate)]).max() for s in start])
    out |= {
        "median_f0_hz": median, "f0_range_hz": float(np.percentile(f0, 95) - np.percentile(f0, 5)), "f0_std_hz": spread, "f0_cv": spread / median,
        "hnr_db": float(np.mean(10 * np.log10(strength / (1 - strength)))),
        "jitter_local_pct": float(100 * steps.mean() / period.mean()) if len(steps) else None,
        "shimmer_local_pct": float(100 * np.abs(np.diff(peaks))[near].mean() / peaks.mean()) if len(steps) else None,
    }
    tracks = [f for f in (formants(x[s : s + int(0.04 * rate)], rate) for s in start.tolist()) if len(f) >= 3]
    for k in range(3):
        out[f"f{k + 1}_hz"] = float(np.median([t[k] for t in tracks])) if tracks else None
    return out


def formants(frame: np.ndarray, rate: int, most: float = 5500.0) -> list[float]:
    """Resonances of a frame: angles of the poles of a linear predictor, two for each kilohertz or so."""
    x = np.append(frame[:1], frame[1:] - 0.97 * frame[:-1]) * np.hamming(len(frame))
    order = 2 + int(min(rate / 2, most) / 1000 * 2)
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: order + 1]
    if r[0] <= 0:
        return []
    index = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    a = np.linalg.solve(r[index] + 1e-9 * r[0] * np.eye(order), r[1:])
    roots = np.roots(np.concatenate(([1.0], -a)))
    roots = roots[roots.imag > 0.01]
    hz, width = np.angle(roots) * rate / (2 * np.pi), -np.log(np.abs(roots)) * rate / np.pi
    return sorted(hz[(hz > 90) & (hz < min(rate / 2, most)) & (width < 700)].tolist())
