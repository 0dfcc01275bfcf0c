"""Words of whole texts as 64-bit hashes, vectorised over Arrow batches.

A word is a maximal run of letters, marks and digits of the lower-cased text; everything
else separates. Null text counts as empty. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SEPARATOR = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240817))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Lead bytes of characters that may be no letters; C3 has letters besides two signs.
ODD_LEAD = np.array([b >= 0xC2 and b != 0xC3 for b in range(256)])
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from exponent 0; kept for later calls."""
    if len(_powers.get("up", ())) < n:
        for k, b in (("up", BASE), ("down", BASE_INVERSE)):
            a = np.full(max(n, 1 << 21), b, dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def plain(texts: pa.Array, separator: regex.Pattern = SEPARATOR) -> pa.Array:
    """Lower case; texts with characters beyond plain Latin letters get spaces for separators."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    data, offsets = raw(texts)
    odd = np.concatenate(([0], np.cumsum(ODD_LEAD[data] | (data == 0x97) | (data == 0xB7))))
    rows = np.flatnonzero(odd[offsets[1:]] > odd[offsets[:-1]])
    if not len(rows):
        return texts
    out = texts.to_pylist()
    for i in rows:
        out[i] = separator.sub(" ", unicodedata.normalize("NFC", out[i]))
    return pa.array(out, pa.string())


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string array without nulls."""
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(texts: pa.Array, size: int = 1 << 20):
    """(first row, slice) pieces of about size bytes; a longer text is a piece of its own."""
    if not len(texts):
        return
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row offsets into hashes, byte starts, byte ends) of the words of plain() texts."""
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none
    inside = WORD_BYTE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODE[data] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def sequence_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of hashes[start:end] for each pair of positions."""
    up, down = powers(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[: len(hashes)])))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words and their row offsets; a row with fewer words has one run of all."""
    count = np.diff(rows)
    here = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(here)))
    starts = np.arange(out[-1]) + np.repeat(rows[:-1] - out[:-1], here)
    return sequence_hash(hashes, starts, np.minimum(starts + k, np.repeat(rows[1:], here))), out
