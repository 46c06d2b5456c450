"""Numpy helpers on whole Arrow text columns: words, rolling hashes, window minima.

Texts are handled as UTF-8 bytes in one buffer with offsets, never as Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; one longer document makes a slice of its own.
SLICE_BYTES = 1 << 18

#: Spans are told apart by a polynomial modulo this prime; no structure of a text makes two agree.
PRIME = (1 << 61) - 1
BASE = 0x1E3779B97F4A7C15 % PRIME
_INVERSE = pow(BASE, -1, PRIME)
#: ``[\x20\x09-\x0D]``
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_QUICK = 0x9E3779B97F4A7C15
_quick: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_P, _LOW32, _LOW31, _LOW29 = (np.uint64(x) for x in (PRIME, (1 << 32) - 1, (1 << 31) - 1, (1 << 29) - 1))
_S3, _S29, _S30, _S31, _S32, _S61 = (np.uint64(x) for x in (3, 29, 30, 31, 32, 61))


def _fold(x: np.ndarray) -> np.ndarray:
    """The same residue, less than ``PRIME``, of any 64-bit value."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues modulo ``PRIME``, by halves of 32 bits."""
    a1, a0, b1, b0 = a >> _S32, a & _LOW32, b >> _S32, b & _LOW32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    high = (a1 * b1 << _S3) + (middle >> _S29) + ((middle & _LOW29) << _S32)
    return _fold((high & _P) + (high >> _S61) + (low & _P) + (low >> _S61))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and ``BASE ** -i`` modulo ``PRIME`` for ``i < n``."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, _INVERSE)):
            run = np.ones(size, np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                run[done : done + more] = times(run[:more], np.uint64(pow(base, done, PRIME)))
                done += more
            _powers[k] = run
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(values) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a text or binary column; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
        if isinstance(values, pa.ChunkedArray):
            values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], pa.string())
    if values.null_count:
        values = values.fill_null(b"" if pa.types.is_binary(values.type) else "")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    kind = np.int64 if wide else np.int32
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = values.buffers()
    offsets = np.frombuffer(off, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """``(first row, row after the last, bytes, offsets)`` of at most ``limit`` bytes or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word number of each row, for words ``[^\\x20\\x09-\\x0D]+``.

    The third has one entry more than there are rows.
    """
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | np.concatenate(([True], ~inside[:-1]))[:n]))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True]))[:n])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a Rabin-Karp polynomial modulo ``PRIME``, its terms split at 31 bits."""
    power = powers(len(values))[0]
    if len(values) and values.max() >> _S29:
        terms = times(_fold(values), power)
    else:  # bytes and code points: the product needs no more than one fold
        middle = values * (power >> _S32)
        terms = (middle >> _S29) + ((middle & _LOW29) << _S32)
        low = values * (power & _LOW32)
        terms += (low & _P) + (low >> _S61)
    high, low = (np.zeros(len(values) + 1, np.uint64) for _ in range(2))
    np.cumsum(terms >> _S31, out=high[1:])
    np.cumsum(terms & _LOW31, out=low[1:])
    return high, low


def span_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scrambled hashes of the spans ``[start, end)``, the same wherever a span stands."""
    high, low = (_fold(p[ends] - p[starts]) for p in prefix)
    total = _fold(((high << _S31) & _P) + (high >> _S30) + low)
    return mix(times(total, powers(len(prefix[0]))[1][starts]))


def quick_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of spans by a polynomial modulo 2**64, several times cheaper.

    Texts can be made whose names agree, so only for callers that compare the spans as well.
    """
    power, back = _quick_powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts])


def _quick_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_quick[0]) < n:
        size = max(n, 2 * SLICE_BYTES + 2)
        for k, base in enumerate((_QUICK, pow(_QUICK, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _quick[k] = np.cumprod(run, dtype=np.uint64)
    return _quick[0][:n], _quick[1][:n]


def byte_prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prefix_hash(data.astype(np.uint64) + np.uint64(1))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(byte_prefix(data), starts, ends) if len(starts) else np.empty(0, np.uint64)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` neighbouring hashes (row limits are the caller's).

    A run is made of two shorter ones that overlap or touch, so the work grows with the
    logarithm of its length.
    """
    done = 1
    while done < length:
        step = min(done, length - done)
        keep = max(len(values) - step, 0)
        values = mix(values[:keep] * np.uint64(0x9E3779B97F4A7C15) + values[step : step + keep])
        done += step
    return values


def byte_runs(data: np.ndarray, length: int) -> np.ndarray:
    """The same for bytes; up to eight of them are told apart without a hash."""
    values, done = data.astype(np.uint64), 1
    while done < min(length, 8):
        step = min(done, length - done)
        keep = max(len(values) - step, 0)
        values = values[:keep] | values[step : step + keep] << np.uint64(8 * done)
        done += step
    values = mix(values)
    while done < length:
        step = min(done, length - done)
        keep = max(len(values) - step, 0)
        values = mix(values[:keep] * np.uint64(0x9E3779B97F4A7C15) + values[step : step + keep])
        done += step
    return values


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``starts[i] … starts[i] + sizes[i] - 1`` of all i, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Positions where a window of ``length`` units begins that ends in the same row."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return np.arange(total) + shift


def rows_of(first: np.ndarray, length: int) -> np.ndarray:
    """The row of each entry of :func:`window_starts`."""
    return np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - length + 1, 0))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by forward and backward runs over blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    full = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)))
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(gram: np.ndarray, window: int, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``window`` units its anchor: place and hash of its least gram.

    ``gram[i]`` is the hash of ``size`` units from ``i``. Equal windows have equal anchors at
    equal places within them, so a window can only repeat if its anchor does.
    """
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    width = window - size + 1
    bits = np.uint64(max(1, int(len(gram)).bit_length()))
    marked = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    least = window_minima(marked, width)[starts]
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place, gram[place]


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` units lie in a window of ``length`` at one of the distinct ``starts``."""
    change = np.zeros(n + 1, np.int64)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change[:n]) > 0


def group_min(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the least value of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.minimum.reduceat(values[order], first)


def found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table by binary search, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
