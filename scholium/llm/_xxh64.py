"""XXH64 of many byte ranges at once, after the public specification of the hash."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: The five primes of the hash.
P1, P2, P3, P4, P5 = map(_U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    n = len(buf) + 1
    u64 = np.ndarray((n,), "<u8", padded, 0, (1,))
    u32 = np.ndarray((n,), "<u4", padded, 0, (1,))
    length, at, seed = end - start, start.copy(), _U(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(start), seed + P5, np.uint64)
        if len(long := np.flatnonzero(length >= 32)):
            v = [np.full(len(long), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            pos, on = at[long], np.arange(len(long))
            while len(on):
                for k in range(4):
                    v[k][on] = _round(v[k][on], u64[pos[on] + 8 * k])
                pos[on] += 32
                on = on[end[long[on]] - pos[on] >= 32]
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                h = (h ^ _round(_U(0), v[k])) * P1 + P4
            acc[long], at[long] = h, pos
        acc += length.astype(np.uint64)
        on = np.flatnonzero(end - at >= 8)
        while len(on):
            acc[on] = _rotl(acc[on] ^ _round(_U(0), u64[at[on]]), 27) * P1 + P4
            at[on] += 8
            on = on[end[on] - at[on] >= 8]
        if len(on := np.flatnonzero(end - at >= 4)):
            acc[on] = _rotl(acc[on] ^ (u32[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
            at[on] += 4
        on = np.flatnonzero(end > at)
        while len(on):
            acc[on] = _rotl(acc[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
            on = on[end[on] > at[on]]
        acc = (acc ^ (acc >> _U(33))) * P2
        acc = (acc ^ (acc >> _U(29))) * P3
        return acc ^ (acc >> _U(32))
