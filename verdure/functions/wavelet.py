"""Causal db4 wavelet smoothing as a fixed linear projection.

A level-1 periodised orthogonal DWT whose detail band is zeroed is the linear
projector P = sum_k v_k v_k^T (v_k = the low-pass filter circularly placed at
phase k).  For a history of n <= 12 samples, the reconstructed last sample is a
dot product of the history with one row of P, so the whole transform becomes a
constant-weight sum over window lags: no UDF, no arrays, whole-stage codegen.
Odd lengths are padded by repeating the last sample (periodisation rule), which
folds the padded weight onto the last real sample.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np

from .constants import DB4_DEC_LO, WAVELET_WINDOW

MIN_LEN = 4
_PHASE = 4  # first output phase of the periodised decimation


@lru_cache(maxsize=None)
def approx_weights(n: int) -> tuple[float, ...]:
    """Weights, oldest -> newest, giving the low-band reconstruction of sample n-1."""
    taps = np.asarray(DB4_DEC_LO)
    size = n + (n % 2)
    proj = np.zeros((size, size))
    for phase in range(_PHASE, _PHASE + size, 2):
        v = np.zeros(size)
        for j, tap in enumerate(taps):
            v[(phase - j) % size] += tap
        proj += np.outer(v, v)
    row = proj[n - 1].copy()
    if size > n:
        row[n - 1] += row[size - 1]
    return tuple(float(x) for x in row[:n])


def approx_sql(hist: list[str], n: str, double_suffix: str = "") -> str:
    """SQL text of the same projection: ``double_suffix='D'`` gives Spark double
    literals (one expression string instead of hundreds of Column objects); the
    bare form is what the DuckDB oracle runs."""
    cases = []
    for length in range(MIN_LEN, WAVELET_WINDOW + 1):
        w = approx_weights(length)
        terms = " + ".join(f"{hist[length - 1 - i]} * {w[i]!r}{double_suffix}" for i in range(length))
        cases.append(f"WHEN {n} = {length} THEN {terms}")
    hs = ", ".join(hist[:WAVELET_WINDOW])
    return (f"CASE WHEN {n} < {MIN_LEN} OR greatest({hs}) = least({hs}) THEN {hist[0]} "
            + " ".join(cases) + " END")


# ---- full-series (non-causal) transform of an array
def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _even(x: str) -> str:
    return f"if(size({x}) % 2 = 0, {x}, concat({x}, array({x}[size({x}) - 1])))"


def _analysis_sql(x: str) -> str:
    """Low band of the array ``x`` of even size: every second output of the periodised filter."""
    terms = " + ".join(f"{tap!r}D * {x}[pmod(2 * k + {_PHASE - j}, size({x}))]" for j, tap in enumerate(DB4_DEC_LO))
    return f"transform(sequence(0, size({x}) div 2 - 1), k -> {terms})"


def _synthesis_sql(a: str, size: str) -> str:
    """Series of ``size`` (even) samples whose low band is ``a``: each sample gathers the taps that reached it."""
    def tap(j, value):
        return f"if((i + {j}) % 2 = {_PHASE % 2}, {value!r}D * {a}[pmod(i + {j} - {_PHASE}, {size}) div 2], 0D)"
    return f"transform(sequence(0, {size} - 1), i -> {' + '.join(tap(j, v) for j, v in enumerate(DB4_DEC_LO))})"


def full_series_sql(x: str) -> str:
    """Low-band reconstruction of a whole series (periodised db4, detail bands zeroed) at max(1, min(2, floor(log2(n / 7))))
    levels, so two from 28 samples on.  Odd lengths are padded with the last sample at each level and the reconstruction is
    trimmed back; a series shorter than 4 stays as it is."""
    inner = _let(_even("a1"), "p2", _let(_analysis_sql("p2"), "a2", f"slice({_synthesis_sql('a2', 'size(p2)')}, 1, size(a1))"))
    two = _let(f"if(size(x) >= 28, {inner}, a1)", "b1", _synthesis_sql("b1", "size(p1)"))
    body = _let(_even("x"), "p1", _let(_analysis_sql("p1"), "a1", f"slice({two}, 1, size(x))"))
    return _let(x, "x", f"if(size(x) < {MIN_LEN}, x, {body})")
